"""Near-duplicates by circulant MinHash.

Two permutations of the 64-bit numbers generate all coordinates of a signature. The first one is
applied once to a text's shingles; the second is shifted around the circle by one place for each
coordinate, and the coordinate is the smallest place that a shingle has in it. Texts that agree in
all coordinates of one band share a bucket, and buckets that share texts are a group.

A band only proposes. Every link is confirmed on the full sets of shingles, by one kernel over
cells of bounded size: a small group is one cell. A large group is cut into blocks; each block is
first compared within itself and with the group's pivots, which joins nearly all of a group of
copies, and then only blocks that hold different components meet. So what a group of near copies
costs grows with its size, unless its texts are alike enough to share buckets and still unlinked.

With 24 bands of 5 coordinates a pair at the threshold of 0.85 shares no bucket with a probability
of 0.0000008, at 0.9 of 0.000000001. Equal sets are one node from the start, so copies never form pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.llm.common import Scratch, slices
from daftar.llm.graph import components
from daftar.llm.sieve import sieve
from daftar.operators.ranking import top_k

SHINGLE, PERCENT = 3, 85
_BANDS, _ROWS, _BLOCK = 24, 5, 1024
CELL = 1 << 19  # shingles in a cell of a group that is not cut
_PIVOTS = 16
_FIRST, _INNER, _OUTER, _TAG = (
    np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
)
_SHIFTS = np.arange(1, _BANDS * _ROWS + 1, dtype=np.uint64)[:, None] * _INNER
_PLACE = np.arange(1, _ROWS + 1, dtype=np.uint64) * np.uint64(0x1D8E4E27C47D124F)


def shingles(text: bytes | None, span: int = SHINGLE) -> np.ndarray:
    """Hashes of the different shingles of a text, sorted; fewer words are one shingle, none give none."""
    words = (text or b"").lower().split()
    tokens = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    span = min(span, len(words))
    if not span:
        return tokens
    count = len(tokens) - span + 1
    total = np.full(count, span, np.uint64)
    for k in range(span):
        total = (total ^ (total >> np.uint64(29))) * _FIRST + tokens[k : k + count]
    total = (total ^ (total >> np.uint64(31))) * _TAG
    return np.unique(total ^ (total >> np.uint64(29)))


def signature(own: np.ndarray) -> np.ndarray:
    """The coordinates of a set: coordinate ``k`` is the least place under the second permutation, shifted by ``k``.

    The second permutation is ``x -> mix(x * inner) * outer`` on 64 bits, so that shifting its
    argument by one adds ``inner`` before the mixing.
    """
    first = own ^ (own >> np.uint64(33))
    first = first * _FIRST
    first ^= first >> np.uint64(29)
    turned = first * _INNER
    least = np.full(len(_SHIFTS), 2**64 - 1, np.uint64)
    for at in range(0, len(own), _BLOCK):
        place = turned[None, at : at + _BLOCK] + _SHIFTS
        place ^= place >> np.uint64(32)
        place *= _OUTER
        np.minimum(least, place.min(axis=1), out=least)
    return least


def bands(own: np.ndarray) -> np.ndarray:
    """A hash of each band's coordinates and of its number."""
    least = signature(own).reshape(_BANDS, _ROWS)
    mixed = ((least ^ (least >> np.uint64(31))) * _TAG + _PLACE).sum(axis=1, dtype=np.uint64)
    mixed = (mixed + np.arange(_BANDS, dtype=np.uint64)) * _FIRST
    return mixed ^ (mixed >> np.uint64(29))


def spanning_links(
    sets: list[np.ndarray], keys: np.ndarray, label: np.ndarray, side: np.ndarray | None = None, percent: int = PERCENT
) -> list[tuple[int, int]]:
    """Confirmed links between sets of different labels that share a band, enough to join what links join.

    ``label`` numbers what is joined already; with ``side`` only sets of different sides meet. Sets
    go from small to large; each meets the smaller ones that share a band and may be similar by
    size, until it is joined with all of them.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    _, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    own = np.split(flat, np.cumsum(sizes[order])[:-1])
    sizes, keys, label = sizes[order], keys[order], np.unique(label[order], return_inverse=True)[1]
    side = None if side is None else side[order]
    marked = np.zeros(len(flat), bool)
    out = []
    for k in range(1, len(own)):
        start = int(np.searchsorted(100 * sizes[:k], percent * sizes[k]))
        open_ = label[start:k] != label[k]
        if side is not None:
            open_ &= side[start:k] != side[k]
        left = start + np.flatnonzero(open_)
        left = left[(keys[left] == keys[k]).any(axis=1)]
        if not len(left):
            continue
        marked[own[k]] = True
        step = 1
        while len(left):
            some, left = left[:step], left[step:]
            same = np.array([np.count_nonzero(marked[own[c]]) for c in some])
            for other in some[100 * same >= percent * (sizes[some] + sizes[k] - same)]:
                if label[other] != label[k]:
                    label[label == label[other]] = label[k]
                    out.append((int(order[other]), int(order[k])))
            left, step = left[label[left] != label[k]], min(2 * step, 64)
        marked[own[k]] = False
    return out


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [row.values.to_numpy(zero_copy_only=False) for chunk in column.chunks for row in chunk]


def _confirmed(cells: DataFrame, key: list[str], percent: int, across: bool = False) -> DataFrame:
    """(low, high): the spanning links of every cell; with ``across`` only between its two sides."""

    def resolve(cell: pa.Table) -> pa.Table:
        names, once = np.unique(cell.column("node").to_numpy(), return_index=True)
        cell = cell.take(pa.array(once))
        found = []
        if len(names) > 1:
            sets = [s.view(np.uint64) for s in _lists(cell.column("shingles"))]
            side = cell.column("side").to_numpy() if across else None
            found = spanning_links(sets, np.array(_lists(cell.column("bands"))), cell.column("label").to_numpy(), side, percent)
        ends = names[np.array(found, np.int64).reshape(-1, 2)]
        return pa.table({"low": ends.min(axis=1), "high": ends.max(axis=1)})

    return cells.groupBy(*key).applyInArrow(resolve, "low long, high long")


def _joined_by_parts(sets: DataFrame, large: DataFrame, scratch: Scratch, percent: int, cell: int) -> DataFrame:
    """(low, high): spanning links within the groups of ``large`` (group, size), none of which fits a cell.

    ``sets`` has (group, node, n, bands, shingles), one row for each node. Blocks hold half a cell.
    """

    def blocks(size: str) -> Column:
        return F.ceil(F.col(size) * 2 / F.lit(cell)).cast("int")

    mine = sets.join(large, "group").withColumn("label", F.col("node")).withColumn("side", F.lit(0))
    columns = ["group", "block", "node", "label", "side", "bands", "shingles"]
    dealt = mine.withColumn("block", F.pmod(F.xxhash64("node"), blocks("size")).cast("int")).select(*columns)
    drawn = top_k(mine.select("group", "node"), ["group"], [F.xxhash64("node", F.lit(1)), F.col("node")], _PIVOTS)
    every = F.explode(F.sequence(F.lit(0), blocks("size") - 1))
    pivots = mine.join(drawn.select("node"), "node").withColumn("block", every).select(*columns)
    first = scratch.put(_confirmed(dealt.unionByName(pivots), ["group", "block"], percent), "first")

    # Blocks of one component each where it is large; blocks of all the rest of the group.
    joined = components(first, scratch, "parts").withColumnRenamed("root", "label")
    known = sets.select("group", "node", "n").join(large.select("group"), "group").join(joined, "node", "left")
    known = known.withColumn("label", F.coalesce("label", "node"))
    weight = known.groupBy("group", "label").agg(F.sum("n").alias("weight")).withColumn("pure", F.col("weight") * 2 > cell)
    weight = weight.withColumn("own", F.when(F.col("pure"), F.col("label")).otherwise(0))
    parts = weight.groupBy("group", "pure", "own").agg(F.sum("weight").alias("size")).withColumn("parts", blocks("size"))
    block = F.xxhash64("pure", "own", "part")
    dealt = known.join(weight, ["group", "label"]).join(parts.select("group", "pure", "own", "parts"), ["group", "pure", "own"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = scratch.put(dealt.select("group", "node", "label", block.alias("block")), "dealt")
    some = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("group", "pure", "own", block.alias("block"))
    left = some.select("group", F.col("block").alias("a"), "pure", "own")
    right = some.select("group", F.col("block").alias("b"), F.col("pure").alias("_pure"), F.col("own").alias("_own"))
    meet = left.join(right, "group").where("a <= b AND (NOT pure OR pure <> _pure OR own <> _own)")
    sides = meet.select("group", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    cells = dealt.join(sides, ["group", "block"]).withColumn("side", (F.col("block") == F.col("a")).cast("int"))
    cells = cells.join(sets.select("node", "bands", "shingles"), "node")
    between = _confirmed(cells.where("a <> b"), ["group", "a", "b"], percent, across=True)
    within = _confirmed(cells.where("a = b"), ["group", "a", "b"], percent)
    return scratch.put(first.unionByName(between).unionByName(within), "parted")


def confirmed_links(docs: DataFrame, percent: int, span: int, cell: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, node, n), (node, first), (low, high): every row's set and its size, every set's smallest doc_id, and links between sets.

    A set is a node; those of texts without words, with ``n`` 0, are not in the second and third
    table. The links are enough to join what all join; they are not stored, the other tables are.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for part in parts for p in slices(part, 4 << 20)):
            sets = [shingles(text, span) for text in piece.column(1).to_pylist()]
            nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            keys = pa.array([bands(s).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64()))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(nodes), sizes, keys], ["doc_id", "node", "n", "bands"])

    rows = scratch.put(texts.mapInArrow(sign, "doc_id long, node long, n long, bands array<long>"), "rows")
    known = rows.where("doc_id IS NOT NULL AND n > 0")
    nodes = scratch.put(known.groupBy("node", "n", "bands").agg(F.min("doc_id").alias("first")), "nodes")
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    edges = buckets.join(shared.select("bucket", "low").hint("merge"), "bucket").where("node <> low").select("low", F.col("node").alias("high"))
    grouped = components(edges, scratch, "groups").withColumnRenamed("root", "group")
    wanted = scratch.put(nodes.join(grouped.hint("merge"), "node").select("node", "n", "bands", "first", "group"), "wanted")
    count = wanted.count()
    accept = docs.sparkSession.sparkContext.broadcast(sieve(wanted.select("first"), count))

    def again(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for part in parts for p in slices(part, 4 << 20)):
            piece = piece.filter(pa.array(accept.value.passes(piece.column(0).to_numpy())))
            sets = [shingles(text, span) for text in piece.column(1).to_pylist()]
            nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(nodes), lists], ["first", "node", "shingles"])

    read = texts.where("doc_id IS NOT NULL").mapInArrow(again, "first long, node long, shingles array<long>")
    met = wanted.join(read.hint("merge"), ["first", "node"]).dropDuplicates(["first", "node"])
    sets = scratch.put(met.select("group", "node", "n", "bands", "shingles"), "sets")
    sizes = sets.groupBy("group").agg(F.sum("n").alias("size"))
    large = scratch.put(sizes.where(F.col("size") > cell), "large")
    small = sets.join(large, "group", "left_anti").withColumn("label", F.col("node")).withColumn("side", F.lit(0))
    links = _confirmed(small, ["group"], percent)
    if not large.isEmpty():
        links = links.unionByName(_joined_by_parts(sets, large, scratch, percent, cell))
    return rows.select("doc_id", "node", "n"), nodes.select("node", "first"), links


def near_duplicates(docs: DataFrame, percent: int = PERCENT, span: int = SHINGLE, cell: int = CELL) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Rows are linked where ``100 * intersection >= percent * union`` of their sets of ``span``-word
    shingles, A-Z lower-cased; a text of fewer words is one shingle. ``component_id`` is the
    smallest doc_id that chains of links reach, the row's own included, and ``kept`` tells whether
    that is the row's own.

    A null text, or one without words, has an empty set and is linked with nothing, not even its
    like. Rows without an id keep their row, with a null component and a null ``kept``, and link
    nothing. Repeated rows get the same result; rows that repeat an id with other texts are linked
    each by its own text. An empty table gives an empty result; further columns are not read.
    ``cell`` bounds the shingles that are compared in one place.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    rows, nodes, links = confirmed_links(docs, percent, span, cell, scratch)
    linked = components(links, scratch, "links")
    chained = nodes.join(linked, "node")
    smallest = chained.groupBy("root").agg(F.min("first").alias("component_id"))
    found = scratch.put(chained.join(smallest, "root").select("node", "component_id"), "found")
    alone = nodes.join(found, "node", "left")
    classes = alone.select("node", F.coalesce("component_id", "first").alias("_component"))
    full = rows.where("n > 0").join(classes, "node", "left")
    empty = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("_component"))
    both = full.select("doc_id", "n", "_component").unionByName(empty)
    component = F.when(F.col("doc_id").isNotNull(), F.col("_component"))
    return both.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
