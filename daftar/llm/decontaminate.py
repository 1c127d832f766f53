"""Benchmark decontamination by spaced seeds.

A seed hashes six of the words in a window and ignores the others, at places a fixed mask names;
so a passage is still found when words in it were substituted. Seeds of the benchmark and of the
documents are joined, and around each hit the words of both are compared along the hit's diagonal.
The masks lose nothing: wherever the substitutions stand, an overlap that counts has a window of one
of the masks without any (tested for all places).

Documents send nothing into the join but seeds that pass a Bloom filter of the benchmark's seeds,
with the words around them. The filter has a fixed number of bits, is built by an aggregation and
is the only thing broadcast: a larger benchmark passes more seeds and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.common import Scratch, over_rows, slices
from daftar.llm.sieve import without

#: Fixed masks: 1 takes a word into the seed, 0 ignores it.
MASKS = ("1111011", "110010111", "1101000111", "111100011")
_PLACES = [np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == ord("1")) for m in MASKS]
_SPANS = [len(m) for m in MASKS]
#: Items of fewer words must stand whole.
_SHORTEST = 11
_FACTORS = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 | 1 for k in range(32)], np.uint64)
FILTER_BITS = 26
_SEEDS = 100_000  # no more rows of the seed index than this are broadcast

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else (c if c >= 128 or chr(c).isalnum() else 32) for c in range(256)
)


def words(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words: runs of ASCII letters and digits, lower-cased, and non-ASCII characters."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def seeds(tokens: np.ndarray, short: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """All seeds of a word sequence and the places where their windows start.

    ``short`` names window lengths that are hashed whole, for items that must stand whole.
    """
    masks = list(zip(range(len(MASKS)), _PLACES, _SPANS, strict=True)) + [(100 + n, np.arange(n), n) for n in short]
    return _hashed(tokens, masks)


def _hashed(tokens: np.ndarray, masks: list[tuple[int, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The seeds of each (tag, places, span) of ``masks`` and where their windows start."""
    found, starts = [], []
    for tag, places, span in masks:
        count = len(tokens) - span + 1
        if count < 1:
            continue
        total = np.full(count, tag, np.uint64)
        for k, place in enumerate(places):
            total += tokens[place : place + count] * _FACTORS[k]
        found.append(_mixed(total))
        starts.append(np.arange(count, dtype=np.int32))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    return np.concatenate(found), np.concatenate(starts)


def _probes(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return seed & mask, (seed >> np.uint64(64 - FILTER_BITS)) & mask


class Filter:
    """Two probes per seed into ``2 ** FILTER_BITS`` bits, sent as the words that have a bit set."""

    def __init__(self, places: np.ndarray, bits: np.ndarray) -> None:
        self.places, self.bits, self.table = places, bits, None

    def passes(self, seed: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
            self.table[self.places] = self.bits
        first, second = _probes(seed)
        hit = lambda at: self.table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
        out = hit(first).astype(bool)
        out[out] = hit(second[out]).astype(bool)
        return out

    def __getstate__(self):
        return self.places, self.bits

    def __setstate__(self, state):
        (self.places, self.bits), self.table = state, None


def segment(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the run with most equal words of those with four of five equal; then the shortest, then the first.

    With +1 for equal words and -4 for others, such a run is two prefix sums that do not fall; of
    each start the last such end has most equal words.
    """
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -4))])
    count = np.concatenate([[0], np.cumsum(equal)])
    highest = np.maximum.accumulate(total[::-1])[::-1]
    places = np.flatnonzero(equal)
    last = count[np.searchsorted(-highest, -total[places], side="right") - 1]
    same, ends = last - count[places], places[last - 1] + 1
    best = np.lexsort((places, ends - places, -same))[0]
    return int(places[best]), int(ends[best])


def aligned(document: np.ndarray, item: np.ndarray, diagonal: int, least: int) -> tuple[int, int, int] | None:
    """(first word in the document, words, equal words) of the overlap along a diagonal, if long enough.

    At least four of five words are equal, and as many as ``least``, or four fifths of a shorter item.
    """
    low, high = max(0, -diagonal), min(len(item), len(document) - diagonal)
    if high <= low:
        return None
    equal = item[low:high] == document[low + diagonal : high + diagonal]
    if not equal.any():
        return None
    start, end = segment(equal)
    same = int(equal[start:end].sum())
    if same < min(least, -(-4 * len(item) // 5)):
        return None
    return low + diagonal + start, end - start, same


def _items(benchmark: DataFrame, item_id: str, least_words: int) -> DataFrame:
    """One row for each different word sequence: its smallest item_id and its words."""

    def convert(ids: list, texts: list) -> pa.RecordBatch:
        lists = pa.array([words(t).view(np.int64) for t in texts], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["item_id", "words"])

    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), "text")
    known = over_rows(rows, ["item_id", "text"], convert, "item_id long, words array<long>")
    long_enough = known.where(F.col("item_id").isNotNull() & (F.size("words") >= least_words))
    return long_enough.groupBy("words").agg(F.min("item_id").alias("item_id"))


def overlaps(
    docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", least: int = 13, least_words: int = 5
) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, n_equal, coverage): documents that hold a benchmark item.

    One row for each document and item that overlap, with the best overlap. Items whose words are
    the same are one item, that of the smallest id; items of fewer than ``least_words`` words are
    not tested. Items of fewer than 11 words must stand whole; longer ones must share
    ``least`` words, or four fifths of theirs, with at most one word in five substituted.
    ``first_word`` counts the document's words from 0; ``coverage`` is the share of the item's words
    that are equal.

    Null and empty texts overlap nothing, rows without an id are left out, rows that repeat an id
    count as one document, and ties go to the earliest overlap. An empty table on either side gives
    an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = scratch.put(_items(benchmark, item_id, least_words), "items")
    facts = items.agg(
        F.max(F.size("words")).alias("longest"),
        F.collect_set(F.when(F.size("words") < _SHORTEST, F.size("words"))).alias("short"),
    ).first()
    reach, short = facts.longest or 0, tuple(sorted(facts.short))

    def item_seeds(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for number, tokens in zip(part.column("item_id").to_pylist(), part.column("words"), strict=True):
                row = np.asarray(tokens.values).view(np.uint64)
                whole = [(100 + len(row), np.arange(len(row)), len(row))]
                found, places = _hashed(row, whole) if len(row) < _SHORTEST else seeds(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(places), pa.array(np.full(len(found), number))],
                    ["seed", "at", "item_id"],
                )

    index = scratch.put(items.mapInArrow(item_seeds, "seed long, at int, item_id long"), "seeds")
    low = F.lit((1 << FILTER_BITS) - 1)
    both = F.array(F.col("seed").bitwiseAND(low), F.shiftrightunsigned("seed", 64 - FILTER_BITS))
    bit = index.select(F.explode(both).alias("bit"))
    cell = F.shiftright("bit", 6).alias("cell")
    one = F.expr("shiftleft(1L, cast(bit & 63 AS int))")
    cells = bit.groupBy(cell).agg(F.bit_or(one).alias("bits")).toArrow()  # at most 2 ** (FILTER_BITS - 6) rows
    sieve = spark.sparkContext.broadcast(
        Filter(cells["cell"].to_numpy(), np.asarray(cells["bits"].to_numpy()).view(np.uint64))
    )

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accept = sieve.value
        for part in parts:
            for piece in slices(part):
                out: list[list] = [[], [], [], [], []]
                for number, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    tokens = words(text)
                    found, places = seeds(tokens, short)
                    hit = accept.passes(found)
                    if not hit.any():
                        continue
                    found, places = found[hit], places[hit]
                    order = np.argsort(places, kind="stable")
                    found, places = found[order], places[order]
                    # Hits whose surroundings touch share one stretch of words.
                    breaks = np.flatnonzero(np.diff(places) > 2 * reach) + 1
                    for some, where in zip(np.split(found, breaks), np.split(places, breaks), strict=True):
                        first = max(0, int(where[0]) - reach)
                        stretch = tokens[first : int(where[-1]) + reach]
                        for column, value in zip(out, (number, first, stretch.view(np.int64), some.view(np.int64), where - first), strict=True):
                            column.append(value)
                longs = pa.list_(pa.int64())
                kinds = (pa.int64(), pa.int32(), longs, longs, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(out, kinds, strict=True)],
                    ["doc_id", "first", "stretch", "seeds", "places"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    stretches = scratch.put(
        rows.mapInArrow(scan, "doc_id long, first int, stretch array<long>, seeds array<long>, places array<int>"),
        "stretches",
    )
    hits = stretches.select("doc_id", "first", F.size("stretch").alias("size"), F.explode(F.arrays_zip("seeds", "places")).alias("h"))
    hits = hits.select("doc_id", "first", "size", F.col("h.seeds").alias("seed"), F.col("h.places").alias("place"))
    # Spark sizes the hits as the stretches they come from; broadcast is the index, where it is small, or nothing.
    known_seeds = F.broadcast(index) if index.count() <= _SEEDS else index.hint("merge")
    pairs = hits.join(known_seeds, "seed").select("doc_id", "first", "size", "item_id", (F.col("place") - F.col("at")).alias("diagonal"))
    pairs = pairs.distinct()
    known = ["doc_id", "first", "size"]
    both_sides = pairs.join(stretches.withColumn("size", F.size("stretch")).select(*known, "stretch"), known).join(items, "item_id")

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            columns = (part.column(c) for c in ("doc_id", "first", "item_id", "diagonal"))
            scalars = zip(*(c.to_pylist() for c in columns), strict=True)
            for (doc, first, item, diagonal), stretch, own in zip(scalars, part.column("stretch"), part.column("words"), strict=True):
                mine = np.asarray(own.values)
                found = aligned(np.asarray(stretch.values), mine, diagonal, least)
                if found:
                    out.append((doc, item, first + found[0], found[1], found[2], found[2] / len(mine)))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(result.names, row, strict=True)) for row in out], schema=result
            )

    result = pa.schema(
        [("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()),
         ("n_equal", pa.int64()), ("coverage", pa.float64())]
    )
    schema = "doc_id long, item_id long, first_word long, n_words long, n_equal long, coverage double"
    met = both_sides.select("doc_id", "first", "item_id", "diagonal", "stretch", "words").mapInArrow(verify, schema)
    best = F.max_by(F.struct("first_word", "n_words", "n_equal", "coverage"), F.struct("n_equal", -F.col("first_word"))).alias("b")
    return met.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", least: int = 13, least_words: int = 5) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, all columns kept.

    Rows that repeat an id go together. Rows without an id are judged each by its text.
    """
    scratch = Scratch(docs.sparkSession, "clean")
    found = overlaps(docs, benchmark, item_id, least, least_words).select("doc_id").distinct()
    kind = docs.schema["doc_id"].dataType
    kept = without(docs, scratch.put(found.select(F.col("doc_id").cast(kind).alias("doc_id")), "found"), "doc_id")
    nameless = docs.where("doc_id IS NULL")
    if nameless.isEmpty():
        return kept
    texts = nameless.select(F.xxhash64("text").alias("doc_id"), "text")
    held = scratch.put(overlaps(texts, benchmark, item_id, least, least_words).select("doc_id").distinct(), "nameless")
    mark = F.broadcast(held.select(F.col("doc_id").alias("_h"))) if held.count() <= 2_000_000 else held.select(F.col("doc_id").alias("_h"))
    judged = kept.where("doc_id IS NULL").join(mark, F.xxhash64("text") == F.col("_h"), "left_anti")
    return kept.where("doc_id IS NOT NULL").unionByName(judged)
