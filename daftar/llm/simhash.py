"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints at ``d`` or fewer differing bits agree on one half of the bits up to ``d // 2`` of
them. Each half is covered by a code of radius 1: the perfect Hamming code of length 31, with the
last bit free. Every fingerprint belongs to one anchor per half, the code word nearest to it, and
is replicated to every code word within radius plus ``d // 2`` of its half. Two fingerprints whose
halves differ in ``d // 2`` bits or fewer therefore meet at the anchor of each, and are compared
there. A half has 2^27 anchors and a fingerprint about 17 replicas per half, so the candidates at
an anchor stay few up to billions of fingerprints. (A single code over all 64 bits with a radius
that small would need thousands of replicas per fingerprint; hence one code per half.)

Equal fingerprints are one row before the anchors, so copies never form pairs.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.llm.common import Scratch, over_rows

SEED = 42
_LENGTH = 31  # of the Hamming code in each half; the 32nd bit is a code of its own


def fingerprint(text: str | bytes | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    words = raw.lower().split()
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    grams = words if shingle == 1 else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    if len(words) < shingle:
        grams = [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 65536):
        block = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint as signed 64 bits), one row for each row of ``docs``."""

    def convert(ids: list, texts: list) -> pa.RecordBatch:
        marks = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks)], ["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return over_rows(rows, ["doc_id", "text"], convert, "doc_id long, fingerprint long")


def _flips(within: int) -> list[list[int]]:
    """For each of the 32 syndromes, the flips of up to ``within`` of 32 bits that lead to a code word."""
    out: list[list[int]] = [[] for _ in range(32)]
    for weight in range(within + 1):
        for places in combinations(range(_LENGTH + 1), weight):
            syndrome = reduce(lambda s, i: s ^ (i + 1 if i < _LENGTH else 0), places, 0)
            out[syndrome].append(sum(1 << i for i in places))
    return out


def _syndrome(half: Column) -> Column:
    """Column ``i`` of the parity check is ``i + 1``; bit 31 does not take part."""
    total = F.lit(0)
    for bit in range(5):
        mask = sum(1 << i for i in range(_LENGTH) if (i + 1) >> bit & 1)
        total = total + F.bit_count(half.bitwiseAND(F.lit(mask).cast("long"))).bitwiseAND(F.lit(1)) * (1 << bit)
    return total


def _halves(mark: Column) -> list[Column]:
    low = F.lit(0xFFFFFFFF).cast("long")
    return [mark.bitwiseAND(low), F.shiftrightunsigned(mark, 32).bitwiseAND(low)]


def _word(half: Column, tag: int):
    return lambda flip: half.bitwiseXOR(flip).bitwiseOR(F.lit(tag).cast("long"))


def _anchored(marks: DataFrame, within: int | None) -> DataFrame:
    """(anchor, fingerprint): a row for each code word within ``within`` flips of either half, or for the own one.

    Bit 32 of the anchor tells the halves apart.
    """
    choices = [flips[:1] for flips in _flips(1)] if within is None else _flips(within)
    table = F.array(*(F.array(*(F.lit(f).cast("long") for f in flips)) for flips in choices))
    parts = [
        F.transform(
            F.element_at(table, _syndrome(half) + 1),
            _word(half, k << 32),
        )
        for k, half in enumerate(_halves(F.col("fingerprint")))
    ]
    return marks.select(F.explode(F.concat(*parts)).alias("anchor"), "fingerprint")


def links(marks: DataFrame, bits: int = 3) -> DataFrame:
    """(low, high): pairs of different fingerprints at ``bits`` or fewer differing bits, each at least once.

    ``marks`` has distinct ``fingerprint`` values. The own anchors of the smaller one meet the
    replicas of the larger; adaptive execution splits anchors that many fingerprints share. Spark
    sizes the replicas as the rows they are made from, so the join is told not to broadcast them.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the codes cover up to 3 differing bits")
    own = _anchored(marks, None)
    near = _anchored(marks, 1 + bits // 2).withColumnRenamed("fingerprint", "other")
    apart = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other")))
    met = own.join(near.hint("merge"), "anchor").where((F.col("fingerprint") < F.col("other")) & (apart <= bits))
    return met.select(F.col("fingerprint").alias("low"), F.col("other").alias("high"))


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component, for every node with an edge.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its
    smallest one, then its smaller neighbours too. Each step groups edges by node with a minimum,
    so a node with very many neighbours costs one partial aggregate per task, and joins the
    minimum back to the edges. Rounds are stored; their number is logarithmic in the length of paths.
    """
    current = scratch.put(edges.select(F.col("high").alias("u"), F.col("low").alias("v")).distinct(), "edges-0")
    total, step = None, 0
    while step < most_rounds:
        # large star: larger neighbours of u to the smallest of u and its neighbours
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours of u, and u, to the smallest of them
        large = scratch.put(large.distinct(), f"large-{step}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        after = scratch.put(small, f"edges-{step}")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"edges-{step - 1}")
        scratch.drop(f"large-{step - 1}")
        current = after
        if mark == total:
            break
        total = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits. ``component_id`` is the smallest doc_id that
    chains of links reach, the row's own included. A null or empty text has fingerprint zero and is
    linked like any other; repeated rows get the same result; a null doc_id keeps its row, is never
    the smallest, and has a null component only where no document with an id is linked to it. An
    empty table gives an empty result; further columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.put(fingerprints(docs, shingle), "fingerprints")
    marks = scratch.put(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct")
    pairs = scratch.put(links(marks.select("fingerprint"), bits), "links")
    linked = components(pairs, scratch)
    member = linked.select(F.col("node").alias("fingerprint"), "root")
    roots = linked.select(F.col("root").alias("fingerprint"), "root").distinct()
    chained = marks.join(member.unionByName(roots), "fingerprint")
    smallest = chained.groupBy("root").agg(F.min("first").alias("component_id"))
    found = scratch.put(chained.join(smallest, "root").select("fingerprint", "component_id"), "classes")
    alone = marks.join(found, "fingerprint", "left_anti").select("fingerprint", F.col("first").alias("component_id"))
    classes = scratch.put(found.unionByName(alone), "components")
    return rows.join(classes, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, all columns kept.

    Rows equal in every column count once. Rows without an id stay: nothing tells which of them to keep.
    """
    return leaders(docs, near_duplicates(docs, shingle, bits), Scratch(docs.sparkSession, "simhash"))


def leaders(docs: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` that ``keep_one`` keeps, by the (doc_id, component_id) of ``found``."""
    # An id that stands in several rows goes only if none of them leads its component.
    kinds = scratch.put(
        found.groupBy("doc_id").agg(
            F.bool_or(F.col("doc_id") == F.col("component_id")).alias("leads"), (F.count("*") > 1).alias("again")
        ),
        "kinds",
    )
    led = docs.join(kinds.where(~F.col("leads")).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    again = kinds.where("again").select("doc_id")
    once = led.join(again, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(led.join(again, "doc_id", "left_semi").select(*docs.columns).distinct())
