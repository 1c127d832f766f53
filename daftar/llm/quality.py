"""Quality rules: fixed rules first, then robust multivariate outliers per language and source.

Each text becomes a few counts, each count a transformed rate. Per language and source a minimum-
covariance-determinant estimate finds centre and spread of the majority, and texts at a large
Mahalanobis distance from it are rejected. Concentration steps run as Spark aggregations over all
rows of all groups at once: distances fall into bins, the bins give each group the cut that holds
its closest ``share`` of rows, and sums of products below the cut give the next estimate. A group
of any size, also one with a third of all rows, is partial sums per task and nothing else.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daftar.llm.common import Scratch, over_rows

_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = rb"""!"'()+,-./:;=?@[\]^_`{}~"""
_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]")
_WINDOW = 8

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks",
)

#: Spread below which a rate does not tell texts apart, per dimension of ``vector``.
FLOORS = (0.04, 0.10, 0.10, 0.10, 0.10, 0.08)
_BINS_PER_OCTAVE = 8


def _repeat_words(words: list[bytes]) -> int:
    """Words inside windows of 8 words that the text holds twice or more."""
    count = len(words) - _WINDOW + 1
    if count < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    width = 1
    while width < _WINDOW:  # windows of 1, 2, 4 and 8 words as dense numbers: exact, no hashing
        pairs = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        distinct, ids = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(pairs):
            return 0
        width *= 2
    twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:count] += twice
    edge[_WINDOW : _WINDOW + count] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts named in ``COUNTS``; zeros for a null text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    words = raw.split()  # bytes are split at exactly the six ASCII spaces
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return (
        len(words),
        len(text) - (size - len(raw.translate(None, _SPACES))),
        size - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeat_words(words),
        len(lines),
        size - len(raw.translate(None, _CAPITALS)),
        size - len(raw.translate(None, _MARKS)),
    )


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text."""

    def convert(ids: list, langs: list, sources: list, texts: list) -> pa.RecordBatch:
        table = np.array([text_counts(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
        arrays = [pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(sources, pa.string())]
        arrays += [pa.array(table[:, k]) for k in range(len(COUNTS))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang", "source", *COUNTS])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), "text",
    )
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    return over_rows(rows, ["doc_id", "lang", "source", "text"], convert, schema)


def base_failed() -> Column:
    few = F.col("n_words") < 20
    return few | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


AXES = tuple(f"x{k}" for k in range(len(FLOORS)))


def vector() -> list[Column]:
    """The transformed rates; 20 pseudo-words at the usual value damp the noise of short texts."""
    words = F.col("n_words") + 20.0
    chars = F.col("word_chars") + 100.0
    rates = (
        F.log(chars / words),
        F.asinh(2 * F.col("n_symbols") / words),
        F.asinh(2 * F.col("n_dup_lines") / (F.col("n_lines") + 5.0)),
        F.asin(F.sqrt(F.col("n_repeat_words") / words)),
        F.asin(F.sqrt(F.col("n_capitals") / chars)),
        F.asin(F.sqrt(F.col("n_marks") / chars)),
    )
    return [rate.alias(axis) for axis, rate in zip(AXES, rates, strict=True)]


def _chi2_cdf(x: float, d: int) -> float:
    """Lower regularised incomplete gamma function by its series."""
    if x <= 0:
        return 0.0
    a, z = d / 2, x / 2
    term = total = 1 / a
    for n in range(1, 2000):
        term *= z / (a + n)
        total += term
        if term < total * 1e-15:
            break
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, d) < p else (low, mid)
    return low


def solve(factor: float):
    """Centre and inverse spread from each part's row count, sums and sums of products, batch by batch."""
    d = len(FLOORS)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, inverses = [], []
            sums = np.column_stack([batch.column(s).to_numpy(zero_copy_only=False) for s in _SUMS])
            for n, row in zip(batch.column("n").to_pylist(), sums, strict=True):
                centre = row[:d] / n
                spread = np.zeros((d, d))
                spread[upper] = row[d:] / n
                spread = factor * (spread + np.triu(spread, 1).T - np.outer(centre, centre)) + np.diag(np.square(FLOORS))
                centres.append(centre)
                inverses.append(np.linalg.inv(spread).ravel())
            doubles = pa.list_(pa.float64())
            arrays = [batch.column("part"), pa.array(centres, doubles), pa.array(inverses, doubles)]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "centre", "inverse"])

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _measured(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a batch, and their squared Mahalanobis distances from ``centre``."""
    d = len(FLOORS)
    x = np.column_stack([part.column(axis).to_numpy(zero_copy_only=False) for axis in AXES])
    away = x - _matrix(part.column("centre"), d)
    inverse = _matrix(part.column("inverse"), d * d).reshape(-1, d, d)
    return x, np.maximum(np.einsum("ni,nij,nj->n", away, inverse, away), 0.0)


_SUMS = [f"s{k}" for k in range(len(FLOORS) + len(FLOORS) * (len(FLOORS) + 1) // 2)]


def _binned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's row counts, sums and sums of products per part and distance bin."""
    i, j = np.triu_indices(len(FLOORS))
    for part in parts:
        if not part.num_rows:
            continue
        x, distance = _measured(part)
        bins = np.floor(np.log2(distance + 1e-6) * _BINS_PER_OCTAVE).astype(np.int32)
        columns = [part.column("part"), pa.array(bins), pa.array(np.ones(len(bins), np.int64))]
        columns += [pa.array(c) for c in np.column_stack([x, x[:, i] * x[:, j]]).T]
        table = pa.Table.from_arrays(columns, ["part", "bin", "n", *_SUMS])
        summed = table.group_by(["part", "bin"]).aggregate([(s, "sum") for s in ("n", *_SUMS)])
        yield from summed.rename_columns(["part", "bin", "n", *_SUMS]).combine_chunks().to_batches()


def _start(rows: DataFrame) -> DataFrame:
    """Each part's start: median as centre, quartile spread on the diagonal, from counted bins of 1/256."""
    d = len(FLOORS)
    axes = F.array(*(F.floor(F.col(axis) * 256) for axis in AXES))
    cells = rows.select("part", F.posexplode(axes).alias("axis", "cell")).groupBy("part", "axis", "cell").count()
    order = Window.partitionBy("part", "axis")
    running = cells.select(
        "part", "axis", "cell", F.sum("count").over(order.orderBy("cell")).alias("upto"),
        F.sum("count").over(order).alias("total"),
    )
    at = [F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("cell"))) for q in (0.25, 0.5, 0.75)]
    spots = running.groupBy("part", "axis").agg(*(c.alias(f"q{k}") for k, c in enumerate(at)))
    width = (F.col("q2") - F.col("q0")) / (256 * 1.349)
    floor = F.element_at(F.array(*map(F.lit, FLOORS)), F.col("axis") + 1)
    spot = F.struct("axis", ((F.col("q1") + 0.5) / 256).alias("middle"), (1 / (width * width + floor * floor)).alias("weight"))
    lists = spots.groupBy("part").agg(F.array_sort(F.collect_list(spot)).alias("s"))
    cell = lambda k: F.when(k % (d + 1) == 0, F.get("s", F.floor(k / (d + 1)).cast("int")).weight).otherwise(0.0)
    return lists.select(
        "part", F.col("s.middle").alias("centre"),
        F.transform(F.sequence(F.lit(0), F.lit(d * d - 1)), cell).alias("inverse"),
    )


def estimates(rows: DataFrame, scratch: Scratch, share: float = 0.75, steps: int = 5) -> DataFrame:
    """(part, centre, inverse): the estimate of every part of ``rows`` (part, x0, x1, ...).

    Each step measures all rows once. The closest ``share`` of a part is cut at a bin's edge, so
    ties stay together. ``factor`` makes the spread of that share that of all rows.
    """
    d = len(FLOORS)
    current = scratch.put(_start(rows), "step-0")
    factor = share / _chi2_cdf(chi2_quantile(share, d), d + 2)
    schema = "part string, bin int, n long, " + ", ".join(f"{s} double" for s in _SUMS)
    total = [F.sum(s).alias(s) for s in ("n", *_SUMS)]
    whole = Window.partitionBy("part")
    for k in range(steps):
        bins = rows.join(current, "part").mapInArrow(_binned, schema).groupBy("part", "bin").agg(*total)
        running = bins.withColumn("upto", F.sum("n").over(whole.orderBy("bin"))).withColumn("all", F.sum("n").over(whole))
        inside = running.where(F.col("upto") - F.col("n") < share * F.col("all"))
        moments = inside.groupBy("part").agg(*total).select("part", "n", *_SUMS)
        solved = moments.mapInArrow(solve(factor), "part string, centre array<double>, inverse array<double>")
        current = scratch.put(solved, f"step-{k + 1}")
        scratch.drop(f"step-{k}")
    return current


def _shrunk(prior: float):
    """Each group's estimate drawn towards its language's, and that towards the one of all, by their sizes."""
    d = len(FLOORS)

    def read(batch: pa.RecordBatch, level: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = batch.column(f"{level}_n").to_numpy().astype(float)
        inverse = _matrix(batch.column(f"{level}_inverse"), d * d).reshape(-1, d, d)
        return n / (n + prior), _matrix(batch.column(f"{level}_centre"), d), np.linalg.inv(inverse)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, centre, spread = read(batch, "all")
            for level in ("lang", "own"):
                weight, near, wide = read(batch, level)
                centre = weight[:, None] * near + (1 - weight)[:, None] * centre
                spread = weight[:, None, None] * wide + (1 - weight)[:, None, None] * spread
            doubles = pa.list_(pa.float64())
            arrays = [pa.array(list(centre), doubles), pa.array(list(np.linalg.inv(spread).reshape(-1, d * d)), doubles)]
            yield pa.RecordBatch.from_arrays([batch.column("own"), *arrays], ["part", "centre", "inverse"])

    return run


def verdicts(docs: DataFrame, prior: float = 200, tail: float = 1e-6, share: float = 0.75, steps: int = 5) -> DataFrame:
    """doc_id, the counts, base_failed, distance and kept for every row of ``docs``.

    There is an estimate for every language and source, whatever its size, one for every language,
    and one for all. A group of ``n`` passing texts counts ``n / (n + prior)`` against its language,
    and a language as much against all, so a verdict changes smoothly as a source grows. A text is
    rejected beyond the ``1 - tail`` quantile of the chi-square distribution.

    A null text counts as empty: no words, base_failed, not kept. Null languages and sources are
    values of their own. Rows that repeat are judged each; ties share a bin and so a side of every
    cut. A part whose texts are all alike is judged by the floors alone. An empty table gives an
    empty result; further columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.put(counts(docs), "counts").withColumn("base_failed", base_failed())
    name = lambda *columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    passing = rows.where(~F.col("base_failed"))
    own, lang = name("lang", "source").alias("own"), name("lang").alias("lang")
    placed = scratch.put(passing.select("doc_id", *COUNTS[:5], own, lang, *vector()), "vectors")
    levels = F.explode(F.array("own", "lang", F.lit("{}"))).alias("part")
    fitted = scratch.put(estimates(placed.select(levels, *AXES), scratch, share, steps), "estimates")
    groups = placed.groupBy("own", "lang").agg(F.count("*").alias("own_n"))
    sizes = groups.groupBy("lang").agg(F.sum("own_n").alias("lang_n"))

    def at(level: str) -> DataFrame:
        return fitted.select(F.col("part").alias(level), F.col("centre").alias(f"{level}_centre"), F.col("inverse").alias(f"{level}_inverse"))

    known = groups.join(sizes, "lang").join(at("own"), "own").join(at("lang"), "lang")
    whole = at("all").where("all = '{}'").drop("all").withColumn("all_n", F.lit(0).cast("long"))
    known = known.join(F.broadcast(whole))  # one row
    shrunk = known.mapInArrow(_shrunk(prior), "part string, centre array<double>, inverse array<double>")
    shrunk = scratch.put(shrunk, "shrunk")
    far = chi2_quantile(1 - tail, len(FLOORS))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distance = np.round(_measured(batch)[1], 6)
            columns = [batch.column(c) for c in ("doc_id", *COUNTS[:5])]
            columns += [pa.array([False] * batch.num_rows), pa.array(distance <= far), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, fields)

    fields = ["doc_id", *COUNTS[:5], "base_failed", "kept", "distance"]
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS[:5]) + ", base_failed boolean, kept boolean, distance double"
    good = placed.withColumnRenamed("own", "part").drop("lang").join(shrunk, "part").mapInArrow(judge, schema)
    bad = rows.where("base_failed").select(
        "doc_id", *COUNTS[:5], "base_failed", F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance")
    )
    return good.unionByName(bad)
