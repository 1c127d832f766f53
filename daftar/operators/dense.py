"""Nearest neighbours by cosine, exactly.

One kernel multiplies a block of corpus vectors with a block of query vectors and keeps the best
``k`` per query, so pairs are never materialised as rows and the corpus is never shuffled: query
blocks of a bounded size go round as broadcasts, and only the best of each task travel. A block of
corpus vectors lies in a cone around its mean; queries whose cosine with the cone cannot reach
their running ``k``-th score skip the block. That pays where the table is laid out by similarity
(:mod:`daftar.operators.vector_index`) and costs one product with the mean where it is not.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar import settings as S
from daftar.operators.ranking import check_limit, top_k
from daftar.session import checkpoint_dir

# At most this many vector elements are broadcast at once (float64: eight bytes each).
BROADCAST_VALUES = 16_000_000
_TILE, _CONE, _ROWS_AT_ONCE = 1024, 512, 1024
_EXACT = 65_536  # scores that are taken exactly at once
# At most this many passes over a corpus, as long as their blocks may be broadcast.
MOST_PASSES = 64
# Scores order at this many decimals, so copies of a vector tie whichever block they fall in.
SCORE_DECIMALS = 12
# Added to an upper bound: more than rounding can take away from it.
SLACK = 1e-9

HITS_SCHEMA = "query_id string, chunk_id string, score double"


def cone(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """The mean direction of unit vectors and the smallest cosine one of them has with it."""
    middle = vectors.sum(axis=0)
    length = np.sqrt(middle @ middle)
    if length < 1e-12:
        return np.zeros(vectors.shape[1]), -1.0
    middle /= length
    return middle, float((vectors @ middle).min())


def upper_cosine(to_middle: np.ndarray, least) -> np.ndarray:
    """No vector of a cone has a larger cosine with a query than this, given the query's with the cone's middle."""
    away = np.arccos(np.clip(to_middle, -1, 1)) - np.arccos(np.clip(least, -1, 1))
    return np.cos(np.maximum(away, 0)) + SLACK


def _unit(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt((matrix * matrix).sum(axis=1))
    alive = length > 0
    return matrix[alive] / length[alive, None], alive


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 1))


class Best:
    """Running top ``k`` per query for one group of unit query vectors; ``floor`` is a score they reach anyway."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.scores = np.full((len(ids), k), -np.inf)
        self.names = np.full((len(ids), k), "", "<U1")
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.copy()
        self.skipped = self.met = 0

    def feed(self, names: np.ndarray, vectors: np.ndarray, among: np.ndarray | None = None) -> None:
        """Take in corpus vectors, sorted by name, for the queries numbered ``among`` or for all."""
        middle, least = cone(vectors)
        among = np.arange(len(self.ids)) if among is None else among
        near = upper_cosine(self.vectors[among] @ middle, least) >= self.floor[among]
        self.met, self.skipped = self.met + len(among), self.skipped + len(among) - int(near.sum())
        self.meet(names, vectors, among[near])

    def meet(self, names: np.ndarray, vectors: np.ndarray, among: np.ndarray) -> None:
        """Score vectors, sorted by name, with the queries numbered ``among`` and merge them with their lists.

        Products in single precision tell, but for their error, which scores reach a query's list; only those
        are taken exactly. Each is a sum of its own, so that copies of a vector have one score.
        """
        if not len(names):
            return
        single = vectors.astype(np.float32)
        error = 1.2e-7 * (vectors.shape[1] + 8) * max(1.0, float(np.sqrt((vectors * vectors).sum(axis=1)).max()))
        for at in range(0, len(among), _TILE):
            some = among[at : at + _TILE]
            asked = self.vectors[some]
            rough = asked.astype(np.float32) @ single.T
            line = self.floor[some] - error
            blank = np.flatnonzero(np.isneginf(line))
            if len(blank) and len(names) > self.k:
                line[blank] = np.partition(rough[blank], len(names) - self.k, axis=1)[:, len(names) - self.k] - 2 * error
            row, column = np.divmod(np.flatnonzero(rough >= (line - error)[:, None].astype(np.float32)), len(names))
            for low in range(0, len(row), _EXACT):
                part = slice(low, low + _EXACT)
                exact = np.round(np.einsum("ij,ij->i", asked[row[part]], vectors[column[part]]), SCORE_DECIMALS)
                reach = exact >= self.floor[some[row[part]]]
                self.take(names, exact[reach], row[part][reach], column[part][reach], some)

    def take(self, names: np.ndarray, scores: np.ndarray, row: np.ndarray, column: np.ndarray, some: np.ndarray) -> None:
        """Merge single scores, of the query ``some[row]`` with ``names[column]`` and sorted by ``row``, with the lists."""
        if names.dtype.itemsize > self.names.dtype.itemsize:
            self.names = self.names.astype(names.dtype)
        if not len(row):
            return
        count = np.bincount(row, minlength=len(some))
        own = np.flatnonzero(count)
        count = count[own]
        place = np.repeat(np.arange(len(own)), count), np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        found, called = np.full((len(own), count.max()), -np.inf), np.full((len(own), count.max()), "", self.names.dtype)
        found[place], called[place] = scores, names[column]
        mine = some[own]
        both, kept = np.hstack([self.scores[mine], found]), np.hstack([self.names[mine], called])
        self.scores[mine], self.names[mine] = _pick_named(both, kept, self.k)
        self.floor[mine] = np.maximum(self.floor[mine], self.scores[mine, -1])

    def rows(self) -> pa.RecordBatch:
        row, place = np.nonzero(np.isfinite(self.scores))
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[row].astype(str)), pa.array(self.names[row, place]), pa.array(self.scores[row, place])],
            ["query_id", "chunk_id", "score"],
        )


def _pick_named(scores: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``k`` columns per row by (score desc, name)."""
    order = np.argsort(-scores, axis=1, kind="stable")
    ranked = np.take_along_axis(scores, order, 1)
    # Names are slow to sort; only rows with equal scores need them.
    tied = np.flatnonzero(((ranked[:, 1:] == ranked[:, :-1]) & np.isfinite(ranked[:, 1:])).any(axis=1))
    order[tied] = np.lexsort((names[tied], -scores[tied]), axis=1)
    order = order[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)


def to_matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def query_blocks(queries: DataFrame, values: int, block_rows: int) -> Iterator[pd.DataFrame]:
    """The rows of ``queries`` (id, ..., vector) in blocks that may be broadcast: all of them if they hold
    at most ``values`` vector elements, else about ``block_rows`` at a time, by a hash of the id.

    Where that were more than ``MOST_PASSES`` blocks, they are as few or as large as a broadcast allows.
    Several blocks are written once, so that no block makes the queries again.
    """
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0)).alias("values")).first()
    if size["values"] <= values:
        yield queries.toArrow().to_pandas()
        return
    blocks = -(-size["n"] // block_rows)
    if blocks > MOST_PASSES:
        blocks = min(blocks, max(MOST_PASSES, -(-size["values"] // (values or BROADCAST_VALUES))))
    spark, path = queries.sparkSession, f"{checkpoint_dir(queries.sparkSession).rstrip('/')}/asked-{uuid.uuid4().hex}"
    numbered = queries.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    numbered.repartition("_block").write.partitionBy("_block").parquet(path)
    stored = spark.read.schema(numbered.schema).parquet(path)
    for number in range(blocks):
        yield stored.where(F.col("_block") == number).drop("_block").toArrow().to_pandas()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, so few at a time that their doubles and names stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
            yield batch.slice(at, _ROWS_AT_ONCE)


def _block_search(local: pd.DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """One pass of the corpus, where it lies, past a block of queries."""
    unit, alive = _unit(_stack(local["vector"]))
    ids, scopes = local["id"].to_numpy(str)[alive], local["scope"].to_numpy(str)[alive]
    shared = corpus.sparkSession.sparkContext.broadcast((ids, scopes, unit))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scopes, unit = shared.value
        best = {s: Best(ids[scopes == s], unit[scopes == s], k) for s in np.unique(scopes)}
        for batch in _pieces(batches) if best else ():
            names, where = (np.asarray(batch.column(i).to_pylist(), dtype=str) for i in (0, 1))
            vectors, alive = _unit(to_matrix(batch.column(2)))
            names, where = names[alive], where[alive]
            for scope, own in best.items():
                inside = np.flatnonzero(where == scope)
                for at in range(0, len(inside), _CONE):
                    some = inside[at : at + _CONE]
                    some = some[np.argsort(names[some], kind="stable")]
                    own.feed(names[some], vectors[some])
        for own in best.values():
            yield own.rows()

    return corpus.mapInArrow(search, HITS_SCHEMA)


def dense_search(
    corpus: DataFrame,
    queries: DataFrame,
    limit: int = S.RETRIEVE_DEPTH,
    vector: str = "embedding",
    dim: int | None = None,
    scope: list[str] | None = None,
    broadcast_values: int = BROADCAST_VALUES,
    block_rows: int = S.BLOCK_ROWS,
) -> DataFrame:
    """Exact top hits by (cosine desc, id): (query_id, chunk_id, score, rank, source).

    ``corpus`` has ``id`` and the vector column, ``queries`` has ``query_id`` and ``vector``. Rows
    with a NULL or zero vector are in no list. ``scope`` names columns both sides must share. A query
    side of more than ``broadcast_values`` vector elements goes round in blocks (:func:`query_blocks`).
    """
    check_limit(limit)
    shared = F.concat_ws("\u0001", *scope) if scope else F.lit("")
    left = queries.select(F.col("query_id").cast("string").alias("id"), shared.alias("scope"), F.col("vector"))
    right = corpus.select(F.col("id").cast("string").alias("id"), shared.alias("scope"), F.col(vector).alias("vector"))
    left, right = (side.where(F.col("vector").isNotNull()) for side in (left, right))
    if dim is not None:
        wrong = F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size("vector").cast("string")))
        checked = F.when(F.size("vector") != dim, wrong.cast("array<float>")).otherwise(F.col("vector"))
        left, right = (side.withColumn("vector", checked) for side in (left, right))
    blocks = [_block_search(local, right, limit) for local in query_blocks(left, broadcast_values, block_rows)]
    found = reduce(DataFrame.unionByName, blocks)
    order = [F.col("score").desc(), F.col("chunk_id")]
    return top_k(found, ["query_id"], order, limit).withColumn("source", F.lit("dense"))
