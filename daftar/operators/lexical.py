"""Full-text leg: queries against an index of chunks in blocks.

The index has one row for each block of about a thousand chunks: the block's terms with their
postings and, per term, the largest count a chunk of the block has. A row is never split, so a
block is scored where it lies: the index is not shuffled, and only each task's best hits per query
travel, however common a term is. Before a query is scored on a block, the block's largest counts
bound what any of its chunks can reach; a block below the running ``limit``-th score is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar import settings as S
from daftar.functions import text as T
from daftar.operators.ranking import check_limit, top_k

BLOCK_CHUNKS = 1024
INDEX_SCHEMA = (
    "block long, chunk_ids array<string>, terms array<string>, starts array<int>, chunks array<int>, counts array<int>, most array<int>"
)
# A row is some megabytes and a scan loads up to 4096 rows of a row group at once: these are few.
FILE_OPTIONS = {"parquet.block.row.count.limit": "8"}
# Weighted sums depend on the order of addition in their last bits; ten decimals make ties ties.
_DECIMALS = 10


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, question) -> (query_id, term, n_terms), one row per distinct term."""
    terms = queries.select("query_id", T.query_terms("question").alias("terms"))
    return terms.select("query_id", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))


def postings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, term, tf) of chunks (id, text_normalized), as plain rows."""
    docs = chunks.select(F.col("id").alias("chunk_id"), T.lexical_tokens("text_normalized").alias("terms"))
    # One row per chunk crosses the exchange; the sum below reuses its partitioning.
    docs = docs.repartition("chunk_id")
    words = docs.select("chunk_id", F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull())
    return words.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def _block(group: pa.Table) -> pa.Table:
    """The index row of one block of (chunk_id, terms)."""
    group = group.sort_by("chunk_id")  # local numbers go by chunk id, so that ties do
    lists = group["terms"].combine_chunks()
    chunk = pc.list_parent_indices(lists).to_numpy()
    words = pc.list_flatten(lists).dictionary_encode()
    order = pc.sort_indices(words.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    keys, counts = np.unique(place[words.indices.to_numpy()] * len(group) + chunk, return_counts=True)
    term = keys // max(1, len(group))
    starts = np.searchsorted(term, np.arange(len(order) + 1))
    most = np.maximum.reduceat(counts, starts[:-1]) if len(keys) else counts

    def ints(values: np.ndarray) -> pa.Array:
        return pa.array([values.astype(np.int32)], pa.list_(pa.int32()))

    return pa.table(
        {
            "chunk_ids": pa.array([group["chunk_id"].to_pylist()], pa.list_(pa.string())),
            "terms": pa.array([words.dictionary.take(order).to_pylist()], pa.list_(pa.string())),
            "starts": ints(starts), "chunks": ints(keys % max(1, len(group))), "counts": ints(counts), "most": ints(most),
        }
    )


def block_index(chunks: DataFrame, n_chunks: int | None = None, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """The index of chunks (id, text_normalized), one row a block. Write it with ``FILE_OPTIONS`` and search what was written.

    Chunks become blocks where they lie, up to ``block_chunks`` neighbours a block, so nothing is
    shuffled or sorted and a task holds one block; ids must be unique. A chunk without a token has no
    posting; a null index form counts as one. ``n_chunks`` is not needed any more.
    """
    tokens = F.coalesce(T.lexical_tokens("text_normalized"), F.array().cast("array<string>"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = -(-batch.num_rows // block_chunks)
            rows = -(-batch.num_rows // max(1, pieces))
            for at in range(0, batch.num_rows, max(1, rows)):
                yield from _block(pa.Table.from_batches([batch.slice(at, rows)])).to_batches()

    rows = chunks.select(F.col("id").cast("string").alias("chunk_id"), tokens.alias("terms"))
    found = rows.mapInArrow(blocks, INDEX_SCHEMA.removeprefix("block long, "))
    return found.select(F.monotonically_increasing_id().alias("block"), "*")


class _Asked:
    """A bounded block of queries: their terms as numbers, and each term's weight."""

    def __init__(self, local: pd.DataFrame, weights: dict[str, float] | None) -> None:
        self.ids = local["query_id"].to_numpy()
        lists = [[t for t in terms if weights is None or t in weights] for terms in local["terms"]]
        self.wanted = local["terms"].map(len).to_numpy()
        self.vocabulary = sorted({t for terms in lists for t in terms})
        number = {t: k for k, t in enumerate(self.vocabulary)}
        self.terms = [np.array([number[t] for t in terms], np.int64) for terms in lists]
        self.weights = np.array([1.0 if weights is None else weights[t] for t in self.vocabulary])


class _Hits:
    """The best hits of one query so far, and the score that a further one has to reach."""

    def __init__(self, limit: int) -> None:
        self.limit, self.floor = limit, -np.inf
        self.scores, self.names = np.empty(0), np.empty(0, "<U1")

    def add(self, scores: np.ndarray, names: np.ndarray) -> None:
        scores, names = np.concatenate([self.scores, scores]), np.concatenate([self.names, names])
        kept = np.lexsort((names, -np.round(scores, _DECIMALS)))[: self.limit]
        self.scores, self.names = scores[kept], names[kept]
        if len(kept) == self.limit:
            self.floor = round(float(self.scores[-1]), _DECIMALS)


def _score_block(row: dict[str, pa.Scalar], asked: _Asked, vocabulary: pa.Array, hits: list[_Hits], require_all: bool) -> int:
    """Score the queries on a block; how many (query, block) pairs the bound spared."""
    place = pc.fill_null(pc.index_in(vocabulary, value_set=row["terms"].values), -1).to_numpy()
    starts, chunks, counts, most = (row[c].values.to_numpy() for c in ("starts", "chunks", "counts", "most"))
    names = None
    spared = 0
    for q, (terms, best) in enumerate(zip(asked.terms, hits, strict=True)):
        at = place[terms]
        known = at >= 0
        if not known.any() or (require_all and not (known.all() and len(terms) == asked.wanted[q])):
            continue
        at, weight = at[known], asked.weights[terms[known]]
        bound = S.LEXICAL_POSITION_WEIGHT * float(most[at] @ weight)
        if bound * (1 + 1e-12) + 10.0**-_DECIMALS < best.floor:
            spared += 1
            continue
        lengths = starts[at + 1] - starts[at]
        take = np.repeat(starts[at] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        mass = np.bincount(chunks[take], counts[take] * np.repeat(weight, lengths))
        met = np.bincount(chunks[take])
        scores = mass * S.LEXICAL_POSITION_WEIGHT
        rounded = np.round(scores, _DECIMALS)
        good = np.flatnonzero((met == asked.wanted[q] if require_all else met > 0) & (rounded >= best.floor))
        if not len(good):
            continue
        if len(good) > best.limit:
            cut = np.partition(-rounded[good], best.limit - 1)[best.limit - 1]
            good = good[rounded[good] >= -cut]
            good = good[np.argsort(-rounded[good], kind="stable")[: best.limit]]  # equal ones go by chunk id
        if names is None:
            names = np.array(row["chunk_ids"].values.to_pylist())
        best.add(scores[good], names[good])
    return spared


def _frequencies(index: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many chunks hold each term; a row for each asked term leaves a task."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(shared.value, pa.string())
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for own, starts in zip(batch.column(0), batch.column(1), strict=True):
                place = pc.fill_null(pc.index_in(terms, value_set=own.values), -1).to_numpy()
                sizes = np.diff(starts.values.to_numpy())
                total[place >= 0] += sizes[place[place >= 0]]
        yield pa.RecordBatch.from_arrays([terms, pa.array(total)], ["term", "df"])

    found = index.select("terms", "starts").mapInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    table = found.where("df > 0").toArrow()  # no more rows than terms are asked
    return dict(zip(table["term"].to_pylist(), table["df"].to_pylist(), strict=True))


def _query_blocks(queries: DataFrame, rows: int) -> Iterator[pd.DataFrame]:
    """(query_id, terms) of the queries, at most about ``rows`` at a time."""
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), T.query_terms("question").alias("terms")).where(F.size("terms") > 0)
    blocks = max(1, -(-asked.count() // rows))
    for number in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number)
        yield mine.toPandas()


def lexical_search(
    index: DataFrame,
    queries: DataFrame,
    limit: int = S.RETRIEVE_DEPTH,
    idf: bool = False,
    require_all: bool = False,
    n_chunks: int | None = None,
    broadcast_rows: int = S.BROADCAST_ROWS,
) -> DataFrame:
    """Top hits per query over :func:`block_index`: (query_id, chunk_id, score, rank, source).

    Terms are OR-ed. With an OR query every matching position is its own minimal cover, so the
    cover-density rank is the position weight times the number of matching positions; that
    reduction lives here and nowhere else. ``idf`` weighs a term by ln(N / chunks containing it),
    where ``n_chunks`` is the number of all chunks; without it the index is asked for it.
    ``require_all`` keeps chunks that contain every term. Equal scores go by chunk id.

    Queries are broadcast in blocks of at most ``broadcast_rows`` terms, each with its own pass.
    """
    check_limit(limit)
    spark = index.sparkSession
    columns = ["chunk_ids", "terms", "starts", "chunks", "counts", "most"]
    found = []
    for local in _query_blocks(queries, max(1, broadcast_rows // S.MAX_QUERY_TOKENS)):
        weights = None
        if idf:
            total = index.agg(F.sum(F.size("chunk_ids"))).first()[0] if n_chunks is None else n_chunks
            held = _frequencies(index, sorted({t for terms in local["terms"] for t in terms}))
            weights = {t: float(np.log(total / df)) for t, df in held.items()}
        shared = spark.sparkContext.broadcast(_Asked(local, weights))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            vocabulary = pa.array(asked.vocabulary, pa.string())
            hits = [_Hits(limit) for _ in asked.ids]
            for batch in batches:
                for row in range(batch.num_rows):
                    _score_block({c: batch.column(k)[row] for k, c in enumerate(columns)}, asked, vocabulary, hits, require_all)
            sizes = [len(h.scores) for h in hits]
            names = np.concatenate([h.names for h in hits]) if hits else np.empty(0, "<U1")
            scores = np.concatenate([h.scores for h in hits]) if hits else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(asked.ids, sizes).astype(str)), pa.array(names), pa.array(scores, pa.float64())], ["query_id", "chunk_id", "score"]
            )

        found.append(index.select(*columns).mapInArrow(search, "query_id string, chunk_id string, score double"))
    scored = reduce(DataFrame.unionByName, found)
    order = [F.round("score", _DECIMALS).desc(), F.col("chunk_id")]
    return top_k(scored, ["query_id"], order, limit).withColumn("source", F.lit("lexical"))
