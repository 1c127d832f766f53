"""An inverted-list index over vectors: written once, searched exactly or approximately.

Spherical k-means cells are the inverted lists. Each row keeps its vector and, for approximate
search, the product-quantised residual to its cell's centroid: one byte for each of a few
sub-spaces. Rows are written sorted by cell, so that a search reads only the cells it asks for.

- Exact search scores each query's nearest cells first. The ``k``-th score found there is a floor;
  the cone of every other cell bounds its cosines from above, and cells below the floor are not read.
- Approximate search scans the codes (not the vectors) of the cells a query probes, keeps a few
  candidates per query, and scores those exactly. How many cells to probe is measured, not guessed:
  :func:`calibrate` takes vectors of the corpus and counts where their true neighbours lie.

Centroids and codebooks are fitted on a bounded sample; every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daftar import settings as S
from daftar.operators.dense import (
    BROADCAST_VALUES, HITS_SCHEMA, SLACK, Best, query_blocks, to_matrix, upper_cosine,
)
from daftar.operators.ranking import check_limit, top_k
from daftar.session import cut_lineage

SAMPLE, MOST_CELLS, CODES = 65_536, 4096, 256  # rows to fit on; inverted lists; entries of a codebook
_MASK, _LISTS = 32 << 20, 1 << 20  # queries of a block by cells, and by rows of their lists
_ROUNDS = 10


@dataclass(frozen=True)
class VectorIndex:
    """``rows`` (cell, id, vector, codes) as written; per cell its centroid, its smallest cosine to it, its
    number of rows and how far a code's vector is off at most; per sub-space a codebook."""

    rows: DataFrame
    centroids: np.ndarray
    least: np.ndarray
    sizes: np.ndarray
    off: np.ndarray
    books: np.ndarray

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    matrix = to_matrix(column)
    length = np.sqrt((matrix * matrix).sum(axis=1))
    return matrix / np.where(length > 0, length, 1)[:, None], length > 0


def _known(corpus: DataFrame, vector: str) -> DataFrame:
    rows = corpus.select(F.col("id").cast("string").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    # A zero vector has no direction and is in no list.
    return rows.where(F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0))


def _checked(rows: DataFrame, dim: int) -> DataFrame:
    wrong = F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size("vector").cast("string")))
    return rows.withColumn("vector", F.when(F.size("vector") != dim, wrong.cast("array<double>")).otherwise(F.col("vector")))


def _spherical(sample: DataFrame, cells: int, seed: int) -> np.ndarray:
    """Unit centroids; every round is one pass over the stored sample that sums its vectors by cell."""
    spark = sample.sparkSession
    drawn = sample.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(cells).toArrow()  # at most MOST_CELLS rows
    centroids, _ = _units(drawn["vector"].combine_chunks())
    for _ in range(_ROUNDS):
        shared = spark.sparkContext.broadcast(centroids)

        def sums(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            middle = shared.value
            total = np.zeros_like(middle)
            for part in parts:
                unit, _ = _units(part.column(0))
                np.add.at(total, (unit @ middle.T).argmax(axis=1), unit)
            hit = np.flatnonzero(np.abs(total).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hit), pa.array(list(total[hit]), pa.list_(pa.float64()))], ["cell", "total"]
            )

        parts = sample.select("vector").mapInArrow(sums, "cell long, total array<double>").toArrow()  # a row per cell and task
        total = np.zeros_like(centroids)
        if parts.num_rows:
            np.add.at(total, parts["cell"].to_numpy(), to_matrix(parts["total"].combine_chunks()))
        length = np.sqrt((total * total).sum(axis=1))
        moved = np.where(length[:, None] > 1e-12, total / np.maximum(length, 1e-12)[:, None], centroids)
        settled = np.abs(moved - centroids).max(initial=0) < 1e-6
        centroids = moved
        if settled:
            break
    return centroids


def _lloyd(points: np.ndarray, seed: int) -> np.ndarray:
    """A codebook of ``CODES`` entries for the points of one sub-space."""
    rng = np.random.default_rng(seed)
    book = points[rng.choice(len(points), CODES, replace=len(points) < CODES)]
    for _ in range(_ROUNDS):
        own = _nearest(points, book)
        total = np.zeros_like(book)
        np.add.at(total, own, points)
        count = np.bincount(own, minlength=CODES)
        book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
    return book


def _nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    half = (book * book).sum(axis=1) / 2
    out = np.empty(len(points), np.int64)
    for at in range(0, len(points), 8192):
        out[at : at + 8192] = (points[at : at + 8192] @ book.T - half).argmax(axis=1)
    return out


def _codebooks(sample: DataFrame, centroids: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """One task fits the codebook of one sub-space, on the bounded sample."""
    shared = sample.sparkSession.sparkContext.broadcast(centroids)
    width = centroids.shape[1] // parts

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = shared.value
        for batch in batches:
            unit, _ = _units(batch.column(0))
            rest = unit - middle[(unit @ middle.T).argmax(axis=1)]
            for part in range(parts):
                own = np.ascontiguousarray(rest[:, part * width : (part + 1) * width])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * width), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part)), lists], ["part", "rest"])

    def fit(group: pa.Table) -> pa.Table:
        book = _lloyd(to_matrix(group["rest"].combine_chunks()), seed)
        return pa.table({"part": group["part"][:1], "book": pa.array([book.ravel()], pa.list_(pa.float64()))})

    split = sample.select("vector").mapInArrow(residuals, "part long, rest array<double>")
    fitted = split.groupBy("part").applyInArrow(fit, "part long, book array<double>").toArrow().sort_by("part")
    return np.array(fitted["book"].to_pylist()).reshape(parts, CODES, width)


def write_index(
    corpus: DataFrame, path: str, vector: str = "embedding", cells: int | None = None, parts: int | None = None, seed: int = 7,
) -> VectorIndex:
    """Index every row of ``corpus`` (id, vector) that has a vector and a direction, below ``path``.

    ``cells`` is the square root of the number of rows by default, ``MOST_CELLS`` at most. A row of
    another length than the first one found fails the job. An empty corpus has an index with no rows.
    ``parts`` is half the dimensions by default: with fewer codes 100 candidates miss neighbours.
    """
    spark = corpus.sparkSession
    rows = _known(corpus, vector)
    count = rows.count()
    # About SAMPLE rows by a hash of the id, or all; only the fit reads them.
    share = max(1, count // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(share)) == 0)
    one = rows.select(F.size("vector").alias("n")).first()
    dim = one["n"] if one else parts or 1
    parts = parts or (dim // 2 if dim % 2 == 0 else dim)
    if dim % parts:
        raise ValueError(f"{dim} dimensions do not split into {parts} sub-spaces")
    _checked(sample, dim).write.mode("overwrite").parquet(f"{path}/sample")
    sample = spark.read.parquet(f"{path}/sample")
    cells = min(MOST_CELLS, max(1, round(count**0.5)) if cells is None else cells, max(1, sample.count()))
    centroids = _spherical(sample, cells, seed) if one else np.zeros((1, dim))
    books = _codebooks(sample, centroids, parts, seed) if one else np.zeros((parts, CODES, dim // parts))
    shared = spark.sparkContext.broadcast((centroids, books))
    width = dim // parts

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, tables = shared.value
        for batch in batches:
            unit, _ = _units(batch.column(1))
            near = unit @ middle.T
            cell = near.argmax(axis=1)
            rest = unit - middle[cell]
            codes = np.stack([_nearest(rest[:, p * width : (p + 1) * width], tables[p]) for p in range(parts)], axis=1).astype(np.uint8)
            cosines = pa.array(near[np.arange(len(cell)), cell])
            told = np.concatenate([tables[p][codes[:, p]] for p in range(parts)], axis=1)
            off = pa.array(np.sqrt(((rest - told) ** 2).sum(axis=1)))
            packed = pa.array([row.tobytes() for row in codes], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), batch.column(0), batch.column(1), packed, cosines, off], ["cell", "id", "vector", "codes", "cosine", "off"]
            )

    encoded = _checked(rows, dim).mapInArrow(encode, "cell long, id string, vector array<double>, codes binary, cosine double, off double")
    # A cell that holds much of the corpus is spread over several files by the range of (cell, id).
    encoded.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.mode("overwrite").parquet(f"{path}/rows")
    facts = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.min("cosine").alias("least"), F.count(F.lit(1)).alias("n"), F.max("off").alias("off")).toPandas()
    least, sizes, off = np.ones(cells), np.zeros(cells, np.int64), np.zeros(cells)
    least[facts["cell"]], sizes[facts["cell"]], off[facts["cell"]] = facts["least"], facts["n"], facts["off"]
    doubles = pa.list_(pa.float64())
    cell_rows = pa.table({"cell": pa.array(range(cells), pa.int64()), "centroid": pa.array(list(centroids), doubles), "least": least, "n": sizes, "off": off})
    book_rows = pa.table({"part": pa.array(range(parts), pa.int64()), "book": pa.array([b.ravel() for b in books], doubles)})
    for name, table in (("cells", cell_rows), ("books", book_rows)):
        spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index as :func:`write_index` left it; its centroids and codebooks are bounded and come to the driver."""
    cells = spark.read.parquet(f"{path}/cells").toPandas().sort_values("cell")
    books = spark.read.parquet(f"{path}/books").toPandas().sort_values("part")
    centroids = np.stack(cells["centroid"].to_list())
    tables = np.stack(books["book"].to_list()).reshape(len(books), CODES, -1)
    return VectorIndex(spark.read.parquet(f"{path}/rows"), centroids, cells["least"].to_numpy(), cells["n"].to_numpy(), cells["off"].to_numpy(), tables)


def _asked(index: VectorIndex, queries: DataFrame, values: int, block_rows: int, kept: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of the queries, in blocks that may be broadcast.

    A block's queries by cells and by the ``kept`` rows of their lists are bounded, too: that is what
    the driver and every task hold.
    """
    rows = queries.select(F.col("query_id").cast("string").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    rows = _checked(rows.where(F.col("vector").isNotNull()), index.dim)
    most = max(1, min(_MASK // len(index.centroids), _LISTS // kept))
    for local in query_blocks(rows, min(values, most * index.dim), min(block_rows, most)):
        if len(local):
            matrix = np.stack(local["vector"].to_list())
            length = np.sqrt((matrix * matrix).sum(axis=1))
            yield local["id"].to_numpy(str)[length > 0], matrix[length > 0] / length[length > 0, None]


def _by_rows(n: int, step: int = 1024) -> Iterator[slice]:
    """Pieces of a block: a mask of cells is one byte an entry, what it is made from several times eight."""
    for at in range(0, n, step):
        yield slice(at, at + step)


def _first(index: VectorIndex, unit: np.ndarray, limit: int) -> np.ndarray:
    """Which cells are each query's nearest that together hold ``limit`` rows."""
    first = np.zeros((len(unit), len(index.centroids)), bool)
    for some in _by_rows(len(unit)):
        order = np.argsort(-(unit[some] @ index.centroids.T), axis=1, kind="stable")
        before = np.cumsum(index.sizes[order], axis=1) - index.sizes[order]
        np.put_along_axis(first[some], order, before < limit, axis=1)
    return first


def _nearest_cells(index: VectorIndex, unit: np.ndarray, probes: int) -> np.ndarray:
    mask = np.zeros((len(unit), len(index.centroids)), bool)
    for some in _by_rows(len(unit)):
        order = np.argsort(-(unit[some] @ index.centroids.T), axis=1, kind="stable")
        np.put_along_axis(mask[some], order[:, :probes], True, axis=1)
    return mask


def _reach(index: VectorIndex, unit: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Which cells may hold a row that reaches a query's ``floor``."""
    out = np.zeros((len(unit), len(index.centroids)), bool)
    for some in _by_rows(len(unit)):
        out[some] = upper_cosine(unit[some] @ index.centroids.T, index.least[None, :]) >= floor[some, None]
    return out & (index.sizes > 0)[None, :]


def _floors(start: DataFrame, ids: np.ndarray, limit: int) -> np.ndarray:
    """The score of each query's ``limit``-th hit, where it has as many."""
    lowest = start.where(F.col("rank") == limit).select("query_id", "score").toPandas()
    place = {name: k for k, name in enumerate(ids)}
    floor = np.full(len(ids), -np.inf)
    floor[[place[q] for q in lowest["query_id"]]] = lowest["score"]
    return floor


def _of_cells(index: VectorIndex, wanted: np.ndarray) -> DataFrame:
    """Rows of the cells that any query wants; the reader skips the row groups of others."""
    if wanted.all():
        return index.rows
    return index.rows.where(F.col("cell").isin([int(c) for c in np.flatnonzero(wanted)]))


def _runs(cells: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Stretches of the same cell, as the rows are written; no longer than a few hundred rows."""
    edges = np.flatnonzero(np.diff(cells)) + 1
    for low, high in zip(np.r_[0, edges], np.r_[edges, len(cells)], strict=True):
        for at in range(low, high, 512):
            yield int(cells[low]), slice(at, min(at + 512, high))


def _scored(index: VectorIndex, ids: np.ndarray, unit: np.ndarray, mask: np.ndarray, floor: np.ndarray, k: int) -> DataFrame:
    """Exact top ``k`` of each query among the cells its row of ``mask`` names."""
    shared = index.rows.sparkSession.sparkContext.broadcast((ids, unit, np.packbits(mask.T, axis=1), floor))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit, bits, floor = shared.value
        best = Best(ids, unit, k, floor)
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, names = batch.column(0).to_numpy(), np.asarray(batch.column(1).to_pylist(), dtype=str)
            vectors, _ = _units(batch.column(2))
            for cell, part in _runs(cells):
                among = np.flatnonzero(np.unpackbits(bits[cell], count=len(ids)))
                if len(among):
                    order = np.argsort(names[part], kind="stable")
                    best.feed(names[part][order], vectors[part][order], among)
        yield best.rows()

    return _of_cells(index, mask.any(axis=0)).select("cell", "id", "vector").mapInArrow(scan, HITS_SCHEMA)


def exact_search(
    index: VectorIndex, queries: DataFrame, limit: int = S.RETRIEVE_DEPTH,
    broadcast_values: int = BROADCAST_VALUES, block_rows: int = S.BLOCK_ROWS,
) -> DataFrame:
    """The same hits as :func:`dense_search` over the indexed rows: (query_id, chunk_id, score, rank, source)."""
    check_limit(limit)
    order = [F.col("score").desc(), F.col("chunk_id")]
    found = []
    for ids, unit in _asked(index, queries, broadcast_values, block_rows, limit):
        first = _first(index, unit, limit)
        start = top_k(_scored(index, ids, unit, first, np.full(len(ids), -np.inf), limit), ["query_id"], order, limit)
        start = cut_lineage(start)  # read for the floors, and again for the result
        floor = _floors(start, ids, limit)
        rest = ~first & _reach(index, unit, floor)
        found += [start.drop("rank"), _scored(index, ids, unit, rest, floor - SLACK, limit)]
    if not found:
        found = [index.rows.limit(0).select(F.lit("").alias("query_id"), F.col("id").alias("chunk_id"), F.col("cosine").alias("score"))]
    hits = reduce(DataFrame.unionByName, found)
    return top_k(hits, ["query_id"], order, limit).withColumn("source", F.lit("dense"))


def calibrate(index: VectorIndex, corpus: DataFrame, limit: int = S.RETRIEVE_DEPTH, recall: float = 0.98, vector: str = "embedding", n: int = 256, seed: int = 11) -> int:
    """How many cells to probe so that this share of the true neighbours lies in them.

    Takes ``n`` vectors of the corpus as queries, searches them exactly, and counts how near the
    cells of their neighbours are. The sample is bounded; what it is searched in is everything.
    """
    drawn = _known(corpus, vector).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)
    queries = drawn.select(F.col("id").alias("query_id"), "vector")
    hits = exact_search(index, queries, limit + 1).where("query_id <> chunk_id").select("query_id", F.col("chunk_id").alias("id"))
    met = index.rows.select("id", "cell").join(F.broadcast(hits), "id").select("query_id", "cell").toPandas()  # n * limit rows
    if not len(met):
        return len(index.centroids)
    local = queries.toPandas().drop_duplicates("query_id").set_index("query_id")
    matrix = np.stack(local.loc[met["query_id"], "vector"].to_list())
    near = (matrix / np.sqrt((matrix * matrix).sum(axis=1))[:, None]) @ index.centroids.T
    own = near[np.arange(len(met)), met["cell"].to_numpy()]
    place = np.sort((near > own[:, None]).sum(axis=1))
    return int(place[min(len(place) - 1, int(np.ceil(recall * len(place))))]) + 1


def approximate_search(
    index: VectorIndex, queries: DataFrame, limit: int = S.RETRIEVE_DEPTH, probes: int = 16, rescored: int | None = None,
    broadcast_values: int = BROADCAST_VALUES, block_rows: int = S.BLOCK_ROWS, sure: int = 0,
) -> DataFrame:
    """Hits by exact cosine among the ``rescored`` best by code of the ``probes`` nearest cells; columns as in
    :func:`exact_search`, and ``candidates``, the number of rows a query's list was chosen from.

    Two passes over the cells that are probed: one reads codes, one the vectors of the candidates. The
    first ``sure`` hits of each query are exact: a cell outside the probed ones whose cone reaches
    them is searched, and so are the probed ones where a code may have been too far off.
    """
    check_limit(limit)
    rescored = 5 * limit if rescored is None else rescored
    parts, spark = len(index.books), index.rows.sparkSession
    width = index.dim // parts
    order = [F.col("score").desc(), F.col("chunk_id")]
    found = []
    for ids, unit in _asked(index, queries, broadcast_values, block_rows, rescored):
        mask = _nearest_cells(index, unit, probes)
        shared = spark.sparkContext.broadcast((unit, np.packbits(mask.T, axis=1), index.centroids, index.books))

        def propose(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            unit, bits, centroids, books = shared.value
            numbers = np.arange(len(unit)).astype(str)
            best = Best(numbers, unit, rescored)
            for batch in batches:
                if not batch.num_rows:
                    continue
                cells, names = batch.column(0).to_numpy(), np.asarray(batch.column(1).to_pylist(), dtype=str)
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, parts)
                # A code stands for a sub-vector, so the products with it are products with what it stands for.
                rest = np.concatenate([books[p][codes[:, p]] for p in range(parts)], axis=1)
                for cell, part in _runs(cells):
                    among = np.flatnonzero(np.unpackbits(bits[cell], count=len(unit)))
                    if len(among):
                        sort = np.argsort(names[part], kind="stable")
                        told = centroids[cell] + rest[part][sort]
                        best.meet(names[part][sort], told, among)
            yield best.rows()

        codes = _of_cells(index, mask.any(axis=0)).select("cell", "id", "codes")
        proposed = top_k(codes.mapInArrow(propose, HITS_SCHEMA), ["query_id"], order, rescored)
        if sure:
            proposed = cut_lineage(proposed)
        local = proposed.select(F.col("query_id").cast("int").alias("q"), "chunk_id").toArrow()  # bounded: queries of a block times ``rescored``
        names = local["chunk_id"].to_numpy(zero_copy_only=False).astype(str)
        sort = np.argsort(names, kind="stable")
        candidates = spark.sparkContext.broadcast((ids, unit, names[sort], local["q"].to_numpy()[sort]))

        def score(batches: Iterator[pa.RecordBatch], candidates=candidates) -> Iterator[pa.RecordBatch]:
            ids, unit, wanted, asking = candidates.value
            for batch in batches:
                names = np.asarray(batch.column(0).to_pylist(), dtype=str)
                low, high = np.searchsorted(wanted, names), np.searchsorted(wanted, names, side="right")
                hit = np.repeat(np.arange(len(names)), high - low)
                if not len(hit):
                    continue
                vectors, _ = _units(batch.column(1))
                at = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True) if b > a])
                cosines = np.round((vectors[hit] * unit[asking[at]]).sum(axis=1), 12)
                yield pa.RecordBatch.from_arrays([pa.array(ids[asking[at]].astype(str)), pa.array(names[hit]), pa.array(cosines)], ["query_id", "chunk_id", "score"])

        rated = _of_cells(index, mask.any(axis=0)).select("id", "vector").mapInArrow(score, HITS_SCHEMA)
        if not sure:
            found.append(rated)
            continue
        rated = cut_lineage(rated)
        floor = _floors(top_k(rated, ["query_id"], order, sure), ids, sure)
        last = _floors(proposed, np.arange(len(ids)).astype(str), rescored)  # no row outside the list has a better code
        doubted = last + index.off.max(initial=0) + SLACK >= floor
        more = _scored(index, ids, unit, (~mask | doubted[:, None]) & _reach(index, unit, floor), floor - SLACK, sure)
        both = rated.unionByName(more).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
        found.append(top_k(both, ["query_id"], order, rescored).drop("rank"))
    if not found:
        found = [index.rows.limit(0).select(F.lit("").alias("query_id"), F.col("id").alias("chunk_id"), F.col("cosine").alias("score"))]
    hits = reduce(DataFrame.unionByName, found)
    counted = hits.withColumn("candidates", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    return top_k(counted, ["query_id"], order, limit).withColumn("source", F.lit("dense"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall, candidates): the share of the exact hits that ``found`` has, and its largest list of candidates."""
    truth = exact.select("query_id", "chunk_id", F.lit(1).alias("_true"))
    met = truth.join(found.select("query_id", "chunk_id", "candidates"), ["query_id", "chunk_id"], "left")
    return met.agg(
        F.count_distinct("query_id").alias("queries"),
        (F.count("candidates") / F.count("_true")).alias("recall"),
        F.max("candidates").alias("candidates"),
    )
