"""How far the sources of a language are from each other in their words.

Arrow kernels count terms inside ``mapInArrow``: lower-casing, splitting, dictionary encoding and a
hash group-by over each batch, merged within the task. Spark merges the counts of all tasks by
language and term and keeps the terms that enough documents of the language hold. The merged counts
are dealt into columnar shards by term; each shard adds up the divergences of all pairs of sources
over its terms and names its own most typical terms, and Spark merges the sums and the lists.

All arithmetic is on integers. A share ``p = 1 + floor(10^9 (count + 2) / (total + 2 V))`` is
divided in three steps of three digits, so that no product leaves 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daftar.llm.common import Scratch, slices
from daftar.operators.ranking import top_k

NOT_TERMS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, TOP_TERMS = 10, 10
_HELD = 400_000  # different terms of sources that a task holds before it hands them on
_SHARD = 400_000  # counts in a shard, about
_TILE = 256  # sources on one side of a shard
_CHUNK = 1 << 21  # counts laid out at once


def _one_batch(part: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of one batch of (lang, source, text)."""
    langs, sources = (pc.fill_null(part.column(k), "") for k in (0, 1))
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(part.column(2), "")), NOT_TERMS)
    rows, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
    some = pc.greater(pc.binary_length(words), 0)
    words = words.filter(some).dictionary_encode()
    table = pa.table({"row": rows.filter(some), "word": words.indices})
    in_row = table.group_by(["row", "word"]).aggregate([([], "count_all")])
    groups = pa.table({"lang": langs, "source": sources})
    found = groups.take(in_row["row"]).append_column("term", in_row["word"]).append_column("n", in_row["count_all"])
    merged = found.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ([], "count_all")])
    terms = words.dictionary.take(merged["term"].combine_chunks())
    return pa.table(
        {"lang": merged["lang"], "source": merged["source"], "term": terms, "n": merged["n_sum"], "docs": merged["count_all"]}
    )


def partial_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of one task's rows; handed on whenever they get many."""
    held: list[pa.Table] = []
    merged = 0

    def merge() -> pa.Table:
        table = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return table.rename_columns(["lang", "source", "term", "n", "docs"])

    for piece in (p for part in parts for p in slices(part, 4 << 20)):
        held.append(_one_batch(piece))
        if sum(t.num_rows for t in held[1:]) > max(merged, _HELD // 4):
            held = [merge()]
            merged = held[0].num_rows
            if merged > _HELD:
                yield from held[0].to_batches()
                held, merged = [], 0
    if held:
        yield from merge().to_batches()


def share(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """``1 + floor(10^9 (count + 2) / (total + 2 kept))``, exactly."""
    part, whole = count + 2, total + 2 * kept
    out = np.zeros(np.broadcast(part, whole).shape, np.int64)
    for _ in range(3):
        part = part * 1000
        out = out * 1000 + part // whole
        part = part % whole
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q)^2 / (p + q))``."""
    return (p - q) ** 2 // (p + q)


_OUT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _shard(counts: pa.Table, groups: pa.Table) -> pa.Table:
    """The sums and typical terms of one shard for the sources of two tiles, or of one.

    ``counts`` has (source, term, n, in_lang); ``groups`` every source of the tiles with (source,
    tile, total, lang_total, kept). Both are of one language. A kept term that no source of the
    tiles has adds the same distance to a pair wherever it lies, so the first shard adds that for all
    kept terms, and every shard only what its terms add beyond it.
    """
    names = np.array(groups["source"].to_pylist(), object)
    order = np.argsort(names.astype(str), kind="stable") if len(names) else np.empty(0, int)
    groups, names = groups.take(pa.array(order)), names[order]
    totals, tile = groups["total"].to_numpy(), groups["tile"].to_numpy()
    if not len(names):
        return _OUT.empty_table()
    lang, kept, lang_total = groups["lang"][0].as_py(), groups["kept"][0].as_py(), groups["lang_total"][0].as_py()
    alone = len(np.unique(tile)) == 1 and groups["a"][0] == groups["b"][0]
    encoded = counts["term"].combine_chunks().dictionary_encode()
    row = pc.index_in(counts["source"], pa.array(names, pa.string())).to_numpy()
    col, n, in_lang = encoded.indices.to_numpy(), counts["n"].to_numpy(), counts["in_lang"].to_numpy()
    sums = np.zeros((len(names), len(names)), np.int64)
    if kept:
        bare = share(np.zeros(len(names), np.int64), totals, kept)
        first = groups["shard"][0].as_py() == 0
        sums += distance(bare[:, None], bare[None, :]) * ((kept if first else 0) - len(encoded.dictionary))
    best: list[dict] = []
    width = max(1, _CHUNK // len(names))
    by_term = np.argsort(col, kind="stable")
    row, col, n, in_lang = row[by_term], col[by_term], n[by_term], in_lang[by_term]
    for at in range(0, len(encoded.dictionary), width):
        lo, hi = np.searchsorted(col, [at, at + width])
        wide = min(width, len(encoded.dictionary) - at)
        laid = np.zeros((len(names), wide), np.int64)
        laid[row[lo:hi], col[lo:hi] - at] = n[lo:hi]
        p = share(laid, totals[:, None], kept)
        for k in range(len(names)):
            others = np.arange(k + 1, len(names)) if alone else np.flatnonzero((tile > tile[k]))
            if len(others):
                sums[k, others] += distance(p[k], p[others]).sum(axis=1)
        if alone:
            mine = p[row[lo:hi], col[lo:hi] - at]
            usual = share(in_lang[lo:hi], np.int64(lang_total), kept)
            value = distance(mine, usual)
            typical = np.flatnonzero(mine > usual)
            for k in np.unique(row[lo:hi][typical]):
                own = typical[row[lo:hi][typical] == k]
                cut = np.sort(value[own])[-min(len(own), TOP_TERMS)]
                terms = encoded.dictionary.take(pa.array(col[lo:hi][own[value[own] >= cut]])).to_pylist()
                some = sorted(zip(-value[own[value[own] >= cut]], (t.encode() for t in terms), terms, strict=True))[:TOP_TERMS]
                best += [{"lang": lang, "source": names[k], "part": "term", "item": t, "value": int(-v)} for v, _, t in some]
    pairs = np.argwhere(np.triu(np.ones_like(sums), 1) if alone else tile[:, None] < tile[None, :])
    both = np.vstack([pairs, pairs[:, ::-1]])
    values = sums[np.minimum(both[:, 0], both[:, 1]), np.maximum(both[:, 0], both[:, 1])] if alone else np.concatenate([sums[tuple(pairs.T)]] * 2)
    text = pa.array(names, pa.string())
    size = len(both)
    table = pa.table(
        [pa.array([lang] * size, pa.string()), text.take(pa.array(both[:, 0])), pa.array(["pair"] * size, pa.string()),
         text.take(pa.array(both[:, 1])), pa.array(values, pa.int64())], schema=_OUT,
    )
    return pa.concat_tables([table, pa.Table.from_pylist(best, _OUT)])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, tile: int = _TILE, shard: int = _SHARD) -> DataFrame:
    """(lang, source, part, item, value, rank): what sets the sources of a language apart.

    A null text, lang or source is ''. A language keeps the terms that ``least_docs`` of its rows
    hold. Part ``pair`` has a row for each other source of the language, with the sum of the
    distances of all kept terms' shares, 0 where the language keeps none; part ``term`` has the
    source's ten kept terms that exceed their share in the language most. Ranks go by value
    descending, then by the item's bytes.

    Every row counts, repeated ones too, with or without an id. Sources without a term have pairs
    like any other. A language with one source has no pair; an empty table gives an empty result;
    further columns are not read. The pairs of a language are as many as its sources squared.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    texts = docs.select("lang", "source", "text")
    partial = texts.mapInArrow(partial_counts, "lang string, source string, term string, n long, docs long")
    # Dealt by language and term once; the sums by source and the window below keep that dealing.
    merged = partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    merged = merged.withColumn("in_lang", F.sum("n").over(whole)).withColumn("docs", F.sum("docs").over(whole))
    counts = scratch.put(merged.where(F.col("docs") >= least_docs).select("lang", "source", "term", "n", "in_lang"), "counts")

    named = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = counts.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    groups = docs.select(*named).distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"))
    groups = scratch.put(groups.withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang"))), "groups")
    shards = max(1, -(-counts.count() // shard))
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    tiles = max(1, -(-most // tile))

    def tiled(rows: DataFrame) -> DataFrame:
        """Each row to the tiles' pairs it takes part in."""
        rows = rows.withColumn("tile", F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int"))
        rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
        return rows.withColumn("a", F.least("tile", "_other")).withColumn("b", F.greatest("tile", "_other")).drop("_other")

    key = ["lang", "shard", "a", "b"]
    left = tiled(counts.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int")))
    right = tiled(groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        _shard, "lang string, source string, part string, item string, value long"
    )
    found = scratch.put(found, "shards")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    group = ["lang", "source", "part"]
    order = [F.col("value").desc(), F.col("item")]
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.unionByName(top_k(found.where("part = 'term'"), group, order, TOP_TERMS))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
     t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
     kept AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
     c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
     g AS MATERIALIZED (
       SELECT lang, source, coalesce(s.total, 0)::HUGEINT AS total, coalesce(k.v, 0)::HUGEINT AS v,
              (sum(coalesce(s.total, 0)) OVER (PARTITION BY lang))::HUGEINT AS lang_total
       FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) s USING (lang, source)
            LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) k USING (lang)),
     grid AS MATERIALIZED (
       SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (g.total + 2 * g.v) AS p,
              1 + (1000000000 * (sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, kept.term) + 2)::HUGEINT) // (g.lang_total + 2 * g.v) AS q
       FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
     f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
           FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     parts AS (
       SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
       FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
       UNION ALL
       SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM grid WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts) x
WHERE part = 'pair' OR rank <= 10
"""
