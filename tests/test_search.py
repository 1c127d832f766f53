"""Vector index and block index: exact paths against plain versions, bounds that hold, recall that is measured."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from daftar.functions import text as T
from daftar.operators import dense as D
from daftar.operators import lexical as L
from daftar.operators import vector_index as V

HITS = ("query_id", "rank", "chunk_id", "score")


def hits(df):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 7)) for r in df.select(*HITS).collect())


def vectors(spark, matrix, prefix="v"):
    rows = [(f"{prefix}{i}", [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, "id string, embedding array<double>")


def asked(df):
    return df.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


def clustered(rng, n, dim=16, centres=12):
    middle = rng.normal(size=(centres, dim))
    out = middle[rng.integers(centres, size=n)] + 0.15 * rng.normal(size=(n, dim))
    out[: n // 3] = out[0]  # a third of the corpus is one vector
    return out


# --- dense -----------------------------------------------------------------------------------------


def test_cones_bound_cosines_from_above():
    rng = np.random.default_rng(1)
    for spread in (0.01, 0.3, 3.0):
        unit = rng.normal(size=16) + spread * rng.normal(size=(300, 16))
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        queries = rng.normal(size=(200, 16))
        queries /= np.linalg.norm(queries, axis=1)[:, None]
        middle, least = D.cone(unit)
        assert (D.upper_cosine(queries @ middle, least) >= (queries @ unit.T).max(axis=1)).all()
    assert D.cone(np.array([[1.0, 0.0], [-1.0, 0.0]]))[1] == -1.0


def test_bounds_skip_blocks_and_lose_nothing():
    rng = np.random.default_rng(2)
    matrix = clustered(rng, 4000)
    matrix = matrix[np.argsort(matrix @ rng.normal(size=16))]
    unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    names = np.array([f"{i:05d}" for i in range(len(unit))])
    best = D.Best(np.arange(30).astype(str), unit[:30], 5)
    for at in range(0, 4000, 200):
        best.feed(names[at : at + 200], unit[at : at + 200])
    scores = np.round(unit[:30] @ unit.T, D.SCORE_DECIMALS)
    for k in range(30):
        order = np.lexsort((names, -scores[k]))[:5]
        assert best.names[k].tolist() == names[order].tolist()
    assert best.skipped > 0.2 * best.met


def test_corpus_is_not_shuffled(spark):
    corpus = vectors(spark, np.random.default_rng(3).normal(size=(50, 4)))
    plan = D.dense_search(corpus, asked(corpus), 3, broadcast_values=0, block_rows=20)._jdf.queryExecution().executedPlan().toString()
    below = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert len(below) >= 3  # one pass for each block of queries
    # What is exchanged are the lists of the tasks, never vectors.
    assert all("vector" not in line for line in plan.splitlines() if "Exchange" in line)


@pytest.mark.parametrize("search", ["scan", "blocks", "index"])
def test_wrong_dimensions_fail(spark, tmp_path, search):
    corpus, odd = vectors(spark, np.eye(4)), spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    with pytest.raises(Exception, match="expected 4 dimensions, got 2"):
        if search == "index":
            V.exact_search(V.write_index(corpus, str(tmp_path / "i"), parts=2), odd).collect()
        else:
            D.dense_search(corpus, odd, 2, dim=4, broadcast_values=0 if search == "blocks" else D.BROADCAST_VALUES).collect()
    mixed = corpus.unionByName(odd.select(F.col("query_id").alias("id"), F.col("vector").alias("embedding")))
    with pytest.raises(Exception, match="expected . dimensions, got"):
        V.write_index(mixed, str(tmp_path / "m"), parts=2)


def test_index_search_is_exact_and_reads_few_cells(spark, tmp_path):
    rng = np.random.default_rng(4)
    corpus = vectors(spark, clustered(rng, 900))
    corpus = corpus.unionByName(spark.createDataFrame([("zero", [0.0] * 16), ("none", None)], "id string, embedding array<double>"))
    index = V.write_index(corpus, str(tmp_path / "index"), cells=15, parts=4)
    assert index.rows.count() == 900 and index.sizes.sum() == 900
    queries = asked(corpus.where("id rlike 'v[0-9]*7$' OR id = 'zero' OR id = 'none'"))
    want = hits(D.dense_search(corpus, queries, 6))
    assert hits(V.exact_search(index, queries, 6)) == want
    assert hits(V.exact_search(index, queries, 6, broadcast_values=0, block_rows=20)) == want
    again = V.read_index(spark, str(tmp_path / "index"))
    assert hits(V.exact_search(again, queries, 6)) == want
    assert V.exact_search(index, queries.limit(0), 6).count() == 0


def test_codes_propose_and_cosines_decide(spark, tmp_path):
    rng = np.random.default_rng(5)
    corpus = vectors(spark, rng.normal(size=(1500, 32)))  # without any clusters: the hard case
    index = V.write_index(corpus, str(tmp_path / "index"), parts=8)
    queries = asked(vectors(spark, rng.normal(size=(60, 32)), "q"))
    probes = V.calibrate(index, corpus, 10, n=100)
    assert len(index.centroids) // 3 < probes <= len(index.centroids)
    found, exact = V.approximate_search(index, queries, 10, probes, 100), V.exact_search(index, queries, 10)
    measured = V.recall(found, exact).first()
    assert measured.queries == 60 and measured.candidates <= 100 and measured.recall >= 0.95
    scores = {(r.query_id, r.chunk_id): r.score for r in D.dense_search(corpus, queries, 1500).collect()}
    assert all(abs(scores[r.query_id, r.chunk_id] - r.score) < 1e-9 for r in found.collect())


def test_calibration_finds_that_clusters_need_few_cells(spark, tmp_path):
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(20, 16))
    corpus = vectors(spark, np.repeat(middle, 60, axis=0) + 0.05 * rng.normal(size=(1200, 16)))
    index = V.write_index(corpus, str(tmp_path / "index"), cells=20, parts=4)
    assert V.calibrate(index, corpus, 10, n=100) <= 5


def test_empty_index(spark, tmp_path):
    corpus = spark.createDataFrame([], "id string, embedding array<double>")
    index = V.write_index(corpus, str(tmp_path / "index"), parts=4)
    queries = spark.createDataFrame([("q", [1.0] * 4)], "query_id string, vector array<double>")
    assert V.exact_search(index, queries).count() == 0 and V.approximate_search(index, queries).count() == 0


# --- lexical ---------------------------------------------------------------------------------------


def plain_lexical(spark, chunks, queries, limit, idf=False, require_all=False):
    tokens = {r.id: r.t for r in chunks.select("id", T.lexical_tokens("text_normalized").alias("t")).collect()}
    counted = {i: Counter(t or []) for i, t in tokens.items()}
    df = Counter(t for c in counted.values() for t in c)
    out = []
    for row in queries.select("query_id", T.query_terms("question").alias("t")).collect():
        scored = []
        for i, own in counted.items():
            met = [t for t in row.t or [] if own[t]]
            if met and (not require_all or len(met) == len(row.t)):
                mass = sum(own[t] * (np.log(len(counted) / df[t]) if idf else 1.0) for t in met)
                scored.append((-round(0.1 * mass, 10), i))
        out += [(row.query_id, rank, i, round(float(-s), 7) + 0.0) for rank, (s, i) in enumerate(sorted(scored)[:limit], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)] + ["the"] * 1500
    rows = [(f"c{i}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for i in range(700)]
    rows += [(f"same{i}", "the w1 w2 the") for i in range(60)] + [("null", None), ("blank", "")]
    asked = [(f"q{i}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 8)))) for i in range(40)]
    asked += [("stop", "the"), ("nowhere", "zzz"), ("half", "the zzz"), ("empty", ""), ("none", None)]
    return spark.createDataFrame(rows, "id string, text_normalized string"), spark.createDataFrame(asked, "query_id string, question string")


@pytest.mark.parametrize("options", [{}, {"idf": True}, {"require_all": True}, {"idf": True, "require_all": True}])
@pytest.mark.parametrize("broadcast_rows", [200_000, 400])
def test_block_search_agrees_with_plain_version(spark, corpus, options, broadcast_rows):
    chunks, queries = corpus
    index = L.block_index(chunks, block_chunks=64)
    found = hits(L.lexical_search(index, queries, 7, broadcast_rows=broadcast_rows, **options))
    assert found == plain_lexical(spark, chunks, queries, 7, **options)


def test_blocks_below_the_bound_are_spared(spark, corpus):
    chunks, queries = corpus
    blocks = L.block_index(chunks.orderBy(F.length("text_normalized").desc()), block_chunks=16).toArrow().to_batches()
    local = queries.select("query_id", T.query_terms("question").alias("terms")).where("size(terms) > 0").toPandas()
    asked = L._Asked(local, None)
    import pyarrow as pa

    found = [L._Hits(3) for _ in asked.ids]
    names = ["chunk_ids", "terms", "starts", "chunks", "counts", "most"]
    spared = 0
    for batch in blocks:
        for k in range(batch.num_rows):
            spared += L._score_block({c: batch.column(c)[k] for c in names}, asked, pa.array(asked.vocabulary), found, False)
    assert spared > 20


def test_index_is_searched_without_an_exchange_below_the_lists(spark, corpus, tmp_path):
    chunks, queries = corpus
    L.block_index(chunks).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    plan = L.lexical_search(index, queries, 5)._jdf.queryExecution().executedPlan().toString()
    after = plan[plan.index("MapInArrow") :]
    assert "Exchange" not in after
    assert L.lexical_search(index, queries.limit(0), 5).count() == 0
    empty = L.block_index(chunks.limit(0))
    assert L.lexical_search(empty, queries, 5).count() == 0 and L.lexical_search(empty, queries, 5, idf=True).count() == 0


def test_index_is_built_without_an_exchange_in_small_row_groups(spark, corpus, tmp_path):
    import pyarrow.parquet as pq

    chunks, queries = corpus
    built = L.block_index(spark.createDataFrame(chunks.collect() * 30, chunks.schema).coalesce(1).withColumn("id", F.concat("id", F.lit("-"), F.monotonically_increasing_id().cast("string"))), block_chunks=64)
    assert "Exchange" not in built._jdf.queryExecution().executedPlan().toString()
    built.write.options(**L.FILE_OPTIONS).parquet(str(tmp_path / "index"))
    groups = [f.metadata.row_group(i).num_rows for f in map(pq.ParquetFile, (tmp_path / "index").glob("*.parquet")) for i in range(f.metadata.num_row_groups)]
    index = spark.read.parquet(str(tmp_path / "index"))
    assert max(groups) <= 8 < sum(groups) and sum(groups) == index.select("block").distinct().count()
    assert index.agg(F.sum(F.size("chunk_ids"))).first()[0] == 30 * chunks.count()
    assert index.agg(F.max(F.size("chunk_ids"))).first()[0] <= 64


def test_hybrid_lists_are_fused_list_by_list(spark):
    """Several hybrid lists of one question: each is fused from its legs first, then the lists are."""
    from daftar import settings as S
    from daftar.plans import retrieval as R

    words = [f"w{i}" for i in range(12)]
    rng = random.Random(3)
    chunks = spark.createDataFrame([(f"c{i:02d}", " ".join(rng.choices(words, k=9))) for i in range(60)], "id string, text_normalized string")
    near = np.random.default_rng(3).normal(size=(60, 4))
    corpus = spark.createDataFrame([(f"c{i:02d}", [float(x) for x in v]) for i, v in enumerate(near)], "id string, emb_e5 array<double>")
    searches = {"q": ["w1 w2 w3", "w1 w5"], "r": ["w4 w6"]}
    plans = spark.createDataFrame([(q, some) for q, some in searches.items()], "query_id string, search_queries array<string>")
    texts = [s for some in searches.values() for s in some]
    vectors = spark.createDataFrame([(s, [float(x) for x in near[7 * i]]) for i, s in enumerate(texts)], "question string, vector array<double>")
    config = S.RetrievalConfig.named("hybrid", model_key="e5", depth=10)
    index = L.block_index(chunks)
    found = R.retrieve(plans, config, index=index, corpus=corpus, vectors=vectors, dim=4)

    def fused(lists):
        score = Counter()
        for one in lists:
            for rank, c in enumerate(one, 1):
                score[c] += 1 / (S.RRF_K + rank)
        return [c for c, _ in sorted(score.items(), key=lambda x: (-round(x[1], 12), x[0]))[:10]]

    for query, some in searches.items():
        lists = []
        for s in some:
            i = texts.index(s)
            one = spark.createDataFrame([("x", s)], "query_id string, question string")
            lexical = [r.chunk_id for r in L.lexical_search(index, one, 10).orderBy("rank").collect()]
            unit = near / np.linalg.norm(near, axis=1)[:, None]
            scores = np.round(unit @ unit[7 * i], 12)
            dense = [f"c{k:02d}" for k in np.lexsort((np.arange(60), -scores))[:10]]
            lists.append(fused([dense, lexical]))
        want = lists[0] if len(lists) == 1 else fused(lists)
        assert [r.chunk_id for r in found.where(F.col("query_id") == query).orderBy("rank").collect()] == want


def test_first_hits_are_sure_and_blocks_are_bounded(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(12)
    corpus = vectors(spark, rng.normal(size=(900, 16)))
    queries = asked(vectors(spark, rng.normal(size=(70, 16)), "q"))
    index = V.write_index(corpus, str(tmp_path / "index"), cells=30)
    assert len(index.books) == 8 and (index.off > 0).any()
    want = D.dense_search(corpus, queries, 20)
    # Three cells and three candidates lose most neighbours; the first two hits are right all the same.
    found = V.approximate_search(index, queries, 3, probes=3, rescored=3, sure=2)
    assert hits(found.where("rank <= 2")) == hits(want.where("rank <= 2"))
    assert found.agg(F.max("candidates")).first()[0] <= 3
    monkeypatch.setattr(V, "_MASK", 30 * 25)
    sizes = [len(ids) for ids, _ in V._asked(index, queries, D.BROADCAST_VALUES, 20_000, 20)]
    assert sum(sizes) == 70 and len(sizes) > 1 and max(sizes) < 60
    assert hits(V.exact_search(index, queries, 20)) == hits(want)


def test_passes_are_bounded_and_queries_made_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(D, "MOST_PASSES", 4)
    rows = vectors(spark, np.random.default_rng(13).normal(size=(60, 4))).withColumnRenamed("embedding", "vector")
    counted = rows.mapInArrow(seen, rows.schema)
    blocks = list(D.query_blocks(counted, 0, 2))
    assert len(blocks) == 4 and sum(map(len, blocks)) == 60
    assert made.value <= 2 * 60  # once to be counted, once to be written


def test_payload_of_few_hits_shuffles_no_text(spark):
    from daftar.operators.ranking import with_payload

    chunks = spark.range(3000).select(
        F.concat(F.lit("c"), "id").alias("id"), F.lit("d").alias("doc_id"), F.lit(None).cast("string").alias("article"), F.repeat(F.lit("x"), 50).alias("text")
    )
    hits = spark.range(500).select(F.concat(F.lit("q"), F.col("id") % 7).alias("query_id"), F.concat(F.lit("c"), F.col("id") % 90).alias("chunk_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    few, many = with_payload(hits, chunks), with_payload(hits, chunks, broadcast_rows=10)
    plans = [p._jdf.queryExecution().executedPlan().toString() for p in (few, many)]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning" not in plans[0] and "Exchange hashpartitioning" in plans[1]
    assert few.count() == 500 and few.exceptAll(many).isEmpty()


def test_gold_is_found_once_for_all_cells(spark):
    from daftar.catalog.base import Tables

    tables = Tables(spark, "/root/testdata/sf0.001")
    plan = tables.qrels._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_few_scores_are_taken_exactly(monkeypatch):
    import numpy as np

    from daftar.operators.dense import Best

    rng = np.random.default_rng(23)
    vectors = rng.normal(size=(3000, 16))
    vectors[2000:2100] = vectors[:100]  # copies, in other blocks
    vectors /= np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    names, asked = np.array([f"v{i:04}" for i in range(3000)]), vectors[::7] + vectors[1::7][: len(vectors[::7])]
    asked /= np.sqrt((asked * asked).sum(axis=1))[:, None]
    taken, take = [], Best.take
    monkeypatch.setattr(Best, "take", lambda self, names, scores, *rest: (taken.append(np.size(scores)), take(self, names, scores, *rest)))
    best = Best(np.arange(len(asked)).astype(str), asked, 5)
    for at in range(0, 3000, 300):
        best.feed(names[at : at + 300], vectors[at : at + 300])
    scores = np.round(asked @ vectors.T, 12)
    want = [sorted(range(3000), key=lambda i: (-round(row[i], 9), names[i]))[:5] for row in scores]
    assert [list(row) for row in best.names] == [list(names[row]) for row in want]
    assert np.abs(best.scores - np.array([scores[q][row] for q, row in enumerate(want)])).max() < 1e-11
    assert sum(taken) < 0.03 * scores.size
