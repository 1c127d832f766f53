"""Retrieval, metric, cache and admission fixtures, and brute-force checks for what SQL cannot say."""

import random
import time
from collections import deque
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from daftar import settings as S
from daftar.operators import audits as A
from daftar.operators import cache as K
from daftar.operators import dense as D
from daftar.operators import evaluation as M
from daftar.operators import fusion as X
from daftar.operators import ledger as G
from daftar.operators import planning as P
from daftar.operators import refusal as Z
from daftar.sources import labelled as L
from daftar.sources import tables as U

SF = "/root/testdata/sf0.001"


def test_rrf(spark):
    rows = [("q", 0, 1, "a"), ("q", 0, 2, "b"), ("q", 1, 1, "b"), ("q", 1, 2, "c"), ("q", 2, 1, "d"), ("r", 0, 1, "z")]
    lists = spark.createDataFrame(rows, "query_id string, list_id int, rank int, chunk_id string")
    fused = [(r.query_id, r.chunk_id, r.score) for r in X.rrf_fuse(lists).orderBy("query_id", "rank").collect()]
    assert [f[1] for f in fused] == ["b", "a", "d", "c", "z"]
    assert fused[0][2] == 1 / 62 + 1 / 61
    again = X.rrf_fuse(lists.repartition(7)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, r.score) for r in again] == fused
    with pytest.raises(ValueError):
        X.rrf_fuse(lists, k=0)


def test_fit_context_is_a_prefix(spark):
    hits = spark.createDataFrame(
        [("q", i, f"c{i}", None, "x" * n) for i, n in enumerate((90, 3000, 30), 1)],
        "query_id string, rank int, chunk_id string, article string, text string",
    )
    assert [r.rank for r in X.fit_context(hits, 700).collect()] == [1]
    assert X.fit_context(hits, 520).count() == 0


def test_metrics(spark):
    pairs = spark.createDataFrame([("a", "msa", "d"), ("b", "gulf", "d"), ("c", "gulf", "e")], "query_id string, dialect_tag string, source_doc string")
    qrels = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "9")], "query_id string, chunk_id string")
    hits = spark.createDataFrame([("a", "2", 2), ("a", "2", 5), ("a", "1", 4), ("b", "3", 1), ("c", "1", 1)], "query_id string, chunk_id string, rank int")
    got = {r.query_id: r for r in M.per_query(pairs, hits, qrels).collect()}
    assert set(got) == {"a", "b"}  # an unanswerable pair has no metrics
    assert (got["a"]["recall@3"], got["a"]["recall@10"], got["a"]["mrr"], got["b"]["mrr"]) == (0.5, 1.0, 0.5, 0.0)
    levels = {(r.level, r.value): r.n for r in M.aggregate(M.per_query(pairs, hits, qrels)).collect()}
    assert levels == {("all", ""): 2, ("dialect_tag", "msa"): 1, ("dialect_tag", "gulf"): 1, ("source_doc", "d"): 2}


def test_gate(spark):
    shape = "level string, value string, n long, `recall@3` double, `recall@10` double, `hit@3` double, `hit@10` double, mrr double"
    base = [("all", "", 5, 0.5, 0.80, 1.0, 1.0, 0.5), ("source_doc", "d", 3, 0.5, 0.80, 1.0, 1.0, 0.5), ("source_doc", "gone", 2, 0.5, 0.8, 1.0, 1.0, 0.5)]
    now = [("all", "", 6, 0.4, 0.78, 1.0, 1.0, 0.5), ("source_doc", "d", 3, 0.5, 0.74, 1.0, 1.0, 0.5), ("source_doc", "new", 2, 0.5, 0.8, 1.0, 1.0, 0.5)]
    checked = M.gate(spark.createDataFrame(now, shape), spark.createDataFrame(base, shape))
    verdicts = {(r.value, r.metric): r.verdict for r in checked.collect()}
    assert verdicts["", "recall@10"] == "pass"  # a drop of exactly the tolerance
    assert verdicts["", "n"] == "warning: other pairs" and verdicts["", "mrr"] == "context"
    assert verdicts["d", "recall@10"] == "fail"
    assert verdicts["gone", "recall@10"] == "fail: missing now" and verdicts["new", "recall@10"] == "new"
    assert not M.gate_passed(checked).first().passed


def test_cache_takes_the_nearest_only(spark):
    cache = spark.createDataFrame(
        [
            ("1", "بعد 3 سنوات", [1.0, 0.0], "bge", "p", "near", "[]", "2024-01-01"),
            ("2", "بعد 5 سنوات", [0.99, 0.1], "bge", "p", "second", "[]", "2024-01-01"),
            ("3", "بعد 5 سنوات", [1.0, 0.0], "e5", "p", "other model", "[]", "2024-01-01"),
        ],
        "id string, query_normalized string, embedding array<float>, model_key string, pipeline_key string, answer string, citations string, created_at string",
    )
    ask = spark.createDataFrame(
        [("q1", "بعد 5 سنوات", [1.0, 0.0], "bge", "p"), ("q2", "بعد ٣ سنوات", [1.0, 0.0], "bge", "p"), ("q3", "بعد 3 سنوات", [1.0, 0.0], "bge", "x")],
        "query_id string, question string, vector array<float>, model_key string, pipeline_key string",
    )
    got = {r.query_id: r.answer for r in K.lookup(ask, cache, dim=2, now="2024-01-02").collect()}
    assert got == {"q2": "near"}
    with pytest.raises(ValueError):
        K.check_model("openai")


def test_dense_paths_agree_with_copies(spark):
    """A third of the corpus is one vector; both physical paths return the same exact lists."""
    rows = spark.range(600).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.cos(F.col("id")), F.sin(F.col("id")))).cast("array<float>").alias("embedding"),
    )
    queries = rows.where("id < 40").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    a = D.dense_search(rows, queries, 7).select("query_id", "rank", "chunk_id")
    b = D.dense_search(rows.repartition(5), queries, 7, broadcast_values=0, block_rows=50).select("query_id", "rank", "chunk_id")
    assert a.exceptAll(b).count() == 0 and a.count() == 280


def brute_admission(times, limit, span):
    kept, out = deque(), []
    for at in times:
        while kept and at - kept[0] >= span:
            kept.popleft()
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(at)
    return out


@pytest.mark.parametrize("limit,span", [(1, 1800), (3, 3600), (5, 24 * 3600)])
def test_admission_matches_brute_force_on_one_hot_key(spark, limit, span):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("k", F.lit("all"))
    got = {r.event_id: r.accepted for r in G.sliding_window_admission(events, limit, span, key="k").collect()}
    ordered = events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).orderBy("us", "event_id").collect()
    want = brute_admission([r.us for r in ordered], limit, span * 1_000_000)
    assert [got[r.event_id] for r in ordered] == want


@pytest.mark.parametrize("limit,span,keys", [(3, 3600, 1), (2, 900, 2), (1, 60, 1)])
def test_admission_of_a_key_without_pause_runs_in_pieces(spark, limit, span, keys):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("k", F.col("event_id") % keys)
    # dense: the month in a few hours, several requests at one time
    events = events.withColumn("ts", F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 100_000_000) * 1_000_000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = G.sliding_window_admission(events, limit, span, key="k", piece_rows=50)
    rows = found.withColumn("part", F.spark_partition_id()).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r.event_id: r.accepted for r in rows}
    us = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    for k in range(keys):
        ordered = events.where(F.col("k") == k).select("event_id", us).orderBy("us", "event_id").collect()
        assert [got[r.event_id] for r in ordered] == brute_admission([r.us for r in ordered], limit, span * 1_000_000)
    assert len(got) == len(rows) == events.count()
    # one task had every request of a key before
    assert len({r.part for r in rows if r.event_id % keys == 0}) > 1


def test_daily_admission_agrees_with_the_walk(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    holds = events.select("event_id", "ts", F.col("event_id").alias("request_id"), F.lit("reserve").alias("kind"), F.col("value").alias("usd"))
    for cap in (50.0, 700.0, 1e9):
        walked = G.spend_admission(holds, cap).join(holds.select("event_id", F.to_date("ts").cast("string").alias("date")), "event_id")
        want = {r.date: r.n for r in walked.groupBy("date").agg(F.count_if("accepted").alias("n")).collect()}
        got = {r.date: r.accepted for r in G.daily_admission(holds, cap).collect()}
        assert got == want


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_near_duplicates_match_brute_force(spark, threshold):
    words = ["a", "b", "c", "d", "e"]
    texts = [" ".join(w for j, w in enumerate(words) if i >> j & 1) for i in range(32)] + ["a b c"] * 20
    rows = spark.createDataFrame([(f"{i:03d}", t) for i, t in enumerate(texts)], "query_id string, question string")
    total = A.near_duplicates(rows, threshold).agg(F.sum("pairs")).first()[0]
    sets = [set(t.split()) for t in texts]
    want = sum(
        1 for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold
    )
    assert total == want


def test_refusal_edges(spark):
    def scored(rows):
        return spark.createDataFrame(rows, "pair_id string, answerable boolean, top_score double")

    separable = scored([("a", True, 0.9), ("b", True, 0.8), ("c", False, 0.1)])
    assert Z.auc(separable).first().auc == 1.0
    assert Z.auc(scored([("a", True, 0.5), ("b", False, 0.5)])).first().auc == 0.5
    assert Z.auc(scored([("a", True, 0.5)])).first().auc == 0.0
    best = Z.recommend(Z.with_rates(Z.sweep(separable, Z.thresholds()))).first()
    assert best.eligible and best.threshold == 0.11
    with pytest.raises(ValueError):
        Z.thresholds(0)


def test_planning(spark):
    rows = [("1", "منو اللي يدفع الرسوم؟ وراتبي شلون ينزل الشهر"), ("2", "ما مدة الإخطار؟"), ("3", "ولو تأخر هالة")]
    questions = spark.createDataFrame(rows, "query_id string, question string")
    plans = {r.query_id: r for r in P.plan_rules(questions, decompose_enabled=True).collect()}
    assert plans["1"].register == "gulf" and len(plans["1"].search_queries) == 4
    assert plans["2"].rewritten is None and plans["2"].search_queries == ["ما مدة الإخطار؟"]
    assert plans["3"].rewritten is None  # neither a conditional nor a noun is touched
    once = questions.select(P.rewrite("question").alias("question"))
    assert once.where(P.rewrite("question") != F.col("question")).count() == 0
    assert P.lexicon_problems(P.lexicon_table(spark)).count() == 0


def test_pairs_files(spark, tmp_path):
    (tmp_path / "pairs_a.jsonl").write_text(
        '{"id": "b", "question": "x", "dialect_tag": "msa", "answer": "y", "source_doc": "d", "source_chunk_ids": ["d:1:0"]}\n\n'
    )
    (tmp_path / "pairs_b.jsonl").write_text(
        '{"id": "a", "question": "x", "dialect_tag": "gulf", "answer": "y", "source_doc": "d", "source_chunk_ids": [], "derived_from": "b"}\n'
    )
    pairs = L.load_pairs(spark, str(tmp_path / "pairs_*.jsonl"))
    assert [r.id for r in pairs.collect()] == ["a", "b"]
    L.save_pairs(pairs, str(tmp_path / "out"))
    assert L.load_pairs(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "pairs_c.jsonl").write_text((tmp_path / "pairs_b.jsonl").read_text())
    with pytest.raises(Exception, match="duplicate pair id a"):
        L.load_pairs(spark, str(tmp_path / "pairs_*.jsonl")).collect()


def test_upsert_is_idempotent(spark):
    shape = "id string, doc_id string, article string, seq int, text string, text_normalized string, created_at string"
    old = spark.createDataFrame([("d:p:0", "d", None, 0, "x", "x", "t0"), ("d:p:1", "d", None, 1, "y", "y", "t0")], shape)
    new = spark.createDataFrame([("d:p:0", "d", None, 0, "z", "z", "t1"), ("e:p:0", "e", None, 0, "n", "n", "t1")], shape)
    once = U.upsert(old, new)
    assert {r.id: (r.text, r.created_at) for r in once.collect()} == {"d:p:0": ("z", "t0"), "d:p:1": ("y", "t0"), "e:p:0": ("n", "t1")}
    assert U.upsert(once, new).exceptAll(once).count() == 0
    assert sorted(r.id for r in U.prune(once, new).collect()) == ["d:p:0", "e:p:0"]


def test_configs():
    assert S.RetrievalConfig.named("hybrid+rerank").rerank
    with pytest.raises(ValueError):
        S.RetrievalConfig.named("nope")
    with pytest.raises(ValueError):
        S.RetrievalConfig("x", dense=False, lexical=False)


def test_running_totals_span_partitions_and_null_groups(spark):
    from daftar.operators.ordered import running_totals

    rows = spark.range(5000).select(
        F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 == 1, "small").otherwise("hot").alias("g"),
        ((F.col("id") * 7919) % 5000).alias("at"), (F.col("id") % 11).alias("n"), F.col("id").alias("n2"),
    )
    found = running_totals(rows, ["g"], "at", ["n", "n2"]).collect()
    for group in (None, "small", "hot"):
        total = total2 = 0
        for r in sorted((r for r in found if r.g == group), key=lambda r: r["at"]):
            total, total2 = total + r.n, total2 + r.n2
            assert (r.cum_n, r.cum_n2) == (total, total2)
    whole = running_totals(rows, [], "at", ["n"]).where("at = 4999").first()
    assert whole.cum_n == rows.agg(F.sum("n")).first()[0]


def walk_spend(events, cap):
    usd, calls, held, out = Decimal(0), 0, {}, {}
    for ts, event, request, kind, amount in sorted(events):
        amount, accepted = Decimal(str(amount)), None
        if kind == "reserve":
            accepted = usd + amount < cap
            if accepted:
                usd += amount
                held[request] = amount
        elif request in held:
            usd = max(Decimal(0), usd - held.pop(request) + amount)
            calls += 1
        out[event] = (accepted, round(float(usd), 9), calls)
    return out


def test_spend_admission_agrees_with_a_walk(spark):
    rng = random.Random(9)
    days, rows = {}, []
    for day, (cap_pressure, n) in enumerate([(0.1, 80), (1.0, 300), (3.0, 300), (0.5, 200)]):
        own = []
        for i in range(n):
            request = rng.randint(0, n // 2)  # requests that reserve again, settle twice, settle unreserved
            kind, amount = rng.choice(["reserve", "reserve", "settle"]), round(rng.random() * cap_pressure, 6)
            own.append((f"2024-01-0{day + 1} {rng.randint(0, 23):02d}:00:00", day * 1000 + i, request, kind, amount))
        days[day] = own
        rows += own
    events = spark.createDataFrame(rows, "at string, event_id long, request_id long, kind string, usd double").withColumn("ts", F.col("at").cast("timestamp"))
    want = {k: v for own in days.values() for k, v in walk_spend(own, Decimal(40)).items()}
    found = {r.event_id: (r.accepted, round(r.usd, 9), r.calls) for r in G.spend_admission(events, 40.0).collect()}
    assert found == want
    assert any(v[0] is False for v in want.values())
    daily = {r.date: r for r in G.daily_admission(events, 40.0).collect()}
    for day, own in days.items():
        verdicts = [want[e[1]] for e in sorted(own)]
        row = daily[f"2024-01-0{day + 1}"]
        assert (row.accepted, row.rejected) == (sum(v[0] is True for v in verdicts), sum(v[0] is False for v in verdicts))
        assert (round(row.usd, 9), row.calls) == verdicts[-1][1:]


def test_hot_day_of_a_million_events_is_not_one_task(spark):
    """Below the cap nothing is walked: the running totals of one day come from several partitions."""
    events = spark.range(1_000_000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 80_000).alias("ts"),
        F.floor(F.col("id") / 2).alias("request_id"), F.when(F.col("id") % 2 == 0, "reserve").otherwise("settle").alias("kind"), F.lit(0.001).alias("usd"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4MB")  # else a day this small is one task
    try:
        sure, _, tail = G._admitted(events, 1_000_000.0)
        assert tail.isEmpty() and sure.count() == 1_000_000
        assert sure.groupBy(F.spark_partition_id()).count().count() > 1
        last = G.daily_admission(events, 1_000_000.0).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert (last.accepted, last.rejected, last.calls) == (500_000, 0, 500_000) or last.calls > 490_000


def test_pieces_of_many_sections_are_numbered_in_seconds(spark):
    from daftar.operators.chunking import _numbered

    articles = [None if i % 1000 == 0 else str(i % 7000) for i in range(20_000)]
    row = spark.createDataFrame([([(a, "x", 0) for a in articles],), ([],), (None,)], "p array<struct<article:string,text:string,seq:int>>")
    start = time.perf_counter()
    found = row.select(_numbered(F.col("p")).alias("p")).collect()
    assert time.perf_counter() - start < 20
    seen = Counter()
    for a, piece in zip(articles, found[0].p):
        assert (piece.article, piece.seq) == (a, seen[a])
        seen[a] += 1
    assert found[1].p == [] and found[2].p is None


def test_counter_of_a_hot_series_is_cut_into_slices(spark):
    """A million samples of one series in one hour: the carry between slices, buckets and restarts is exact."""
    from daftar.operators.opsmetrics import counter_increases

    n = 1_000_000
    second = F.floor(F.col("id") * 4800 / n)  # an hour and twenty minutes
    samples = spark.range(n).select(
        F.lit("a").alias("name"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 4800).alias("ts"),
        (F.col("id") % 300_000).cast("double").alias("value"), second.alias("s"),
    )
    found = {r.bucket.minute + 60 * r.bucket.hour: r.increase for r in counter_increases(samples, ["name"]).collect()}
    steps = [1.0 if i % 300_000 else 0.0 for i in range(n)]
    split = n * 3600 // 4800
    base = min(found)
    assert found == {base: sum(steps[:split]), base + 60: sum(steps[split:])}
    few = spark.createDataFrame([("a", "2024-01-01 00:00:00", 5.0), ("a", "2024-01-01 00:59:59", 9.0), ("a", "2024-01-01 02:00:00", 2.0), ("b", "2024-01-01 00:00:00", 1.0)],
                                "name string, at string, value double").withColumn("ts", F.col("at").cast("timestamp"))
    for slices in (1, 7, 256):
        rows = sorted((r.name, r.increase) for r in counter_increases(few, ["name"], slices=slices).collect())
        assert rows == [("a", 2.0), ("a", 4.0), ("b", 0.0)]


def test_plan_vectors_of_another_length_fail(spark):
    from daftar.plans import retrieval as R

    chunks = spark.createDataFrame([("d:p:0", "d", None, 0, "some words", "some words")], "id string, doc_id string, article string, seq int, text string, text_normalized string")
    corpus = spark.createDataFrame([("d:p:0", [1.0, 0.0])], "id string, emb_e5 array<double>")
    asked = spark.createDataFrame([("q", "some words")], "query_id string, question string")
    vectors = spark.createDataFrame([("some words", [1.0, 0.0])], "question string, vector array<double>")
    config = S.RetrievalConfig.named("hybrid", model_key="e5")
    with pytest.raises(Exception, match="expected 1024 dimensions, got 2"):
        R.ask(asked, chunks, config, corpus=corpus, vectors=vectors).collect()
    row = R.ask(asked, chunks, config, corpus=corpus, vectors=vectors, dim=2, system="s").first()
    assert row.status == "to_generate" and row.system == "s" and "some words" in row.prompt


def test_sections_keep_every_character(spark):
    from daftar.operators.chunking import split_articles

    body = "one \ufdd0 two \ufdd01 three\ufdd0"
    text = f"before \ufdd00\n#1 {body}\n\ufdd0#2 no heading\n#3 last"
    row = spark.createDataFrame([(text,), ("plain \ufdd0 text",)], "text string").select(split_articles("text", r"#([0-9])").alias("s")).collect()
    assert [(s.article, s.body) for s in row[0].s] == [(None, "before \ufdd00\n"), ("1", f"#1 {body}\n\ufdd0#2 no heading\n"), ("3", "#3 last")]
    assert [(s.article, s.body) for s in row[1].s] == [(None, "plain \ufdd0 text")]


def test_signatures_rule_out_no_pair(spark):
    rng = random.Random(15)
    pool = [f"t{i}" for i in range(400)]
    texts = [rng.sample(pool, rng.randint(1, 120)) for _ in range(40)]
    texts += [[w for w in t if rng.random() > 0.12] + rng.sample(pool, 3) for t in texts for _ in range(3)]
    sets = {f"q{i}": set(t) for i, t in enumerate(texts)}
    rows = spark.createDataFrame([(k, " ".join(t)) for k, t in zip(sets, texts, strict=True)], "query_id string, question string")
    found = {(r.id, r.other) for r in A.near_duplicates(rows, 0.8).collect() if r.id != r.other}
    first = {}
    for k in sorted(sets):
        first.setdefault(frozenset(sets[k]), k)
    names = sorted(first.values())
    want = {(a, b) for a in names for b in names if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    assert found == want and len(want) > 20
    plan = A._jaccard_join(*[A._token_sets(rows, "query_id", F.col("question"))] * 2, 0.8, same=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in plan and "tokens" not in plan.split("Join")[0]


def test_windows_hold_few_documents_as_python_strings():
    import tracemalloc

    import pyarrow as pa

    from daftar.operators import chunking as C

    rng = random.Random(3)
    texts = [" ".join("w" * rng.randint(1, 12) for _ in range(900)) for _ in range(1500)]
    bodies = pa.array([None if i % 7 == 0 else [text] for i, text in enumerate(texts)], pa.list_(pa.string()))
    tracemalloc.start()
    found = C._window_udf(1400, 150).func(bodies)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < bodies.nbytes / 3
    assert found.to_pylist() == [None if i % 7 == 0 else [C._windows(text, 1400, 150)] for i, text in enumerate(texts)]


def test_dense_search_takes_few_rows_of_a_batch_at_a_time():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": list(range(5000))})
    pieces = list(D._pieces(iter([batch, batch.slice(0, 0), batch.slice(0, 10)])))
    assert max(p.num_rows for p in pieces) == D._ROWS_AT_ONCE
    assert [i for p in pieces for i in p.column(0).to_pylist()] == [*range(5000), *range(10)]


def test_sets_that_only_share_rare_tokens_are_never_paired(spark):
    rng = random.Random(16)
    sizes = [3, 5, 40, 60, 200, 230, 900, 1100, 2400, 2900]
    sets = [{f"w{k}_{i}" for i in range(n - 2)} | {"rare", f"common{k % 3}"} for k, n in enumerate(sizes)]
    sets += [set(rng.sample(sorted(s), len(s) - len(s) // 20)) | {"new"} for s in sets[2:]]
    rows = spark.createDataFrame([(f"q{i:02}", " ".join(sorted(s))) for i, s in enumerate(sets)], "query_id string, question string")
    rows = rows.repartition(3)
    near = lambda x, y: 10 * len(x & y) >= 8 * len(x | y)
    want = {(f"q{i:02}", f"q{j:02}") for j in range(len(sets)) for i in range(j) if near(sets[i], sets[j])}
    found = A.near_duplicates(rows, 0.8)
    assert {(r.id, r.other) for r in found.collect()} == want and len(want) == 8
    one = A._token_sets(rows, "query_id", F.col("question"))
    plan = A._jaccard_join(one, one, 0.8, same=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2  # those that fetch what candidates are compared by; prefixes are not joined
    # Both sides, in batches so small that rows of one token are dealt over many.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        other = A._token_sets(rows.select(F.concat(F.lit("s"), "query_id").alias("query_id"), "question"), "query_id", F.col("question"))
        across = {(r.id, r.other[1:]) for r in A._jaccard_join(one, other, 0.8, same=False).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    assert across == want | {(b, a) for a, b in want} | {(f"q{i:02}",) * 2 for i in range(len(sets))}


def test_sentences_that_repeat_no_question_are_not_shuffled(spark):
    rng = random.Random(17)
    words = [f"w{i}" for i in range(60)]
    asked = [rng.sample(words, rng.randint(1, 12)) for _ in range(30)] + [["same", "twice"]] * 2 + [[]]
    said = [rng.sample(a, max(1, len(a) - k)) + rng.sample(words, k) for a in asked[:-1] for k in (0, 1, 2)]
    said += [rng.sample(words, rng.randint(1, 15)) for _ in range(200)] + said[:9] + [["twice", "same", "same"]]
    questions = spark.createDataFrame([(f"q{i}", " ".join(a)) for i, a in enumerate(asked)], "query_id string, question string")
    texts = [". ".join(" ".join(s) for s in said[at : at + 4]) for at in range(0, len(said), 4)]
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "id string, text string")
    sent, joined = A.leakage(questions, chunks), A.leakage(questions, chunks, broadcast_tokens=0)
    got = sorted((r.id, r.sentence_id, round(r.jaccard, 9), r.pairs) for r in sent.collect())
    assert got == sorted((r.id, r.sentence_id, round(r.jaccard, 9), r.pairs) for r in joined.collect())
    sides = {tuple(sorted(set(a))) for a in asked}, {tuple(sorted(set(s))) for s in said}
    assert len(got) == sum(5 * len(set(a) & set(s)) >= 3 * len(set(a) | set(s)) for a in sides[0] for s in sides[1] if a and s) > 30
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
