"""Pipeline stages at their edges: rows without an id, repeated ids, columns with clashing names, bounds passed."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from daftar.llm import bpe, decontaminate, nearcopies, quality, secrets
from daftar.llm.sieve import without

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _doc string, _secrets int, leads string, again int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1, "y", 2) for i, t in rows], DOCS)


def words(rng, n):
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


def test_without_by_broadcast_and_by_filter(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 50 != 0, F.col("id")).alias("doc_id"), F.col("id").alias("n"), F.lit("x").alias("key"))
    gone = spark.range(0, 5000, 3).select(F.col("id").alias("doc_id"))
    want = {i for i in range(5000) if i % 50 == 0 or i % 3}
    for most in (10_000, 10):
        left = without(rows, gone, "doc_id", most)
        assert left.columns == rows.columns and {r.n for r in left.collect()} == want
        assert without(rows, gone.limit(0), "doc_id", most).count() == 5000


def test_near_copies_keep_one_of_each_component(spark):
    rng = random.Random(4)
    base = words(rng, 100)
    near = base.replace(base.split()[50], "changed", 1)
    other = words(rng, 80)
    rows = [(5, base), (3, near), (9, base), (None, base), (7, other), (7, other), (8, None), (6, ""), (4, "one two"), (4, words(rng, 60))]
    kept = nearcopies.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert found == sorted([(3, near), (None, base), (7, other), (6, ""), (4, "one two"), (4, rows[-1][1])], key=str)
    assert nearcopies.keep_one(documents(spark, [])).count() == 0


def test_near_dedup_links_fingerprints_too(spark):
    """Two repeated passages weigh far more than what differs: few bits apart, but few shingles in common."""
    from daftar.llm import simhash

    rng = random.Random(14)
    often = words(rng, 11)  # an odd number of shingles: no bit is a tie
    one, two = (" ".join([often] * 200) + " " + words(rng, 20) for _ in range(2))
    rows = [(5, one), (2, two), (3, words(rng, 60))]
    apart = {r.doc_id: r.component_id for r in nearcopies.near_copies(documents(spark, rows)).collect()}
    assert apart[5] == 5  # not by their sets of shingles
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, rows), nearcopies.SHINGLE).collect()}
    assert near == {5: 2, 2: 2, 3: 3}
    assert sorted(r.doc_id for r in nearcopies.keep_one(documents(spark, rows)).collect()) == [2, 3]


def test_near_dedup_contracts_one_graph_of_links(spark, monkeypatch):
    """Links of both kinds meet in one graph; each further one would be rounds of plans for the driver."""
    from daftar.llm.common import Scratch

    rng = random.Random(24)
    base, often = words(rng, 100), words(rng, 11)
    near = base.replace(base.split()[50], "changed", 1)  # linked with base by its shingles
    one, two = (" ".join([often] * 200) + " " + words(rng, 20) for _ in range(2))  # linked by their fingerprints
    rows = [(5, base), (3, near), (9, base), (11, one), (10, two), (4, base), (4, two), (8, ""), (6, None), (7, words(rng, 60))]
    stored = []
    put = Scratch.put
    monkeypatch.setattr(Scratch, "put", lambda self, df, name: stored.append(name) or put(self, df, name))
    found = {(r.doc_id, r.component_id) for r in nearcopies.classes(documents(spark, rows)).collect()}
    assert found == {(i, 3) for i in (3, 4, 5, 9, 10, 11)} | {(8, 6), (6, 6), (7, 7)}
    assert [name for name in stored if name.endswith("-0")] == ["groups-0", "graph-0"] and len(stored) <= 16


def test_letter_pairs_count_every_place(spark):
    texts = ["abcdefgh ab xyz12 abcdefgh", None, "", "a-bc_ABC"]
    pairs = [w[i : i + 2] for t in texts for w in re.split("[^a-z0-9]+", (t or "").lower()) for i in range(len(w) - 1)]
    got = secrets.letter_pairs(documents(spark, list(enumerate(texts))))
    assert {p: round(math.exp(x) * len(pairs)) for p, x in got.items()} == dict(Counter(pairs))
    assert secrets.letter_pairs(documents(spark, [])) == {}


def plain_components(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_near_copies_agree_with_all_pairs(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(25):
        own = words(rng, rng.randint(30, 120)).split()
        for _ in range(rng.randint(1, 6)):
            copy = list(own)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    found = {r.doc_id: r.component_id for r in nearcopies.near_copies(documents(spark, list(enumerate(texts)))).collect()}
    assert [found[i] for i in range(len(texts))] == plain_components(sets)


def test_clean_judges_rows_without_an_id_by_their_text(spark):
    rng = random.Random(8)
    item = words(rng, 30)
    benchmark = spark.createDataFrame([(1, item, "x"), (None, words(rng, 20), "x"), (2, None, "x")], "item_id long, text string, doc_id string")
    fine = words(rng, 50)
    rows = [(1, f"{fine} {item} {fine}"), (None, f"start {item} end"), (None, fine), (2, fine), (3, None), (None, None)]
    kept = decontaminate.clean(documents(spark, rows), benchmark)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(rows[2:], key=str)
    assert decontaminate.clean(documents(spark, []), benchmark).count() == 0
    assert decontaminate.clean(documents(spark, rows), benchmark.limit(0)).count() == 6


def test_redact_with_columns_of_its_own_names(spark):
    secret = "AKIA" + "Q7Z2M4X9K1B8C3D5"
    rows = [(1, f"aws_access_key_id = {secret} and words"), (None, "nothing here"), (2, None)]
    out = secrets.redact(documents(spark, rows))
    assert out.columns == documents(spark, []).columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert secret not in texts[1] and texts[None] == "nothing here" and texts[2] is None


class _Given:
    def __init__(self, value):
        self.value = value


def test_codec_remembers_what_is_met_often(monkeypatch):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"cd": 258}
    pairs, merged = bpe.merge_table(ranks)
    monkeypatch.setattr(bpe, "_MOST_WORDS", 3)
    codec = bpe.Codec(ranks, pairs, merged)
    encoded = []
    plain = codec.encode
    codec.encode = lambda some: (encoded.extend(some), plain(some))[1]
    for piece in (["abcd", "often"], ["x", "y", "often"], ["z", "often"], ["often", "q", "abcd"]):
        codec.age()
        codec.learn(piece)
        assert all(w in codec.words for w in piece)
    assert encoded.count("often") == 1
    assert codec.words["abcd"] == (2, "257 100", b"abcd") and len(codec.before) <= 8
    codec.close()
    first = bpe.worker_codec("one", _Given((ranks, pairs, merged)))
    assert bpe.worker_codec("one", None) is first
    assert bpe.worker_codec("two", _Given((ranks, pairs, merged))) is not first and list(bpe._kept) == ["two"]
    assert isinstance(first.words, dict) and not first.words and np.array_equal(first.single[:3], [0, 1, 2])


def plain_groups(spark, docs, prior):
    """Every row's distance from its group's shrunken estimate, in memory."""
    from tests.llm.test_small import plain_fit

    rows = quality.counts(docs).select("doc_id", "lang", "source", *quality.vector()).toPandas()
    axes = list(quality.AXES)
    fit = lambda some: plain_fit(some[axes].to_numpy())
    out = {}
    centre_all, inverse_all = fit(rows)
    for lang in {None, *rows.lang.dropna()}:
        in_lang = rows[rows.lang.isna() if lang is None else rows.lang == lang]
        for source in {None, *in_lang.source.dropna()}:
            own = in_lang[in_lang.source.isna() if source is None else in_lang.source == source]
            if own.empty:
                continue
            centre, spread = centre_all, np.linalg.inv(inverse_all)
            for some in (in_lang, own):
                w = len(some) / (len(some) + prior)
                near, inverse = fit(some)
                centre, spread = w * near + (1 - w) * centre, w * np.linalg.inv(inverse) + (1 - w) * spread
            away = own[axes].to_numpy() - centre
            out |= dict(zip(own.doc_id, np.einsum("ni,ij,nj->n", away, np.linalg.inv(spread), away)))
    return out


def test_small_groups_lean_on_their_language(spark):
    rng = random.Random(12)
    rows = []
    for lang, source, n in (("en", "big", 120), ("en", "tiny", 3), ("fr", "only", 15), (None, None, 6), (None, "x", 4), ("en", None, 7)):
        rows += [(len(rows) + i, " ".join(words(rng, 1) + rng.choice(["", ",", "."]) for _ in range(rng.randint(25, 90))), lang, source) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r for r in quality.verdicts(docs, prior=20).collect()}
    assert not any(r.base_failed for r in found.values())
    want = plain_groups(spark, docs, 20)
    assert np.allclose([found[k].distance for k in sorted(want)], [want[k] for k in sorted(want)], rtol=1e-4, atol=1e-4)


def test_a_group_that_grows_past_the_prior_keeps_its_verdicts(spark):
    """A source of 199 texts and the same source with two more are judged alike."""
    rng = random.Random(13)
    body = [(i, " ".join(words(rng, 1) for _ in range(rng.randint(25, 60))), "en", "main") for i in range(400)]
    own = [(1000 + i, " ".join(words(rng, 1) + "," for _ in range(rng.randint(25, 60))), "en", "own") for i in range(201)]
    shape = "doc_id long, text string, lang string, source string"
    few = {r.doc_id: r.distance for r in quality.verdicts(spark.createDataFrame(body + own[:199], shape)).collect()}
    more = {r.doc_id: r.distance for r in quality.verdicts(spark.createDataFrame(body + own, shape)).collect()}
    assert all(abs(few[k] - more[k]) <= 0.15 * few[k] + 0.3 for k in few)


def test_what_a_worker_kept_is_closed_for_other_tasks():
    from daftar.llm.common import KEPT, let_go

    class Held:
        closed = False

        def close(self):
            self.closed = True

    held = KEPT["call"] = Held()
    let_go()
    assert held.closed and not KEPT and bpe._kept is KEPT


def test_whole_texts_reach_python_in_small_batches(spark):
    from daftar.session import BATCH_BYTES, ship_package

    ship_package(spark)
    texts = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('word ', 2000) AS text")
    sizes = texts.mapInArrow(lambda parts: (pa.RecordBatch.from_pydict({"n": [p.nbytes]}) for p in parts), "n long").collect()
    # 30 MB in one task came as one batch
    assert len(sizes) > 5 and max(r.n for r in sizes) < 1.5 * BATCH_BYTES

    @F.pandas_udf("long")
    def rows(texts):
        return pd.Series([len(texts)] * len(texts))

    assert texts.select(rows("text").alias("n")).agg(F.max("n")).first()[0] < 1000
