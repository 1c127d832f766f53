"""Manifests, corpora, metric expositions, push envelopes, scores and baselines."""

import html
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from daftar.catalog import ORACLES, QUERIES
from daftar.operators import citations as Z
from daftar.sources import corpus as C
from daftar.sources import html as H
from daftar.sources import labelled as L
from daftar.sources import messages as M
from daftar.sources import tables as U

SECTIONS = [
    {"anchor": "pre", "label": "x", "first_article": 1, "last_article": 4, "preamble": True},
    {"anchor": "one", "label": "x", "first_article": 1, "last_article": 115},
    {"anchor": "two", "label": "x", "first_article": 115, "last_article": 115},
]


def manifest(tmp_path, documents, bare=False):
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps(documents if bare else {"documents": documents}))
    return str(path)


def test_manifest_and_corpus(spark, tmp_path):
    good = {"doc_id": "law", "title": "t", "license": "l", "source_url": "https://x", "sections": SECTIONS}
    docs = C.load_manifest(spark, manifest(tmp_path, [good], bare=True))
    (tmp_path / "law.txt").write_text("\n نص \n")
    assert C.load_corpus(spark, str(tmp_path), docs).first().text == "نص"
    missing = C.load_manifest(spark, manifest(tmp_path, [good, {**good, "doc_id": "gone"}]))
    with pytest.raises(Exception, match="no text for document gone"):
        C.load_corpus(spark, str(tmp_path), missing).collect()
    with pytest.raises(Exception, match="lacks a required field"):
        C.load_manifest(spark, manifest(tmp_path, [{"doc_id": "law", "title": " ", "license": "l"}])).collect()


def test_source_urls(spark, tmp_path):
    docs = C.load_manifest(spark, manifest(tmp_path, [{"doc_id": "law", "title": "t", "license": "l", "source_url": "https://x", "sections": SECTIONS}]))
    cited = spark.createDataFrame(
        [(1, "law", "115"), (2, "law", "٣"), (3, "law", "115 bis"), (4, "law", None), (5, "other", "1"), (6, "law", "900")],
        "i int, doc_id string, article string",
    )
    got = {r.i: r.source_url for r in Z.source_urls(cited, docs, Z.manifest_sections(docs), ["i"]).collect()}
    assert got == {1: "https://x#one", 2: "https://x#one", 3: "https://x", 4: "https://x", 5: None, 6: "https://x"}


def test_exposition(spark):
    lines = ['# TYPE a counter', 'a{x="1",y="q\\"z,"} 5e-05', "b 3", 'c{le="+Inf"} +Inf', "d NaN", "broken line x"]
    rows = M.parse_exposition(spark.createDataFrame([(v,) for v in lines], "value string")).collect()
    assert [(r.name, r.labels) for r in rows] == [("a", {"x": "1", "y": 'q"z,'}), ("b", {}), ("c", {"le": "+Inf"}), ("d", {})]
    assert rows[0].value == 5e-05 and rows[2].value == float("inf") and rows[3].value != rows[3].value


def test_scores_and_baselines(spark, tmp_path):
    scored = spark.createDataFrame([("a", True, 0.12345678), ("b", False, 0.5)], "pair_id string, answerable boolean, top_score double")
    L.save_scores(scored, str(tmp_path / "s"), {"config": "x"})
    back, meta = L.load_scores(spark, str(tmp_path / "s"))
    assert {(r.pair_id, r.answerable, r.top_score) for r in back.collect()} == {("a", True, 0.123457), ("b", False, 0.5)}
    assert meta.first().value == "x"
    base = spark.createDataFrame([("k1", 0.5), ("k2", 0.6)], "entry_key string, m double")
    updated = L.update_baseline(base, base.where("entry_key = 'k1'").withColumn("m", F.lit(0.9)))
    assert {r.entry_key: r.m for r in updated.collect()} == {"k1": 0.9, "k2": 0.6}
    assert L.baseline_entry(base, "k2").count() == 1
    with pytest.raises(Exception, match="no baseline entry"):
        L.baseline_entry(base, "nope").collect()


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert U.write_version(spark.range(3), root) == 1
    assert U.write_version(spark.range(5), root) == 2
    assert U.read_version(spark, root).count() == 5 and U.read_version(spark, root, 1).count() == 3


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = [f"line {i}" if i % 7 else "" for i in range(20_000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("only\r\nthis")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = L.numbered_lines(spark, str(tmp_path / "*.txt"))
        assert found.rdd.getNumPartitions() > 1
        rows = {(r.file, r.line_no): r.line for r in found.collect()}
        splits = spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert splits > 5
    assert rows == {("a.txt", i): line for i, line in enumerate(lines, 1)} | {("b.txt", 1): "only\r", ("b.txt", 2): "this"}


def test_pairs_of_several_files_round_trip_and_name_the_line(spark, tmp_path):
    def pair(i):
        return {"id": f"p{i:04d}", "question": "q", "dialect_tag": "msa", "answer": "a", "source_doc": "d", "source_chunk_ids": ["d:p:0"]}

    path = tmp_path / "pairs.jsonl"
    path.write_text("\n".join(json.dumps(pair(i)) for i in range(3000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        pairs = L.load_pairs(spark, str(path))
        L.save_pairs(pairs, str(tmp_path / "out"))
        assert L.load_pairs(spark, str(tmp_path / "out")).count() == 3000
        names = sorted(p for p in (tmp_path / "out").iterdir() if p.suffix == ".json")
        ids = [json.loads(line)["id"] for p in names for line in p.read_text().splitlines()]
        assert ids == sorted(ids) and len(ids) == 3000
        whole = path.read_text()
        path.write_text(whole + '\n{"id": 5}\n')
        with pytest.raises(Exception, match="pairs.jsonl:3002: id: blank"):
            L.load_pairs(spark, str(path)).collect()
        path.write_text(whole + json.dumps(pair(17)) + "\n")
        with pytest.raises(Exception, match="pairs.jsonl:3001: duplicate pair id p0017"):
            L.load_pairs(spark, str(path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_references_as_the_table_has_them(spark):
    texts = [
        "a&&&amp\nb &amp; &amp;lt; &lt;p&gt;", "&copy &copy; &middot;&nbsp;x&#39;&apos;&quot;", "&rlm;&#x41;&#66;&#128;", "&ampamp; &unknown; &am &", "no", "", None,
        "&notit; &notin; &hellip &hellip;",
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = rows.select("id", H.unescape("t").alias("all"), H.unescape("t", bare=False).alias("ended")).orderBy("id").collect()
    assert [r["all"] for r in got] == [None if t is None else html.unescape(t) for t in texts]
    assert [r["ended"] for r in got] == [
        "a&&&amp\nb & &lt; <p>", "&copy © ·\xa0x''\"", "\u200fAB€", "&ampamp; &unknown; &am &", "no", "", None, "&notit; ∉ &hellip …",
    ]


def test_pages_hold_references_that_nothing_ends(spark, tmp_path):
    spark.createDataFrame([(1, "<p>the&&&amp</p><p>x &amp; y</p>", "u"), (2, "<p>&am &quo</p>", "u")], "page_id long, html string, url string").write.parquet(
        str(tmp_path / "pages.parquet")
    )
    told = duckdb.connect()
    told.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("strip_html", "extract_corpus"):
        found = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, found.collect())) == sorted(told.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLES[name]}) s").fetchall())
