"""Lengths and characters that once fell outside a fixed limit."""

import pytest
from pyspark.sql import functions as F

from daftar.functions import redaction as R
from daftar.operators.chunking import split_articles
from daftar.operators.planning import Dialect, rewrite
from daftar.sources.html import strip_html


@pytest.mark.parametrize("marks", [1, 64, 65, 1000])
def test_any_decoration_before_a_heading(spark, marks):
    text = "المادة 1\nنص أول\n" + "ـ" * marks + "المادة 2\nنص ثان"
    row = spark.createDataFrame([(text,)], "t string").select(split_articles("t").alias("s")).first()
    assert [s.article for s in row.s] == ["1", "2"]
    assert "".join(s.body for s in row.s) == text


def test_long_clitic_is_rewritten_whole(spark):
    dialect = Dialect()
    word = dialect.prefix + "ب" * 1_000_005
    out = spark.createDataFrame([(word,)], "q string").select(F.length(rewrite("q")).alias("n")).first().n
    assert out == len(dialect.prefix_becomes) + 1_000_005


@pytest.mark.parametrize("space", [" ", "\u00a0", "\u2003", "\t"])
def test_labels_across_any_space(spark, space):
    frame = spark.createDataFrame([(f"token{space}abcdef123456789 rest",)], "t string")
    assert frame.select(R.redact("t").alias("t")).first().t == f"token{space}[redacted] rest"


def test_maps_of_numbers_keep_their_keys(spark):
    frame = spark.sql("SELECT map('apiKey', 1.5D, 'n', double('Infinity'), 'm', double('NaN'), 'k', 2.5D) AS m")
    assert R.scrub_table(frame).first().m == {"apiKey": "[redacted]", "n": "Infinity", "m": "NaN", "k": "2.5"}
    nested = spark.sql("SELECT map('a', named_struct('password', 'x', 'n', 1)) AS m")
    assert R.scrub_table(nested).first().m == {"a": '{"password":"[redacted]","n":1}'}


def test_key_rules_agree_in_both_places(spark):
    names = ["userPassword", "API_KEY", "APIKey", "api2key", "discard", "creditCard", "tokenizer", "a-p-i-k-e-y", "pass word", "", "Mail2"]
    frame = spark.createDataFrame([(n,) for n in names], "n string").select("n", R.is_denied_key("n").alias("d"))
    got = {r.n: r.d for r in frame.collect()}
    assert got == {n: R.denied_name(n) for n in names}
    assert [n for n in names if got[n]] == ["userPassword", "API_KEY", "APIKey", "creditCard", "a-p-i-k-e-y", "pass word", "Mail2"]


def test_html_edges(spark):
    pages = {
        '<p>a &lt;b&gt; c&amp;d</p><!-- x > y --><br/>e<BR>f<img src="a>b">g': "a <b> c&d\ne\nfg",
        '<head><title>t</title></head>x<script>if(a<b){"</p>"}</script>y<style>p{}</style >': "xy",
        "a < b and c > d": "a < b and c > d", "<script>never closed <p>x": "", "<header>h</header><pre>x</pre>": "hx", "": "", None: None,
    }
    frame = spark.createDataFrame([(p,) for p in pages], "html string")
    assert {r.html: r.text for r in strip_html(frame).collect()} == pages


def test_sections_of_odd_documents_agree_with_their_sql(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from daftar.catalog import ORACLES, QUERIES

    texts = [None, "", " ", "\n\t ", " ", "\r\n", "The", "The\r\nbody", "  The x\nb", "a\n\tAb x", "﻿The x", "a\n­The x", "The  \nb", "plain\n", "The\n\nAb x\n"]
    none = [None] * len(texts)
    rows = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "lang": pa.array(none, pa.string()), "source": pa.array(none, pa.string())})
    pq.write_table(rows, tmp_path / "documents.parquet")
    got = QUERIES["split_articles"](spark, str(tmp_path)).select("doc_id", "pos", "article", "n_chars").collect()
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
        want = base.execute(f"SELECT doc_id, pos, article, n_chars FROM ({ORACLES['split_articles']}) r").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) > 10
    empty = spark.createDataFrame([(t,) for t in (None, "", " \n", " ")], "t string").select(split_articles("t").alias("s"))
    assert [r.s for r in empty.collect()] == [[], [], [], []]
