"""Golden text fixtures; the Arabic is invented for these tests."""

import random

import pytest
from daftar.functions import redaction as R
from daftar.functions import text as T
from daftar.operators import chunking as C
from daftar.sources import html as H


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


NORMALIZED = [
    ("كِتَابٌ", "كتاب"), ("كتـــاب", "كتاب"), ("أإآٱ", "اااا"), ("هدى", "هدي"), ("مدرسة", "مدرسه"),
    ("مؤمن قارئ", "مومن قاري"), ("٠١٢٣٤٥٦٧٨٩", "0123456789"), ("۰۱۲۳۴۵۶۷۸۹", "0123456789"),
    ("‏نص‎ ثان‬", "نص ثان"), ("  a \t\n b c ", "a b c"), ("Mixed نصّ ABC", "Mixed نص ABC"),
    ("ﷲ ﬁ ①", "الله fi 1"), ("", ""), ("soft­hyphen", "softhyphen"), ("a﻿b", "ab"),
]


def test_normalize(spark):
    got = column(spark, [raw for raw, _ in NORMALIZED], T.normalize_for_index("x"))
    assert got == [want for _, want in NORMALIZED]
    assert column(spark, got, T.normalize_for_index("x")) == got


def test_blank_forms(spark):
    texts = [" ‏ـ ", "ﹰﱠ", "x", "", "،"]
    assert column(spark, texts, T.normalizes_to_blank("x")) == [True, True, False, True, False]
    assert [t == "" for t in column(spark, texts, T.normalize_for_index("x"))] == [True, True, False, True, False]


def test_guard_and_refusal(spark):
    questions = ["لا يجوز بعد ٣ سنوات من 12", "يجوز", "ليس غير"]
    keys = column(spark, questions, T.guard_key(T.normalize_query("x")))
    assert [(k.digits, k.negations) for k in keys] == [(["3", "12"], ["لا"]), ([], []), ([], ["غير", "ليس"])]
    answers = ["  لا تتضمن المواد المتاحة إجابة عن هذا السؤال، عذرا", "نعم"]
    assert column(spark, answers, T.is_refusal_text("x")) == [True, False]
    assert column(spark, ["نص «عربي» ok", "نص あ"], T.is_corrupted("x")) == [False, True]


HEADED = [
    ("plain", "تمهيد\nالمادة 1\nأول\nمادة (2)\nثان", ["plain:p:0", "plain:1:0", "plain:2:0"]),
    ("digits", "المادة ٥٧\nنص", ["digits:57:0"]),
    ("decorated", "المــادة (3)\nنص\nالمَادّة رقم ٤\nنص", ["decorated:3:0", "decorated:4:0"]),
    ("empty", "المادة 1\n \nالمادة 2\nنص", ["empty:2:0"]),
    ("repeat", "مادة 1\nأ\nمادة 2\nب\nمادة 1\nج", ["repeat:1:0", "repeat:2:0", "repeat:1:1"]),
    ("inline", "انظر المادة 5 هنا", ["inline:p:0"]),
    ("none", "لا عنوان", ["none:p:0"]),
    ("blank", " \n ", []),
]


def test_headings(spark):
    docs = spark.createDataFrame([row[:2] for row in HEADED], "doc_id string, text string")
    ids = {}
    for row in C.chunk_documents(docs).collect():
        ids.setdefault(row.doc_id, set()).add(row.id)
    assert ids == {name: set(want) for name, _, want in HEADED if want}


def test_windows_lose_nothing():
    """Every window is a trimmed stretch of the text; together, in order, they cover every word."""
    rng = random.Random(3)
    for _ in range(300):
        # random digits keep every stretch distinct, so a window has one place in the text
        words = ("".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((5, 8, 13, 45)))) for _ in range(rng.randint(0, 30)))
        text = "".join(word + rng.choice((" ", "\n", "  ")) for word in words).strip()
        pieces = C._windows(text, 20, 6)
        assert all(piece == piece.strip() and 0 < len(piece) <= 20 for piece in pieces)
        covered = 0
        for piece in pieces:
            at = text.index(piece, max(0, covered - 6 - 1))
            assert not text[covered:at].strip()  # nothing but white space between windows
            covered = max(covered, at + len(piece))
        assert not text[covered:].strip()


def test_unbroken_runs_are_cut_without_loss():
    blob = "x" * 5000
    pieces = C._windows(blob, 1400, 150)
    assert "".join(pieces) == blob and len(pieces) == 4
    assert "x" * 3000 in "".join(C._windows(f"a b {'x' * 3000} c", 1400, 150))


def test_chunk_parameters(spark):
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    with pytest.raises(ValueError):
        C.chunk_documents(docs, max_chars=0)
    with pytest.raises(ValueError):
        C.chunk_documents(docs, overlap=-1)


REDACTED = [
    ("db postgres://user:pa55@host/db", "db postgres://user:[redacted:password]@host/db"),
    ("mail jane.roe@example.org now", "mail [redacted:email] now"),
    ("postgres://user@10.8.0.3/db", "postgres://user@10.8.0.3/db"),
    ("id 123-45-6789.", "id [redacted:id]."),
    ("card 4111 1111 1111 1111 ok", "card [redacted:card] ok"),
    ("call +1 415-555-2671 now", "call [redacted:phone] now"),
    ("sin 123 456 789", "sin [redacted:id]"),
    ("pan 4111111111111111 x", "pan [redacted:card] x"),
    ("request 4111111111111112 x", "request 4111111111111112 x"),
    ("token=abcdef123456789", "token=[redacted]"),
    ("Authorization: Bearer abc.def.ghi123", "Authorization: Bearer [redacted]"),
    ("Authorization header missing", "Authorization header missing"),
    ("secret some-long-resource-name denied", "secret some-long-resource-name denied"),
    ("token password hunter2_longsecret", "token password hunter2_longsecret"),
    ("password: short", "password: short"),
    ("served 123456789 bytes", "served 123456789 bytes"),
]


def test_redaction(spark):
    assert column(spark, [a for a, _ in REDACTED], R.redact("x")) == [b for _, b in REDACTED]


def test_denied_names(spark):
    names = ["access_token", "clientSecret", "x-api-key", "HTTPCookie", "cardinality", "cache_key", "user_email", "national_id"]
    want = [True, True, True, True, False, False, True, True]
    assert column(spark, names, R.is_denied_key("x")) == want
    assert [R.denied_name(n) for n in names] == want


def test_scrub_nested(spark):
    row = spark.sql("select struct('a@b.co' as note, 'x' as password, map('apiKey', 'k', 'note', 'ok') as m) as s, double('NaN') as d")
    got = R.scrub_table(row).first()
    assert got.s.note == "[redacted:email]" and got.s.password == "[redacted]"
    assert got.s.m == {"apiKey": "[redacted]", "note": "ok"} and got.d is None


def test_html(spark):
    page = "<head><title>t</title></head><p>a &amp; b</p><script>x</script>c<br>d  e<b>f</b><noscript>z</noscript>"
    pages = spark.createDataFrame([(1, page), (2, None)], "id int, html string")
    got = {r.id: r.text for r in H.strip_html(pages).collect()}
    assert got[1] == "a & b\nc\nd ef"


def test_foreign_characters_are_found_without_a_match_for_each(spark):
    texts = ["", None, "plain\n", "\u00e9t\u00e9 \u00e9", "a\U0001f600b\u4e2d\U0001f600", "\u4e2d" * 5000, "\u0645\u0627\u062f\u0629 \x00\x7f"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", T.foreign_characters("text").alias("f"))
    assert "regexp_extract_all" not in rows._jdf.queryExecution().optimizedPlan().toString()
    found = {r.n: r.f for r in rows.collect()}
    assert [found[i] for i in range(7)] == [[], None, [], ["\u00e9"], ["\U0001f600", "\u4e2d"], ["\u4e2d"], ["\x00", "\x7f"]]
