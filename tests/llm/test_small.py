"""Kernels and small tables: each operator against a plain version, and at the edges its docstring names."""

import hashlib
import itertools
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from daftar.llm import bpe, decontaminate, language, licences, linkgraph, quality, queries, secrets, simhash, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, fingerprint int, label string"


def documents(spark, texts, ids=None):
    """A table of documents with further columns whose names operators use for their own."""
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", 1, "y") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


WORDS = "of the and a river stone walks under bright old wooden bridge while seven birds sing over quiet green water".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "er", "ing", "ly"]) for _ in range(n))


# --- op1 -------------------------------------------------------------------------------------------


def plain_counts(text):
    spaces = " \t\n\x0b\x0c\r"
    text = text or ""
    words = [w for w in "".join(" " if c in spaces else c for c in text).split(" ") if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [line for line in text.split("\n") if any(c not in spaces for c in line)]
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_counts_agree_with_plain_version():
    rng = random.Random(1)
    texts = [None, "", " \n\x0b", "a", "é\u00a0b c", "x " * 30, "a b c d e f g h a b c d e f g h i"]
    texts += ["\n".join(" ".join(rng.choice("ab#é") for _ in range(rng.randint(0, 12))) for _ in range(6)) for _ in range(300)]
    for text in texts:
        assert quality.text_counts(text)[:5] == plain_counts(text), repr(text)


def test_chi2_quantile():
    assert quality.chi2_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert quality.chi2_quantile(0.5, 6) == pytest.approx(5.348121, abs=1e-5)


def plain_fit(x, share=0.75, steps=5):
    """Centre and inverse spread of the concentration steps on one part, in memory."""
    d = x.shape[1]
    cells = np.floor(x * 256)
    centre, inverse = np.zeros(d), np.zeros((d, d))
    for k in range(d):
        ordered = np.sort(cells[:, k])
        at = [ordered[int(np.ceil(q * len(x))) - 1] for q in (0.25, 0.5, 0.75)]
        centre[k] = (at[1] + 0.5) / 256
        inverse[k, k] = 1 / (((at[2] - at[0]) / (256 * 1.349)) ** 2 + quality.FLOORS[k] ** 2)
    factor = share / quality._chi2_cdf(quality.chi2_quantile(share, d), d + 2)
    for _ in range(steps):
        away = x - centre
        bins = np.floor(np.log2(np.einsum("ni,ij,nj->n", away, inverse, away) + 1e-6) * 8)
        inside = x[bins <= np.sort(bins)[int(np.ceil(share * len(x))) - 1]]
        centre = inside.mean(axis=0)
        inverse = np.linalg.inv(factor * np.cov(inside.T, bias=True) + np.diag(np.square(quality.FLOORS)))
    return centre, inverse


def plain_estimate(x):
    centre, inverse = plain_fit(x)
    away = x - centre
    return np.einsum("ni,ij,nj->n", away, inverse, away)


def test_outliers_agree_with_plain_estimate(spark):
    rng = random.Random(2)
    texts = [sentence(rng, rng.randint(20, 200)) for _ in range(300)] + ["$$$ ###*** || " * 30 + sentence(rng, 40) for _ in range(30)]
    found = quality.verdicts(documents(spark, texts), prior=50).toPandas().sort_values("doc_id").reset_index(drop=True)
    rows = quality.counts(documents(spark, texts)).select("doc_id", *quality.vector()).toPandas().sort_values("doc_id")
    passing = ~found.base_failed.to_numpy()
    x = rows[list(quality.AXES)].to_numpy()[passing]
    assert np.allclose(found.distance[passing], plain_estimate(x), rtol=1e-4, atol=1e-4)
    assert found.kept[:300][passing[:300]].mean() > 0.99 and not found.kept[300:].any()


def test_quality_edges(spark):
    texts = [None, "", "one", "word " * 10_000, "same text again " * 3 + "and some other words that differ from it, twenty in all, or more of them."]
    out = quality.verdicts(documents(spark, texts + texts[-1:], [0, 1, 2, 3, 4, 4]))
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 6 and not any(got[k].kept for k in (0, 1, 2, 3))
    assert got[3].n_repeat_words == 10_000 and got[4].kept
    assert quality.verdicts(documents(spark, [])).count() == 0
    nulls = documents(spark, [texts[-1]] * 3).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    assert [r.kept for r in quality.verdicts(nulls).collect()] == [True] * 3


# --- op2 -------------------------------------------------------------------------------------------


def secret_texts():
    rng = random.Random(3)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [f'{sentence(rng, 10)} token = "{hexes(40)}" {sentence(rng, 5)}' for _ in range(60)]
    texts += [f"{sentence(rng, 10)} incomprehensiblenesses{rng.choice(WORDS)} and {rng.randrange(10**15, 10**16)} {sentence(rng, 4)}" for _ in range(80)]
    return texts


def test_secrets_are_found_with_their_places(spark):
    texts = secret_texts()
    found = secrets.scan(documents(spark, texts)).toPandas()
    for r in found.itertuples():
        assert texts[r.doc_id][r.start : r.start + len(r.value)] == r.value
    assert set(found[found.is_secret].doc_id) == set(range(60))
    assert not found[found.doc_id >= 60].is_secret.any()


def test_secrets_edges(spark):
    assert secrets.scan(documents(spark, [])).count() == 0
    assert secrets.scan(documents(spark, [None, "", "plain words"])).count() == 0
    one = documents(spark, ['token = "0123456789abcdef01" x', 'token = "0123456789abcdef01" x'], [7, 7])
    found = secrets.scan(one)
    assert found.count() == 2 and found.where("is_secret").count() == 2  # one label alone: nothing is taken out
    texts = secret_texts() + [None, "", "a" * 100_000]
    docs = documents(spark, texts)
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(texts)
    for r in clean.collect():
        if r.doc_id < 60:
            assert secrets.REDACTED in r.text and texts[r.doc_id].split('"')[1] not in r.text
            assert r.text == texts[r.doc_id].replace(texts[r.doc_id].split('"')[1], secrets.REDACTED) and r.n_chars == len(r.text)
        else:
            assert r.text == texts[r.doc_id]


def test_the_sample_is_drawn_in_all_tasks(spark):
    plans = {}

    class Watched(secrets.Scratch):
        def put(self, df, name):
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            return super().put(df, name)

    columns = ", ".join(f"{f} double" for f in secrets.FEATURES)
    rows = [(f"v{i}", float(i % 2), *[float(i % 2 + i % 3)] * len(secrets.FEATURES)) for i in range(40)]
    labelled = spark.createDataFrame(rows, f"value string, label double, {columns}")
    assert secrets.fit(labelled, Watched(spark, "t")) is not None
    assert "Exchange SinglePartition" in plans["sample"] and "Coalesce" not in plans["sample"]


# --- op3 -------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, host string, verdict int"


def test_rules_longest_wins(spark):
    urls = {
        "https://Example.ORG/es/a": ("example.org", "/es/a", "example.org/es/", "block"),
        "http://x.example.org/en/12?q": ("x.example.org", "/en/12", "example.org/en/1", "block"),
        "http://other.org/es/": ("other.org", "/es/", "org/", "allow"),
        "http://notexample.org/en/1": ("notexample.org", "/en/1", "org/", "allow"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"), "http://ORG/": ("org", "/", "org/", "allow"),
        "http://borg/": ("borg", "/", None, "allow"), "http://a.org": ("a.org", "", None, "allow"),
        "http://a.com/fr": ("a.com", "/fr", None, "allow"), "http://a.com/de/#x": ("a.com", "/de/", "com/de/", "block"),
        "http://h?x/y": ("h", "", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, None, "z", 1) for i, u in enumerate(urls)], PAGES)
    got = {r.page_id: (r.host, r.path, r.rule) for r in linkgraph.judge(pages, rounds=2).collect()}
    assert got == {i: v[:3] for i, v in enumerate(urls.values())}
    ruled = {r.page_id: r.verdict for r in linkgraph.judge(pages, rounds=2).collect() if r.rule}
    assert ruled == {i: v[3] for i, v in enumerate(urls.values()) if v[2]}


def test_rules_are_those_of_the_contract(spark, tmp_path):
    assert set(linkgraph.RULES) == {
        ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
    }
    urls = ["http://a.org/x", "http://example.org/es/1", "http://www.example.org/en/17", "http://example.org/de/", "http://b.com/fr/1", "http://b.com/de/1"]
    words = ["allow", "block", "block", "allow", "allow", "block"]
    pages = spark.createDataFrame([(i, u, None, "z", 1) for i, u in enumerate(urls)], PAGES)
    assert [r.verdict for r in linkgraph.judge(pages, rounds=2).orderBy("page_id").collect()] == words
    pages.write.parquet(str(tmp_path / "pages"))
    told = duckdb.connect()
    told.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages/*.parquet')")
    assert [r[0] for r in told.execute(f"SELECT verdict FROM ({linkgraph.sql(rounds=2)}) s ORDER BY page_id").fetchall()] == words


def test_distrust_flows_against_links(spark):
    link = lambda *hosts: "".join(f'<a class=x href="//{h}/p">t</a>' for h in hosts)
    rows = [
        (1, "http://bad.net/1", link("good.com"), "", 0), (2, "http://farm.io/1", link("bad.net", "bad.net"), "", 0),
        (3, "http://good.com/1", link("fine.dev"), "", 0), (4, "http://fine.dev/1", None, "", 0), (5, "http://alone.xyz/", "", "", 0),
        (5, "http://alone.xyz/", "", "", 0),
    ]
    rules = (("block", "bad.net/"), ("allow", "good.com/"))
    out = linkgraph.judge(spark.createDataFrame(rows, PAGES), rules)
    got = {r.host: r.verdict for r in out.collect()}
    assert got == {"bad.net": "block", "farm.io": "block", "good.com": "allow", "fine.dev": "allow", "alone.xyz": "allow"}
    assert out.count() == 6
    assert linkgraph.judge(spark.createDataFrame([], PAGES)).count() == 0


# --- op4 -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    path, pattern = queries.tokenizer()
    return bpe.read_ranks(None, path), pattern


def test_bpe_agrees_with_tiktoken(spark, ranks):
    table, pattern = ranks
    rng = random.Random(4)
    letters = "ab the  \n\t\r\x1c\x85\xa0\u200b é漢字العربية12٣½²'s'll!?.#😀𝒜𐐀_-\x00"
    texts = [None, ""] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += ["a" * 5000, " " * 700, "ab" * 500, "".join(rng.choice("abcdefgh") for _ in range(400)), "word " * 20_000]
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    out = bpe.encode_texts(documents(spark, texts), table, pattern, with_ids=True)
    got = {r.doc_id: r for r in out.collect()}
    for i, text in enumerate(texts):
        ids = own.encode_ordinary(text or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = bpe.decode_ids(out, table)
    assert {r.doc_id: bytes(r.raw) for r in back.collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert bpe.encode_texts(documents(spark, []), table, pattern).count() == 0


# --- op5 -------------------------------------------------------------------------------------------


def plain_statistics(words, sequences):
    """For each word, the longest run ending there that a template holds."""
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    return [max((n for n in range(1, at + 2) if tuple(words[at + 1 - n : at + 1]) in runs), default=0) for at in range(len(words))]


def test_automaton_gives_matching_statistics():
    rng = random.Random(5)
    for _ in range(200):
        sequences = [[rng.randrange(3) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 4))]
        words = [rng.choice([-1, 0, 1, 2, 2, 1]) for _ in range(30)]
        want = plain_statistics(words, sequences)
        peaks = [(at + 1, n) for at, n in enumerate(want) if n and (at + 1 == len(want) or want[at + 1] != n + 1)]
        automaton = licences.Automaton(sequences)
        got, every = automaton.stream(words, 2)
        assert [(end, n) for end, n, _ in got] == peaks
        assert [(end, n) for end, n, _ in every] == [(at + 1, n) for at, n in enumerate(want) if n >= 2]
        own = automaton.own_matches(every, 2)
        for number, sequence in enumerate(sequences):  # what the template has by itself, whatever the others hold
            alone = plain_statistics(words, [sequence])
            mine = [(at + 1, n) for at, n in enumerate(alone) if n >= 2 and (at + 1 == len(alone) or alone[at + 1] != n + 1)]
            assert [m[:2] for m in own.get(number, [])] == mine
        for end, n, state in got:
            run = words[end - n : end]
            for number, sequence in enumerate(sequences):
                ends = [j for j in range(n, len(sequence) + 1) if sequence[j - n : j] == run]
                assert automaton.ends[state].get(number, []) == ends


def test_base_phrases_agree_with_plain_search():
    rng = random.Random(6)
    scanner = licences.Scanner(licences.TEMPLATES, licences.BASE, 4, 0.7, 12)
    vocabulary = "under the mit license apache version 2 cc by nc x é2".split()
    for _ in range(400):
        words = [rng.choice(vocabulary) for _ in range(40)] + rng.choice(["under the mit license", "apache license version 2", ""]).split()
        text = rng.choice([" ", "-", "\n"]).join(words).upper()
        words = [w.decode() for w in licences.tokenize(text)]
        places = [
            (at, label) for label, phrase in licences.BASE.items() for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()
        ]
        n, n_base, first, last, base, labels, score, _ = scanner.scan(text)
        assert (n, n_base) == (len(words), len(places))
        assert first == min((a for a, _ in places), default=None) and last == max((a for a, _ in places), default=None)
        assert base == ",".join(sorted({label for _, label in places})) and set(base.split(",")) - {""} <= set(labels.split(","))
        assert 0 <= score <= 1


def test_every_notice_has_its_span():
    rng = random.Random(7)
    scanner = licences.Scanner(licences.TEMPLATES, licences.BASE, 4, 0.7, 12)
    for label in licences.TEMPLATES:
        size = len(licences.tokenize(licences.TEMPLATES[label][0]))
        parts, want, at = [], [], 0
        for k in range(6):
            filler = [f"filler{rng.randrange(1000)}" for _ in range(rng.choice([0, 3, 40]) if k else 5)]
            parts += filler + [licences.TEMPLATES[label][0]]
            want.append((label, at + len(filler), at + len(filler) + size, 1.0))
            at += len(filler) + size
        *_, labels, score, spans = scanner.scan(" ".join(parts))
        assert spans == want and score == 1.0 and label in labels.split(",")
    # one sentence of a notice that stands in it twice still belongs to the second place
    body = licences.TEMPLATES["bsd"][0].split()
    half = " ".join(body[len(body) // 2 :] + ["unrelated"] * 30 + body)
    assert [s[0] for s in scanner.scan(half)[7]] == ["bsd"]


def test_licences_are_found_in_changed_texts(spark):
    body = licences.TEMPLATES["mit"][0]
    changed = body.replace("free of charge", "at no cost").replace("merge, ", "")
    texts = [body, "x " * 50 + changed + " y" * 50, None, "", "mit der und the software", body.lower() * 200, "Licensed under the GNU General Public License, version 3."]
    got = {r.doc_id: r for r in licences.scan(documents(spark, texts)).collect()}
    assert got[0].labels == "mit" and got[0].score == 1.0 and got[1].labels == "mit" and got[1].score > 0.9
    assert (got[2].n_words, got[2].labels, got[3].labels, got[4].labels) == (0, "", "", "")
    assert got[5].labels == "mit" and got[6].labels == "gpl-3"
    span = next(s for s in got[1].spans if s.label == "mit")
    assert span.start == 50 and got[1].n_words - span.end == 50
    assert licences.scan(documents(spark, [])).count() == 0


# --- op6 -------------------------------------------------------------------------------------------


def test_reads_are_coalesced():
    assert warc.ranges([(0, 10), (10, 5), (20, 5), (100, 5)], most=100, gap=5) == [(0, 25, 3), (100, 105, 1)]
    assert warc.ranges([(0, 10), (10, 10)], most=15) == [(0, 10, 1), (10, 20, 1)]
    assert warc.ranges([]) == []


def test_archives_round_trip(spark):
    htmls = ["<p>a</p>", "", None, "<p>a</p>", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n\r\n", "é" * 1000, "x" * 3_000_000, "<p>a</p>", "é" * 1000]
    rows = [(i, f"http://h/{i}\r\nX: y" if i == 5 else (None if i == 1 else f"http://h/{i}"), h, "h", 1) for i, h in enumerate(htmls)]
    pages = spark.createDataFrame(rows, PAGES)
    index, folder = warc.archive(pages)
    assert index.count() == len(htmls)
    got = {r.page_id: r for r in warc.read(index, folder).collect()}
    first = {}
    for i, h in enumerate(htmls):
        raw = (h or "").encode()
        leader = first.setdefault(raw, i)
        assert got[i].kind == ("response" if leader == i else "revisit") and got[i].refers_to == (None if leader == i else leader)
        assert got[i].payload_bytes == len(raw) and (leader != i or bytes(got[i].payload) == raw)
    some = warc.read(index.where("page_id IN (4, 6)"), folder)
    assert rows_of(some, "page_id", "payload_bytes") == [(4, len(htmls[4])), (6, 3_000_000)]
    assert rows_of(warc.read_all(pages.where("page_id < 4"), least_bytes=9), "record_type") == [("response",)] * 4
    assert warc.read_all(spark.createDataFrame([], PAGES)).count() == 0


# --- op7 -------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints_and_anchors(spark):
    rng = random.Random(7)
    for text in [None, "", "A b", "one two three", "Ä b c d e"] + [sentence(rng, 50) for _ in range(20)]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    base = [rng.getrandbits(64) for _ in range(60)]
    marks = set(base) | {0, 2**64 - 1, 2**63}
    for b in base:
        for _ in range(4):
            marks.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 5))))
    signed = sorted(m - 2**64 if m >= 2**63 else m for m in marks)
    for bits in (0, 1, 2, 3):
        want = {(a, b) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) & 2**64 - 1).count("1") <= bits}
        found = simhash.links(spark.createDataFrame([(m,) for m in signed], "fingerprint long"), bits)
        assert {(r.low, r.high) for r in found.collect()} == want


def test_replicas_are_not_broadcast(spark):
    # Stored fingerprints, so that Spark knows the size of the rows before the replicas are made.
    stored = simhash.Scratch(spark, "t").put(spark.range(3000).select(F.xxhash64("id").alias("fingerprint")), "marks")
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    found = simhash.links(stored)
    assert found.count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (500, 502)], "low long, high long")
    got = {r.node: r.root for r in simhash.components(edges, simhash.Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500, 502: 500}


def test_near_duplicates_agree_with_plain_version(spark):
    rng = random.Random(8)
    texts = [sentence(rng, rng.randint(0, 80)) for _ in range(60)]
    texts += [" ".join(t.split()[:-1] + ["changed"]) for t in texts[:40]] + texts[:20] + [None, "", " ", texts[0].upper()]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    marks = [plain_fingerprint(t) for t in texts]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        if bin(marks[a] ^ marks[b]).count("1") <= 3:
            x, y = sorted((find(ids[a]), find(ids[b])))
            root[y] = x
    docs = documents(spark, texts, ids)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: (f"{m:016x}", find(i)) for i, m in zip(ids, marks)} == {i: (r.fingerprint, r.component_id) for i, r in got.items()}
    kept = simhash.keep_one(docs.unionByName(docs.limit(5)))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in ids})
    assert simhash.near_duplicates(documents(spark, [])).count() == 0 and simhash.keep_one(documents(spark, [])).count() == 0


def test_near_dedup_keeps_no_near_copy(spark):
    import corpus_pipeline

    rng = random.Random(9)
    made = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = [made(120) for _ in range(20)]
    for base in texts[:20]:
        for changes in (1, 2, 3):
            texts.append([f"new{i}" if i in places else w for places in [rng.sample(range(120), changes)] for i, w in enumerate(base)])
    hub = made(120)  # a chain, each link near only to the next
    for k in range(8):
        hub = hub[2:] + made(2) if k % 2 else [*hub[:-2], *made(2)]
        texts.append(hub)
    texts = [" ".join(t) for t in texts] + ["", None, "one two", "One  two", "three"]
    grams = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in texts)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b]):
            links += 1
            x, y = sorted((find(ids[a]), find(ids[b])))
            root[y] = x
    assert links > 60
    docs = documents(spark, texts, ids)
    kept = corpus_pipeline.near_dedup(spark, docs.unionByName(docs.limit(5)), "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in ids})
    blank = documents(spark, ["x", "x"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert corpus_pipeline.near_dedup(spark, blank, "").count() == 2
    assert corpus_pipeline.near_dedup(spark, documents(spark, []), "").count() == 0


# --- op8 -------------------------------------------------------------------------------------------


def test_paths_are_best():
    rng = np.random.default_rng(0)
    model = language.Model(["a", "b", "c"], np.zeros((1, 3)), np.ones((1, 3), bool), 1.5)
    for _ in range(60):
        sizes = rng.integers(0, 6, 5)
        scores = -rng.integers(0, 4, (sizes.sum(), 3)).astype(float)
        if not len(scores):
            continue
        path, at = model.paths(scores, sizes), 0
        for n in sizes:
            value = lambda q: sum(scores[at + i, q[i]] for i in range(n)) - 1.5 * sum(q[i] != q[i - 1] for i in range(1, n))  # noqa: B023, E731
            if n:
                assert value(path[at : at + n]) == pytest.approx(max(map(value, itertools.product(range(3), repeat=n))))
            at += n


def test_grams_are_those_of_each_word():
    words = ["ab", "c", "straße"]
    bucket, owner = language.grams(words)
    for k, word in enumerate(words):
        assert sorted(bucket[owner == k]) == sorted(language.grams([word])[0])
        marked = f" {word} "
        assert (owner == k).sum() == sum(max(0, len(marked) - n + 1) for n in (2, 3, 4)) + len(word)


def test_language_of_small_tables(spark):
    rng = random.Random(9)
    greek = "και το της που για στο από είναι".split()
    rows = [(i, sentence(rng, 40), "en") for i in range(40)] + [(100 + i, " ".join(rng.choice(greek) for _ in range(40)), "el") for i in range(40)]
    rows += [(200, None, "en"), (201, "", "el"), (202, "123 ... !", "en"), (203, sentence(rng, 10) + " " + " ".join(greek * 5), None), (204, "слово", "en"), (204, "слово", "en")]
    docs = spark.createDataFrame([(*r, "s", 1, True) for r in rows], "doc_id long, text string, lang string, source string, score int, held_out boolean")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert all(got[i].lang_pred == "en" for i in range(40)) and all(got[100 + i].lang_pred == "el" for i in range(40))
    assert [(got[i].lang_pred, got[i].score) for i in (200, 201, 202)] == [("und", 0.0)] * 3
    assert got[203].lang_pred == "el" and 0.5 < got[203].score < 1 and got[204].lang_pred in ("en", "el")
    kept = language.accept(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got) - {200, 201, 202}
    empty = docs.limit(0)
    assert language.identify(empty).count() == 0 and language.accept(empty).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    out = queries.QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    right = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98


# --- op10 ------------------------------------------------------------------------------------------


def plain_overlap(text, item, least=13):
    """Every diagonal in full, without seeds."""
    document, own = decontaminate.words(text), decontaminate.words(item)
    best = max((decontaminate.aligned(document, own, d, least) or (0, 0, 0) for d in range(-len(own), len(document))), key=lambda x: x[2], default=(0, 0, 0))
    return best[2]


def test_substituted_passages_are_found(spark):
    rng = random.Random(10)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnprst"]
    items = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (40, 30, 25, 20, 15, 9, 6, 3)] + [None, ""]
    items.append(items[0].upper())  # the same words: one class, the smaller id
    texts, want = [], set()
    for k, item in enumerate(items[:7]):
        for changes in (0, 1, 2, 3):
            words = item.split()
            if changes and len(words) < 12 or changes > len(words) // 8:
                continue
            for at in rng.sample(range(len(words)), changes):
                words[at] = "zzz"
            want.add((len(texts), k))
            texts.append(", ".join([" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))), *words, "end. " * rng.randint(0, 9)]))
    clean = [" ".join(rng.choice(vocabulary) for _ in range(80)) for _ in range(20)] + [" ".join(items[1].split()[:8]), items[7], None, ""]
    texts += clean
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, seed int")
    docs = documents(spark, texts + texts[:1], [*range(len(texts)), 0])
    found = decontaminate.overlaps(docs, benchmark)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    assert found.count() == len(want)
    for r in found.collect():
        assert r.n_equal == plain_overlap(texts[r.doc_id], items[r.item_id])
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.overlaps(docs.limit(0), benchmark).count() == 0
    assert decontaminate.overlaps(docs, benchmark.limit(0)).count() == 0 and decontaminate.clean(docs, benchmark.limit(0)).count() == len(texts) + 1


def shared(document, item, least=13):
    """Most equal words of any run on any diagonal with at most one word in five substituted, if enough; else 0."""
    best, enough = 0, min(least, -(-4 * len(item) // 5))
    for diagonal in range(-len(item), len(document)):
        same = [item[i] == document[i + diagonal] if 0 <= i + diagonal < len(document) else None for i in range(len(item))]
        for i in range(len(same)):
            equal = 0
            for j in range(i, len(same)):
                if same[j] is None:
                    break
                equal += same[j]
                if 5 * equal >= 4 * (j - i + 1) and equal >= enough:
                    best = max(best, equal)
    return best


def test_one_word_in_five_may_change_anywhere(spark):
    # The finding's own cases, counted from 0: (words of the item, places that change).
    cases = [(15, (3,)), (15, (4,)), (15, (10,)), (15, (5, 10)), (20, (8, 9, 10)), (25, (10, 11, 12, 13)), (11, (3, 7)), (15, (3, 7, 11))]
    rng = random.Random(13)
    for n in (11, 12, 14, 15, 16, 20, 23, 33):
        for _ in range(6):
            at = rng.randrange(n)
            cases.append((n, tuple(rng.sample(range(n), n // 5))))
            cases.append((n, tuple(i for i in range(at, at + n // 5 + rng.randint(0, 1)) if i < n)))
    items = [[f"w{k}x{i}" for i in range(n)] for k, (n, _) in enumerate(cases)]
    texts = [["a", "b"] + ["zzz" if i in at else w for i, w in enumerate(own)] + ["c"] for own, (_, at) in zip(items, cases)]
    want = {(k, k): shared(text, own) for k, (text, own) in enumerate(zip(texts, items))}
    assert all(want[k, k] for k in range(8)) and 0 in want.values()
    benchmark = spark.createDataFrame([(k, " ".join(own)) for k, own in enumerate(items)], "item_id long, text string")
    found = decontaminate.overlaps(documents(spark, [" ".join(t) for t in texts]), benchmark).collect()
    assert {(r.doc_id, r.item_id): r.n_equal for r in found} == {k: v for k, v in want.items() if v}
    assert all(5 * r.n_equal >= 4 * r.n_words for r in found)


def test_masks_lose_no_overlap():
    # A run that counts holds one of these; two halves of one of more than 33 words hold one too.
    masks = [int(m, 2) for m in decontaminate.MASKS]
    for length, changes in ((11, 2), (12, 2), (13, 2), (14, 2), (15, 3), (16, 3), (20, 4), (25, 5), (30, 6)):
        left = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(length), changes)])
        for mask in masks:
            for shift in range(length - mask.bit_length() + 1):
                left = left[left & (mask << shift) != 0]
        assert not len(left)


def test_hits_are_not_broadcast(spark):
    # More items than a document has: Spark takes the exploded hits for the smaller side.
    rng = random.Random(31)
    items = [sentence(rng, 30) for _ in range(300)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.overlaps(documents(spark, [" ".join([items[3]] * 50), "x y z"]), benchmark)
    sides, at = [], None
    for line in found._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        at = None if at is not None and depth <= at else at
        if "BroadcastExchange" in line:
            at = depth
        elif at is not None:
            sides.append(line)
    assert sides and not any("Generate" in line for line in sides)
    assert rows_of(found, "doc_id", "item_id") == [(0, 3)]
