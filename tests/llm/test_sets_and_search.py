"""Near copies by circulant MinHash, source divergences and ball-tree search, each against a plain version."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from daftar.llm import balltree, divergence, minhash
from daftar.llm.common import Scratch
from daftar.llm.graph import components
from daftar.llm.sieve import sieve

DOCS = "doc_id long, text string, lang string, source string, n int, node string, block int, rank string, term string"


def documents(spark, rows):
    """(doc_id, text, lang, source) with further columns whose names the operators use for their own."""
    return spark.createDataFrame([(*row, 1, "x", 2, "y", "z") for row in rows], DOCS)


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


# --- sieve and components --------------------------------------------------------------------------


def test_sieve_loses_no_key(spark):
    keys = spark.range(0, 40_000, 7).select((F.col("id") * 7919 - 5).alias("key"))
    built = sieve(keys, 5715)
    inside = np.arange(0, 40_000, 7) * 7919 - 5
    assert built.passes(inside).all()
    assert built.passes(np.random.default_rng(1).integers(-(2**62), 2**62, 10_000)).mean() < 0.05


def test_components_of_paths_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 1400)] + [(2000, 2000), (1500, 1499)]
    table = spark.createDataFrame(edges, "low long, high long")
    found = dict(tuple(r) for r in components(table, Scratch(spark, "test")).collect())
    assert {found.get(i, i) for i in range(41)} == {0}
    assert {found.get(i, i) for i in range(100, 1400)} == {100}
    assert found.get(1500) == 1499 and found.get(2000, 2000) == 2000
    assert components(table.limit(0), Scratch(spark, "test")).count() == 0


def test_components_plan_no_round_that_changes_nothing(spark, monkeypatch):
    """The driver pays for every round: stars need none, and what one round settles needs no second."""
    stored = []
    put = Scratch.put
    monkeypatch.setattr(Scratch, "put", lambda self, df, name: stored.append(name) or put(self, df, name))
    stars = [(k, k + i) for k in (0, 100) for i in range(1, 30)] + [(500, 500), (7, 0)]
    chain = [(1, 5), (5, 9)]
    hub = [(9999, i) for i in range(3000)]  # a high one: its neighbours become those of 0
    for edges, most in ((stars, 1), (chain, 3), (hub, 3)):
        stored.clear()
        found = [tuple(r) for r in components(spark.createDataFrame(edges, "low long, high long"), Scratch(spark, "test")).collect()]
        nodes = {x for e in edges for x in e}
        if edges is stars:
            want = {x: 0 if x < 100 else 100 if x < 500 else 500 for x in nodes}
        else:
            want = dict.fromkeys(nodes, min(nodes))
        assert len(found) == len(nodes) and dict(found) == want and len(stored) <= most, stored


# --- op11 ------------------------------------------------------------------------------------------


def plain_links(texts, percent=85):
    sets = []
    for text in texts:
        words = [w for w in re.split("[\x20\x09-\x0d]+", lowered(text)) if w]
        sets.append({tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, one in enumerate(sets):
        for j, other in enumerate(sets[:i]):
            if one and other and 100 * len(one & other) >= percent * len(one | other):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def near_texts(rng):
    words = [f"w{i}" for i in range(400)] + ["É", "日本"]
    texts = [None, "", " \n\x0b", "a", "A", "a b", "b a", "a\tb", "x y z"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        texts.append(" ".join(base))
        now = base
        for _ in range(rng.randint(0, 8)):
            now = list(now if rng.random() < 0.5 else base)
            for _ in range(rng.randint(0, max(1, len(now) // 30))):
                now[rng.randrange(len(now))] = rng.choice(words)
            texts.append(" ".join(now))
    hub = [rng.choice(words) for _ in range(150)]
    for _ in range(100):
        copy = list(hub)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(150)] = rng.choice(words)
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("cell", [1 << 19, 2000])
def test_minhash_components_agree_with_all_pairs(spark, cell):
    texts = near_texts(random.Random(11))
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    found = sorted(tuple(r) for r in minhash.near_duplicates(docs, cell=cell).collect())
    assert found == plain_links(texts)


def test_minhash_at_the_threshold():
    words = [f"w{i}" for i in range(200)]
    one = set(words[:85])
    sets = [np.array(sorted(map(hash, s)), np.int64).view(np.uint64) for s in (one, one | set(words[100:115]), one | set(words[100:116]))]
    keys = np.ones((3, 2), np.int64)
    assert minhash.spanning_links([np.sort(s) for s in sets[:2]], keys[:2], np.arange(2)) == [(0, 1)]  # 85 of 100
    assert minhash.spanning_links([np.sort(s) for s in (sets[0], sets[2])], keys[:2], np.arange(2)) == []  # 85 of 101
    assert minhash.spanning_links([np.sort(s) for s in sets[:2]], np.arange(4).reshape(2, 2), np.arange(2)) == []  # no band


def test_signature_shifts_one_permutation():
    rng = np.random.default_rng(2)
    one, two = rng.integers(0, 2**64, 600, np.uint64), rng.integers(0, 2**64, 600, np.uint64)
    shared = rng.integers(0, 2**64, 1400, np.uint64)
    a, b = (minhash.signature(np.unique(np.concatenate([shared, own]))) for own in (one, two))
    whole = 1400 / 2600
    assert abs((a == b).mean() - whole) < 3 * math.sqrt(whole * (1 - whole) / len(a))
    assert len(np.unique(a)) == len(a)


def test_minhash_null_ids_repeats_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = text.replace("w30", "v30")
    rows = [(None, text, "en", "s"), (7, text, None, None), (7, text, "en", "s"), (5, other, "en", "s"), (5, "alone here now", "en", "s"), (9, None, "", "")]
    found = sorted((tuple(r) for r in minhash.near_duplicates(documents(spark, rows)).collect()), key=str)
    assert found == sorted([(None, 58, None, None), (7, 58, 5, False), (7, 58, 5, False), (5, 58, 5, True), (5, 1, 5, True), (9, 0, 9, True)], key=str)
    assert minhash.near_duplicates(documents(spark, rows).limit(0)).count() == 0


# --- op12 ------------------------------------------------------------------------------------------


def plain_audit(rows, least=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered(text))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = lambda n, whole: 1 + 10**9 * (n + 2) // (whole + 2 * len(kept))
        p = {s: [share(counts[lang, s][t], total[s]) for t in kept] for s in sources}
        q = [share(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept]
        for s in sources:
            pairs = [(-sum((a - b) ** 2 // (a + b) for a, b in zip(p[s], p[o])), o.encode(), o) for o in sources if o != s]
            typical = [(-((a - b) ** 2 // (a + b)), t.encode(), t) for t, a, b in zip(kept, p[s], q) if counts[lang, s][t] and a > b]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(typical)[:10])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("shape", [{}, {"tile": 2, "shard": 40}])
def test_divergence_agrees_with_plain_version(spark, shape):
    rng = random.Random(5)
    words = [f"{'ab'[i % 2]}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["É", "é", "日本"]
    rows = [(None, "en", "only nulls"), ("", "en", None), (None, None, None), ("1 2 3", "xx", "a"), ("some words", "xx", "b"), ("lone", "yy", "one")]
    for _ in range(400):
        source = rng.choice(["s1", "s1", "s1", "s2", "s3", "é", None])
        pool = words if source == "s1" else words[rng.randint(0, 30) :]
        rows.append((" ".join(rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(0, 30))), rng.choice(["en", "fr", None]), source))
    rows += [rows[-1]] * 3
    docs = documents(spark, [(i, *row) for i, row in enumerate(rows)])
    found = divergence.audit(docs, **shape).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(tuple(r) for r in found.collect()) == plain_audit(rows)


def test_divergence_shares_do_not_overflow():
    count, total = np.array([9_000_000_000_000, 0]), np.array([9_000_000_000_500, 10**15])
    want = [1 + 10**9 * (int(c) + 2) // (int(t) + 2 * 250) for c, t in zip(count, total)]
    assert divergence.share(count, total, 250).tolist() == want


def test_divergence_of_nothing(spark):
    assert divergence.audit(documents(spark, []).limit(0)).count() == 0


def test_partial_counts_flush_and_long_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "_HELD", 8)
    texts = ["a b a", "b C-c", None, "é " * 5000, "1 2", "d e f g h i j k l m"]
    batch = pa.record_batch([pa.array(["en"] * 6), pa.array(["s", None, "s", "s", "t", "s"]), pa.array(texts)], ["lang", "source", "text"])
    total = Counter()
    for out in divergence.partial_counts(iter([batch.slice(0, 2), batch.slice(2)])):
        for row in out.to_pylist():
            total[row["source"], row["term"]] += row["n"]
    assert total["s", "a"] == 2 and total["", "c"] == 2 and total["s", "é"] == 5000 and total["s", "m"] == 1
    assert ("t", "1") not in total


# --- op13 ------------------------------------------------------------------------------------------


def plain_search(docs, items, k=10):
    split = lambda text: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lowered(text))
    counted = [(i, Counter(split(t))) for i, t in docs if split(t)]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        asked = Counter(split(text))
        scored = []
        for doc, own in counted:
            m = 25 + 75 * sum(own.values()) * n_docs // n_terms
            value = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + 8 * m))
                for t, times in asked.items()
                if own[t]
            )
            if value > 0:
                scored.append((-value, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -value) for rank, (value, _, _, doc) in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=str)


def search_case(rng, n_docs):
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(2000)] + ["É", "日本", "x-y"]
    docs = [(i, " ".join(rng.choice(words).capitalize() for _ in range(rng.randint(0, 40)))) for i in range(n_docs)]
    docs += [(n_docs + i, docs[5][1]) for i in range(25)] + [(None, docs[5][1]), (None, None), (3, "w1 w2"), (n_docs + 40, "w7 " * 30000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(20)]
    items += [(100, docs[5][1]), (101, None), (102, "nowhere"), (103, "w1 w1 w1"), (None, "w2 w3")]
    return docs, items


@pytest.mark.parametrize("chunk", [4_000_000, 300])
def test_search_agrees_with_plain_version(spark, chunk):
    docs, items = search_case(random.Random(13), 400)
    table = documents(spark, [(*d, "en", "s") for d in docs])
    asked = spark.createDataFrame([(*i, "x", 1) for i in items + items[:2]], "item_id long, text string, doc_id string, score int")
    found = balltree.search(table, asked, chunk_chars=chunk)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_search(docs, items)
    assert balltree.search(table.limit(0), asked).count() == 0
    assert balltree.search(table, asked.limit(0)).count() == 0


def page_of(rng, n, n_terms):
    """Documents in clusters, as arrays of a page."""
    centres = [rng.choice(n_terms, 12, replace=False) for _ in range(20)]
    rows = []
    for _ in range(n):
        own = np.unique(np.concatenate([rng.choice(centres[rng.integers(20)], 8, replace=False), rng.integers(0, n_terms, 2)]))
        rows.append((own, rng.integers(1, 10**6, len(own))))
    starts = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])])
    return np.arange(n), starts, np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])


def test_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    weights = rng.integers(0, 9000, 300)
    weights[:5] = 0
    ids, starts, codes, values = page_of(rng, 1500, 300)
    flat, spans = [], [0]
    for _ in range(30):
        own = np.unique(rng.choice(codes[starts[(at := rng.integers(1500))] : starts[at + 1]], 6))
        flat.append(own)
        spans.append(spans[-1] + len(own))
    asked = np.concatenate(flat)
    items = balltree.Items(np.array(spans), asked, weights[asked] * rng.integers(1, 3, len(asked)), weights)
    tree = balltree.Tree(ids, starts, codes, values, items)
    visited = 0
    for q in range(30):
        part = slice(spans[q], spans[q + 1])
        dense = np.zeros(300, np.int64)
        dense[items.codes[part]] = items.values[part]
        scores = np.add.reduceat(dense[tree.codes] * tree.values, tree.starts[:-1])
        bounds = tree.bounds(items.codes[part], items.values[part], items)
        for low, high, bound in zip(tree.lows, tree.highs, bounds):
            assert scores[low:high].max() <= bound
        none = np.empty(0, np.int64)
        (found, names), leaves = tree.search(dense, bounds, (none, none), 10)
        order = np.lexsort((tree.ids, -scores))[:10]
        order = order[scores[order] > 0]
        assert found.tolist() == scores[order].tolist() and names.tolist() == tree.ids[order].tolist()
        visited += leaves
    total = sum(pair is None for pair in tree.children)
    assert visited < 0.7 * 30 * total
