"""Metrics, gates, audits and refusal calibration over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from daftar.catalog.base import WS, query, sql_norm, sql_strip, sql_tokens
from daftar.operators import audits as A
from daftar.operators import evaluation as M
from daftar.operators import lexical as L
from daftar.operators import planning as P
from daftar.operators import refusal as Z

_MEASURES = """
    , ranked AS (SELECT query_id, chunk_id, min(rank) AS rank FROM {hits} GROUP BY query_id, chunk_id),
    measured AS (SELECT p.query_id, any_value(dialect_tag) AS dialect_tag, any_value(source_doc) AS source_doc,
        sum(CASE WHEN rank <= 3 THEN 1 ELSE 0 END) / count(*) AS "recall@3", max(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END) AS "hit@3",
        sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) / count(*) AS "recall@10", max(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS "hit@10",
        coalesce(1.0::DOUBLE / min(rank), 0) AS mrr
      FROM pairs p JOIN qrels g USING (query_id) LEFT JOIN ranked r ON r.query_id = g.query_id AND r.chunk_id = g.chunk_id GROUP BY p.query_id)
"""
_AVG = ", ".join(f'round(avg("{m}"), 6) AS "{m}"' for m in M.METRICS)
_ALL = ", ".join(f'round("{m}", 6) AS "{m}"' for m in M.METRICS)
_LEVELS = f"""SELECT 'all' AS level, '' AS value, count(*) AS n, {_AVG} FROM measured
    UNION ALL SELECT 'dialect_tag', dialect_tag, count(*), {_AVG} FROM measured GROUP BY dialect_tag
    UNION ALL SELECT 'source_doc', source_doc, count(*), {_AVG} FROM measured GROUP BY source_doc"""


def _pairs(t):
    return t.pairs.select("query_id", "dialect_tag", "source_doc")


def _measured(t, idf=False):
    return M.per_query(_pairs(t), L.lexical_search(t.index, t.queries, idf=idf, n_chunks=t.n_chunks), t.qrels)


@query("per_query_metrics", _MEASURES.format(hits="lex") + f"SELECT query_id, {_ALL} FROM measured", ("pairs", "lex"))
def _(t):
    return _measured(t).select("query_id", *(f"`{m}`" for m in M.METRICS))


@query(
    "metrics_on_lists",
    _MEASURES.format(hits="lexidf") + 'SELECT query_id, round("recall@3", 6) AS r3, round("hit@10", 6) AS h10, round(mrr, 6) AS mrr FROM measured',
    ("pairs", "lexidf"),
)
def _(t):
    # the list form: at most the retrieval depth per query
    lists = L.lexical_search(t.index, t.queries, idf=True, n_chunks=t.n_chunks).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda h: h.chunk_id).alias("got")
    )
    gold = t.pairs.where(F.size("source_chunk_ids") > 0).select("query_id", F.col("source_chunk_ids").alias("gold"))
    rows = gold.join(lists, "query_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    return rows.select(
        "query_id", M.recall_at_k(F.col("got"), F.col("gold"), 3).alias("r3"),
        M.hit_at_k(F.col("got"), F.col("gold"), 10).alias("h10"), M.mrr(F.col("got"), F.col("gold")).alias("mrr"),
    )


@query("evaluate", _MEASURES.format(hits="lex") + _LEVELS, ("pairs", "lex"))
def _(t):
    return M.aggregate(_measured(t))


@query("evaluate_idf", _MEASURES.format(hits="lexidf") + _LEVELS, ("pairs", "lexidf"))
def _(t):
    return M.aggregate(_measured(t, idf=True))


@query(
    "unanswerable_line",
    """SELECT count(*) AS n, count(score) AS with_hits, round(coalesce(avg(score), 0), 6) AS top_score_mean, round(coalesce(max(score), 0), 6) AS top_score_max
       FROM pairs LEFT JOIN (SELECT query_id, score FROM lex WHERE rank = 1) t USING (query_id) WHERE len(source_chunk_ids) = 0""",
    ("pairs", "lex"),
)
def _(t):
    return M.unanswerable_line(_pairs(t), t.qrels, L.lexical_search(t.index, t.queries))


_SPLITS = """
    , member AS (SELECT 'all' AS split, query_id, len(source_chunk_ids) > 0 AS answerable FROM labelled
      UNION ALL SELECT dialect_tag, query_id, len(source_chunk_ids) > 0 FROM labelled
      UNION ALL SELECT 'msa_matched', query_id, true FROM labelled WHERE dialect_tag = 'msa' AND len(source_chunk_ids) > 0
        AND source_chunk_ids[1] IN (SELECT source_chunk_ids[1] FROM labelled WHERE dialect_tag = 'gulf' AND len(source_chunk_ids) > 0))
"""


@query("split_pairs", _SPLITS + "SELECT split, query_id, answerable FROM member", ("labelled",))
def _(t):
    return M.split_membership(t.labelled)


# Two deterministic rankings of the labelled documents stand in for two models' measured queries.
_TWO = """
    , two AS (SELECT model, 'dense' AS config, query_id, (n % 10) / 10.0::DOUBLE AS "recall@3", (n % 7) / 7.0::DOUBLE AS "recall@10",
        (n % 2)::DOUBLE AS "hit@3", (n % 3 > 0)::INT::DOUBLE AS "hit@10", 1.0::DOUBLE / (1 + n % 5) AS mrr
      FROM (SELECT 'e5' AS model, query_id, length(question) AS n FROM labelled WHERE len(source_chunk_ids) > 0
            UNION ALL SELECT 'bge', query_id, length(answer) FROM labelled WHERE len(source_chunk_ids) > 0) m),
    cells AS (SELECT model, config, split, count(*) AS n, avg("recall@3") AS "recall@3", avg("recall@10") AS "recall@10", avg("hit@3") AS "hit@3",
        avg("hit@10") AS "hit@10", avg(mrr) AS mrr FROM two JOIN member USING (query_id) GROUP BY model, config, split)
"""


def _cells(t):
    n = F.col("n")
    rows = t.labelled.where(F.size("source_chunk_ids") > 0).select(
        "query_id",
        F.explode(F.array(
            F.struct(F.lit("e5").alias("model"), F.length("question").alias("n")),
            F.struct(F.lit("bge").alias("model"), F.length("answer").alias("n")),
        )).alias("m"),
    ).select("query_id", "m.model", "m.n")
    measured = rows.select(
        "query_id", "model", F.lit("dense").alias("config"),
        ((n % 10) / 10).alias("recall@3"), ((n % 7) / 7).alias("recall@10"), (n % 2).cast("double").alias("hit@3"),
        (n % 3 > 0).cast("double").alias("hit@10"), (1 / (1 + n % 5)).alias("mrr"),
    )
    return M.matrix(measured, M.split_membership(t.labelled))


@query(
    "matrix",
    _SPLITS + _TWO + f"SELECT model, config, split, n, n_pairs, {_ALL} FROM cells JOIN (SELECT split, count(*) AS n_pairs FROM member GROUP BY split) f USING (split)",
    ("labelled",),
)
def _(t):
    return _cells(t)


_GAP = """SELECT model, config, round(max(m) FILTER (WHERE split = 'msa'), 6) AS msa, max(n) FILTER (WHERE split = 'msa') AS n_msa,
    round(max(m) FILTER (WHERE split = 'msa_matched'), 6) AS matched, max(n) FILTER (WHERE split = 'msa_matched') AS n_matched,
    round(max(m) FILTER (WHERE split = 'gulf'), 6) AS gulf, max(n) FILTER (WHERE split = 'gulf') AS n_gulf,
    round((max(m) FILTER (WHERE split = 'gulf') - max(m) FILTER (WHERE split = 'msa_matched')) * 100, 6) AS gap_points,
    round((max(m) FILTER (WHERE split = 'gulf') - max(m) FILTER (WHERE split = 'msa_matched')) * 100 / max(m) FILTER (WHERE split = 'msa_matched'), 6) AS gap_percent
    FROM (SELECT model, config, split, n, "recall@10" AS m FROM cells) c GROUP BY model, config HAVING count(*) FILTER (WHERE split = 'msa_matched') > 0"""


@query("dialect_gap", _SPLITS + _TWO + _GAP, ("labelled",))
def _(t):
    return M.dialect_gap(_cells(t))


@query(
    "headline",
    _SPLITS + _TWO + """SELECT model, config, metric, round(max(v) FILTER (WHERE split = 'msa_matched'), 6) AS matched, round(max(v) FILTER (WHERE split = 'gulf'), 6) AS gulf,
       round((max(v) FILTER (WHERE split = 'gulf') - max(v) FILTER (WHERE split = 'msa_matched')) * 100, 6) AS change_points FROM (
       SELECT model, config, split, 'recall@10' AS metric, "recall@10" AS v FROM cells UNION ALL SELECT model, config, split, 'recall@3', "recall@3" FROM cells
       UNION ALL SELECT model, config, split, 'mrr', mrr FROM cells) c WHERE split IN ('msa_matched', 'gulf') GROUP BY model, config, metric""",
    ("labelled",),
)
def _(t):
    return M.headline(_cells(t))


@query(
    "model_status",
    """SELECT m AS model, CASE WHEN n > 0 THEN 'run' ELSE 'not_run' END AS status, CASE WHEN n > 0 THEN NULL ELSE 'no vectors in the corpus' END AS reason
       FROM (SELECT unnest(['e5', 'bge', 'openai']) AS m) a LEFT JOIN (SELECT CASE WHEN label % 2 = 0 THEN 'e5' ELSE 'bge' END AS m, count(*) AS n FROM embeddings GROUP BY 1) b USING (m)""",
)
def _(t):
    model = F.when(F.col("label") % 2 == 0, "e5").otherwise("bge").alias("model")
    coverage = t.read("embeddings").groupBy(model).agg(F.count(F.lit(1)).alias("n_vectors"))
    models = t.spark.createDataFrame([("e5",), ("bge",), ("openai",)], "model string")
    return M.model_status(coverage, models)


@query(
    "compare_to_baseline",
    _SPLITS + _TWO + """SELECT a.split, round(a.mrr, 6) AS current, round(b.mrr, 6) AS baseline, round((a.mrr - b.mrr) * 100, 6) AS change_points, (b.mrr - a.mrr) * 100 <= 2 + 1e-9 AS passed
       FROM cells a JOIN cells b ON a.split = b.split WHERE a.model = 'e5' AND b.model = 'bge'""",
    ("labelled",),
)
def _(t):
    cells = _cells(t)
    return M.compare_to_baseline(cells.where("model = 'e5'"), cells.where("model = 'bge'"), ["split"], "mrr", 2.0)


_BASE = _MEASURES.format(hits="lex").replace("ranked", "ranked_before").replace("measured", "measured_before")
_MEANS = ", ".join(f'avg("{m}") AS "{m}"' for m in M.METRICS)
_NAMES = ", ".join(f"'{m}'" for m in M.METRICS)
_ROUNDED = ", ".join(f'round("{m}", 4)' for m in M.METRICS)


def _sql_long(measured: str) -> str:
    levels = f"""SELECT 'all' AS level, '' AS value, count(*) AS n, {_MEANS} FROM {measured}
        UNION ALL SELECT 'source_doc', source_doc, count(*), {_MEANS} FROM {measured} GROUP BY source_doc"""
    return f"""SELECT * FROM (SELECT level, value, unnest([{_NAMES}, 'n']) AS metric, unnest([{_ROUNDED}, n::DOUBLE]) AS v FROM ({levels}) l) u
        WHERE level = 'all' OR metric = 'recall@10'"""


@query(
    "gate",
    _MEASURES.format(hits="lexidf") + _BASE + f"""
    SELECT level, value, metric, round(a.v, 6) AS current, round(b.v, 6) AS baseline, round((a.v - b.v) * 100, 6) AS change_points,
      CASE WHEN metric = 'n' THEN CASE WHEN a.v = b.v THEN 'same pairs' ELSE 'warning: other pairs' END
           WHEN metric <> 'recall@10' THEN 'context' WHEN a.v IS NULL THEN 'fail: missing now' WHEN b.v IS NULL THEN 'new'
           WHEN (b.v - a.v) * 100 <= CASE level WHEN 'all' THEN 2 ELSE 5 END + 1e-9 THEN 'pass' ELSE 'fail' END AS verdict
    FROM ({_sql_long('measured')}) a FULL JOIN ({_sql_long('measured_before')}) b USING (level, value, metric)""",
    ("pairs", "lex", "lexidf"),
)
def _(t):
    # current: the weighted rank; baseline: the plain one
    checked = M.gate(M.aggregate(_measured(t, idf=True)), M.aggregate(_measured(t)))
    return checked.select("level", "value", "metric", "current", "baseline", "change_points", "verdict")


@query("entry_keys", "SELECT event_type AS config, CASE WHEN event_type = 'view' THEN 'view' ELSE 'bge:' || event_type END AS entry_key, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    key = M.entry_key(F.col("event_type"), F.lit("bge"), F.col("event_type") != "view").alias("entry_key")
    return t.events.groupBy(F.col("event_type").alias("config"), key).agg(F.count(F.lit(1)).alias("n"))


# --- the matrix over measured lists: a question's vector is that of the document that answers it, else its item's ---


_DIMS = {"e5": 64, "bge": 32}  # two models: the given vectors, and their first half


def _dense_lists(t):
    """One list of each model for every question, searched once and stored."""
    from daftar.operators.dense import dense_search

    answered = t.pairs.select("query_id", F.regexp_extract("source_doc", r"^doc-(\d+)$", 1).alias("n"), F.substr("query_id", F.lit(2)).alias("item"))
    keyed = answered.select("query_id", F.when(F.col("n") != "", F.col("n")).otherwise(F.col("item")).alias("id"))
    out = {}
    for model, dim in _DIMS.items():
        part = t.vectors.select("id", F.slice("embedding", 1, dim).alias("vector"))
        corpus = part.select(F.concat(F.lit("doc-"), "id", F.lit(":p:0")).alias("id"), F.col("vector").alias("embedding"))
        found = dense_search(corpus, keyed.join(part, "id").select("query_id", "vector"), dim=dim)
        out[model] = t.stored(found.select("query_id", "chunk_id", "score", "rank", "source"), f"dense-{model}")
    return out


def _lexical_list(t):
    found = L.lexical_search(t.index, t.queries)
    return t.stored(found.select("query_id", "chunk_id", "score", "rank", "source"), "lexical")


def _sql_lists() -> tuple[str, dict[tuple[str, str], str]]:
    """CTEs of every list, and the name of each by model and config."""
    from daftar.catalog.retrieval_queries import _RRF

    names, parts = {("-", "lexical"): "lex"}, []
    parts.append("""vid AS (SELECT query_id, CASE WHEN regexp_matches(source_doc, '^doc-[0-9]+$') THEN CAST(substr(source_doc, 5) AS BIGINT)
        ELSE CAST(substr(query_id, 2) AS BIGINT) END AS vec_id FROM pairs)""")
    for model, dim in _DIMS.items():
        cut = lambda v, dim=dim: f"list_transform({v}.embedding[1:{dim}], lambda x: x::DOUBLE)"
        parts.append(f"""dense_{model} AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
            SELECT query_id, 'doc-' || c.vec_id || ':p:0' AS chunk_id, round(list_cosine_similarity({cut('v')}, {cut('c')}), 12) AS score
            FROM vid JOIN embeddings v USING (vec_id) CROSS JOIN embeddings c) a) b WHERE rank <= 20)""")
        both = f"(SELECT *, 0 AS list_id FROM dense_{model} UNION ALL SELECT query_id, chunk_id, score, rank, 1 FROM lex)"
        parts.append(f"hybrid_{model} AS (SELECT * FROM ({_RRF.format(lists=both)}) h WHERE rank <= 20)")
        parts.append(f"""rerank_{model} AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, incoming) AS rank FROM (
            SELECT query_id, chunk_id, incoming, CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END AS score FROM (
              SELECT query_id, chunk_id, incoming, len(list_intersect(a, b)) - len(a) / 2.0 AS x FROM (
                SELECT h.query_id, chunk_id, h.rank AS incoming, list_distinct({sql_tokens('lower(' + sql_norm('question') + ')')}) AS a,
                  list_distinct({sql_tokens('lower(' + sql_norm('text') + ')')}) AS b FROM hybrid_{model} h JOIN q USING (query_id) JOIN chunks ON chunks.id = chunk_id) s) o) y)""")
        names |= {(model, "dense"): f"dense_{model}", (model, "hybrid"): f"hybrid_{model}", (model, "hybrid+rerank"): f"rerank_{model}"}
    return ", " + ",\n".join(parts), names


_LISTS, _LIST_NAMES = _sql_lists()
_PAIR_SPLITS = _SPLITS.replace("FROM labelled", "FROM pairs").replace(
    "source_chunk_ids[1] IN (SELECT source_chunk_ids[1]", "list_sort(source_chunk_ids) IN (SELECT list_sort(source_chunk_ids)"
)


def _sql_measured() -> str:
    out = []
    for (model, config), hits in _LIST_NAMES.items():
        out.append(_MEASURES.format(hits=hits).replace("ranked", f"ranked_{hits}").replace("measured", f"measured_{hits}"))
    union = " UNION ALL ".join(f"SELECT '{m}' AS model, '{c}' AS config, * FROM measured_{hits}" for (m, c), hits in _LIST_NAMES.items())
    return "".join(out) + f", every AS ({union})"


@query(
    "full_matrix",
    _LISTS + _sql_measured() + _PAIR_SPLITS + f"""SELECT model, config, split, n, n_pairs, {_ALL} FROM (
        SELECT model, config, split, count(*) AS n, {_MEANS} FROM every JOIN member USING (query_id) GROUP BY model, config, split) c
        JOIN (SELECT split, count(*) AS n_pairs FROM member GROUP BY split) f USING (split)""",
    ("q", "chunks", "pairs", "qrels", "lex"),
)
def _(t):
    from daftar.plans import matrix as X

    measured = X.measured_matrix(_lexical_list(t), _dense_lists(t), t.chunks, t.pairs, t.qrels)
    return M.matrix(measured, M.split_membership(t.pairs))


@query(
    "refusal_matrix",
    _LISTS + " UNION ALL ".join(
        f"""SELECT '{m}' AS model, '{c}' AS config, count(*) AS n, count(score) AS with_hits, round(coalesce(avg(score), 0), 6) AS top_score_mean,
        round(coalesce(max(score), 0), 6) AS top_score_max FROM pairs LEFT JOIN (SELECT query_id, score FROM {hits} WHERE rank = 1) t USING (query_id) WHERE len(source_chunk_ids) = 0"""
        for (m, c), hits in _LIST_NAMES.items()
    ),
    ("q", "chunks", "pairs", "lex"),
)
def _(t):
    from daftar.plans import matrix as X

    return X.refusal_table(_lexical_list(t), _dense_lists(t), t.chunks, t.pairs, t.qrels)


@query(
    "planner_arms",
)
def _(t):
    from daftar import settings as S
    from daftar.catalog.retrieval_queries import CLAUSES, LATIN
    from daftar.operators import fusion as X
    from daftar.plans import retrieval as R

    config = S.RetrievalConfig.named("lexical")
    rules = P.plan_rules(t.queries, LATIN)
    only = rules.withColumn("search_queries", F.array(F.coalesce("rewritten", "original")))
    arms = {"raw": P.plan_noop(t.queries, LATIN), "rewritten": only, "fused": rules,
            "decomposed": P.plan_rules(t.queries, LATIN, CLAUSES, decompose_enabled=True)}
    out = None
    for name, plans in arms.items():
        lists = R.ranked_lists(plans, config, index=t.index)
        asked = plans.select("query_id", F.size("search_queries").alias("n_lists"))
        for depth in (10, 20):
            # The shallower arm is the first ranks of the same lists, fused anew.
            hits = X.fuse_plan(lists.where(F.col("rank") <= depth), limit=depth, keys=asked)
            line = M.summarise(M.per_query(_pairs(t), hits, t.qrels)).withColumns({"arm": F.lit(name), "depth": F.lit(depth)})
            out = line if out is None else out.unionByName(line)
    return out


@query(
    "register_confusion",
    f"""SELECT CAST(sum(CASE WHEN g AND s THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN NOT g AND s THEN 1 ELSE 0 END) AS BIGINT) AS fp,
        CAST(sum(CASE WHEN g AND NOT s THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN NOT g AND NOT s THEN 1 ELSE 0 END) AS BIGINT) AS tn,
        round(sum(CASE WHEN g AND s THEN 1 ELSE 0 END) / sum(CASE WHEN g THEN 1 ELSE 0 END), 6) AS recall,
        round(sum(CASE WHEN g AND s THEN 1 ELSE 0 END) / sum(CASE WHEN s THEN 1 ELSE 0 END), 6) AS precision
        FROM (SELECT lang = 'en' AS g, len(list_filter({sql_tokens('text')}, lambda k: k IN ('the', 'que') OR (starts_with(k, 'xx') AND length(k) >= 5) OR (starts_with(k, 'y') AND substr(k, 2) IN ('the', 'que')))) > 0 AS s FROM documents) d""",
)
def _(t):
    from daftar.catalog.retrieval_queries import LATIN

    tagged = t.docs.select(F.col("text").alias("question"), F.when(F.col("lang") == "en", "gulf").otherwise("msa").alias("dialect_tag"))
    return P.register_confusion(tagged, LATIN)


# --- audits ----------------------------------------------------------------------------------------------


@query(
    "composition",
    f"""SELECT count(*) AS pairs, CAST(sum(CASE WHEN len(source_chunk_ids) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS answerable,
        CAST(sum(CASE WHEN len(source_chunk_ids) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS unanswerable, round(avg(length(question)), 6) AS mean_chars,
        round(avg(len(list_filter(regexp_split_to_array(question, '[{WS}]+'), lambda w: w <> ''))), 6) AS mean_words,
        CAST(min(length(question)) AS BIGINT) AS min_chars, CAST(max(length(question)) AS BIGINT) AS max_chars,
        CAST(sum(len(source_chunk_ids)) AS BIGINT) AS citations, count(DISTINCT source_chunk_ids[1]) AS cited_chunks,
        round(count(DISTINCT source_chunk_ids[1]) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS coverage FROM labelled""",
    ("labelled",),
)
def _(t):
    return A.composition(t.labelled, t.read("documents"))


@query(
    "composition_counts",
    """SELECT 'dialect_tag' AS what, dialect_tag AS value, count(*) AS n FROM labelled GROUP BY dialect_tag
       UNION ALL SELECT 'source_doc', source_doc, count(*) FROM labelled GROUP BY source_doc
       UNION ALL SELECT 'citations', CAST(len(source_chunk_ids) AS VARCHAR), count(*) FROM labelled GROUP BY len(source_chunk_ids)""",
    ("labelled",),
)
def _(t):
    return A.counts_by(t.labelled)


@query(
    "dangling_citations",
    "SELECT query_id, c AS chunk_id FROM (SELECT query_id, unnest(source_chunk_ids) AS c FROM labelled) l WHERE 'doc-' || split_part(substr(c, 4), ':', 1) || ':p:1' NOT IN (SELECT id FROM chunks)",
    ("labelled", "chunks"),
)
def _(t):
    # the corpus of second chunks: documents short enough for one chunk leave their citations dangling
    later = t.chunks.where("seq = 1").select("doc_id")
    named = later.select(F.concat(F.lit("src"), F.substr("doc_id", F.lit(5)), F.lit(":p:0")).alias("id"))
    return A.dangling_citations(t.labelled, named)


@query(
    "pair_problems",
    """SELECT query_id, 'short answer' AS problem FROM labelled WHERE length(trim(answer)) < 40
       UNION ALL SELECT query_id, 'id format' FROM labelled WHERE NOT regexp_matches(query_id, '^p[0-9]{1,2}$')""",
    ("labelled",),
)
def _(t):
    return A.duplicates(t.labelled, r"\Ap[0-9]{1,2}\z", min_question=1, min_answer=40)


@query(
    "parent_mismatches",
    """SELECT a.query_id, a.derived_from, CASE WHEN b.query_id IS NULL THEN 'no parent' ELSE 'other gold set' END AS problem
       FROM labelled a LEFT JOIN labelled b ON b.query_id = a.derived_from
       WHERE a.derived_from IS NOT NULL AND (b.query_id IS NULL OR a.source_chunk_ids <> b.source_chunk_ids)""",
    ("labelled",),
)
def _(t):
    return A.parent_mismatches(t.labelled)


@query(
    "shared_citations",
    "SELECT source_chunk_ids[1] AS gold, count(*) AS n FROM labelled WHERE len(source_chunk_ids) > 0 GROUP BY 1 HAVING count(*) > 1",
    ("labelled",),
)
def _(t):
    return A.shared_citations(t.labelled)


_SETS = f"""
    , sets AS (SELECT tokens, min(id) AS id, count(*) AS members FROM (
        SELECT query_id AS id, list_sort(list_distinct({sql_tokens('lower(' + sql_norm('question') + ')')})) AS tokens FROM turns) a WHERE len(tokens) > 0 GROUP BY tokens)
"""


@query(
    "near_duplicates",
    ", turns AS (SELECT doc_id AS query_id, text AS question FROM docs)" + _SETS + """
    , j AS (SELECT a.id, b.id AS other, a.members * b.members AS pairs, len(list_intersect(a.tokens, b.tokens)) AS c, len(a.tokens) + len(b.tokens) AS s
       FROM sets a JOIN sets b ON a.id < b.id AND 10 * len(a.tokens) >= 8 * len(b.tokens) AND 10 * len(b.tokens) >= 8 * len(a.tokens))
    SELECT id, other, round(c / (s - c), 6) AS jaccard, pairs FROM j WHERE c / (s - c) >= 0.8
    UNION ALL SELECT id, id, 1.0, CAST(members * (members - 1) / 2 AS BIGINT) FROM sets WHERE members > 1""",
    ("docs",),
)
def _(t):
    return A.near_duplicates(t.docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("question")), 0.8)


_SETS = "SELECT min(id) AS id, count(*) AS members, toks FROM ({rows}) r WHERE len(toks) > 0 GROUP BY toks"
_SET = "list_sort(list_distinct({})) AS toks"
_ASKED = "SELECT query_id AS id, " + _SET.format(sql_tokens(f"lower({sql_norm('question')})")) + " FROM q"
_SAID = (
    "SELECT id || '#' || (n - 1) AS id, " + _SET.format(sql_tokens(f"lower({sql_norm('part')})"))
    + " FROM (SELECT id, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM (SELECT id, list_filter("
    + f"regexp_split_to_array(text, '[.!?؟؛\\n]+'), lambda s: {sql_strip('s')} <> '') AS parts FROM chunks) c) s"
)


@query(
    "leakage",
    f"""SELECT id, sentence_id, round(common / (n + m - common), 6) AS jaccard, pairs FROM (
        SELECT l.id, r.id AS sentence_id, len(list_intersect(l.toks, r.toks)) AS common, len(l.toks) AS n, len(r.toks) AS m, l.members * r.members AS pairs
        FROM ({_SETS.format(rows=_ASKED)}) l CROSS JOIN ({_SETS.format(rows=_SAID)}) r) p
        WHERE common / (n + m - common) >= 0.6""",
    ("q", "chunks"),
)
def _(t):
    return A.leakage(t.queries, t.chunks, 0.6)


@query(
    "grounding",
    f"""SELECT query_id, chunk_id, round(len(list_intersect(mine, theirs)) / len(mine), 6) AS grounding FROM (
        SELECT p.query_id, chunk_id, list_distinct({sql_tokens('lower(' + sql_norm('answer') + ')')}) AS mine, {sql_tokens('lower(text_normalized)')} AS theirs
        FROM pairs p JOIN qrels USING (query_id) JOIN chunks ON chunks.id = chunk_id) g""",
    ("pairs", "qrels", "chunks"),
)
def _(t):
    return A.grounding(t.pairs, t.chunks)


@query(
    "grounding_summary",
    f"""SELECT count(*) AS n, round(min(g), 6) AS least, round(quantile_disc(g, 0.5), 6) AS median FROM (
        SELECT len(list_intersect(mine, theirs)) / len(mine) AS g FROM (
        SELECT list_distinct({sql_tokens('lower(' + sql_norm('answer') + ')')}) AS mine, {sql_tokens('lower(text_normalized)')} AS theirs
        FROM pairs p JOIN qrels USING (query_id) JOIN chunks ON chunks.id = chunk_id) g) s""",
    ("pairs", "qrels", "chunks"),
)
def _(t):
    return A.grounding_summary(A.grounding(t.pairs, t.chunks))


# --- refusal ----------------------------------------------------------------------------------------------

_GRID = ", grid AS (SELECT round(i * 0.01, 6) AS threshold FROM range(0, 91) r(i))"
_POINTS = _GRID + """
    , points AS (SELECT threshold, CAST(sum(CASE WHEN NOT answerable AND top_score < threshold THEN 1 ELSE 0 END) AS BIGINT) AS true_refusals,
        CAST(sum(CASE WHEN answerable AND top_score < threshold THEN 1 ELSE 0 END) AS BIGINT) AS false_refusals,
        CAST(sum(CASE WHEN answerable AND top_score >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS true_answers,
        CAST(sum(CASE WHEN NOT answerable AND top_score >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS false_answers
      FROM grid CROSS JOIN scored GROUP BY threshold),
    rated AS (SELECT *, coalesce(true_refusals / nullif(true_refusals + false_refusals, 0), 0) AS precision,
        coalesce(true_refusals / nullif(true_refusals + false_answers, 0), 0) AS recall,
        coalesce(false_refusals / nullif(false_refusals + true_answers, 0), 0) AS frr FROM points)
"""


@query(
    "score_pairs",
    "SELECT query_id AS pair_id, len(source_chunk_ids) > 0 AS answerable, round(coalesce(score, 0), 6) AS top_score FROM pairs LEFT JOIN (SELECT query_id, score FROM lex WHERE rank = 1) t USING (query_id)",
    ("pairs", "lex"),
)
def _(t):
    return Z.score_pairs(t.pairs, L.lexical_search(t.index, t.queries))


@query("threshold_sweep", _POINTS + "SELECT * FROM points", ("scored",))
def _(t):
    return Z.sweep(t.scored, Z.thresholds())


@query(
    "refusal_rates",
    _POINTS + """SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(frr, 6) AS false_refusal_rate,
       round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, round(coalesce(frr / nullif(recall + frr, 0), 0), 6) AS break_even_prevalence FROM rated""",
    ("scored",),
)
def _(t):
    return Z.with_rates(Z.sweep(t.scored, Z.thresholds())).select("threshold", "precision", "recall", "false_refusal_rate", "f1", "break_even_prevalence")


@query(
    "recommend_threshold",
    _POINTS + """SELECT threshold, frr <= 0.1 AND precision >= 0.5 AS eligible, round(precision, 6) AS precision, round(recall, 6) AS recall, round(frr, 6) AS false_refusal_rate,
       round((SELECT max(precision) FROM rated), 6) AS best_precision FROM rated
       ORDER BY NOT (frr <= 0.1 AND precision >= 0.5), CASE WHEN frr <= 0.1 AND precision >= 0.5 THEN -recall ELSE 0 END, frr, threshold LIMIT 1""",
    ("scored",),
)
def _(t):
    return Z.recommend(Z.with_rates(Z.sweep(t.scored, Z.thresholds()))).drop("reason", "f1")


_TAGGED = ", tagged AS (SELECT s.*, dialect_tag FROM scored s JOIN labelled l ON l.query_id = s.pair_id)"
_POPS = _TAGGED + ", pops AS (SELECT 'all' AS population, answerable, top_score FROM tagged UNION ALL SELECT dialect_tag, answerable, top_score FROM tagged)"


@query(
    "refusal_by_dialect",
    _TAGGED + "SELECT dialect_tag, count(*) AS n, CAST(sum(CASE WHEN top_score < 0.3 THEN 1 ELSE 0 END) AS BIGINT) AS refused, round(sum(CASE WHEN top_score < 0.3 THEN 1 ELSE 0 END) / count(*), 6) AS rate FROM tagged WHERE answerable GROUP BY dialect_tag",
    ("scored", "labelled"),
)
def _(t):
    return Z.refusal_by_dialect(t.scored, t.labelled, 0.3)


_AUC = "coalesce(round(sum(CASE WHEN u.top_score < a.top_score THEN 1.0 WHEN u.top_score = a.top_score THEN 0.5 ELSE 0 END) / nullif(count(*), 0), 6), 0)"


@query(
    "auc",
    f"""SELECT {_AUC} AS auc, (SELECT count(*) FROM scored WHERE answerable) AS n_answerable, (SELECT count(*) FROM scored WHERE NOT answerable) AS n_unanswerable
        FROM (SELECT * FROM scored WHERE answerable) a CROSS JOIN (SELECT * FROM scored WHERE NOT answerable) u""",
    ("scored",),
)
def _(t):
    return Z.auc(t.scored)


@query(
    "score_distribution",
    _POPS + """SELECT population, answerable, count(*) AS n, min(v) AS min, max(v) FILTER (WHERE i = floor(0.25 * (c - 1) + 0.5)) AS p25,
       max(v) FILTER (WHERE i = floor(0.5 * (c - 1) + 0.5)) AS median, max(v) FILTER (WHERE i = floor(0.75 * (c - 1) + 0.5)) AS p75, max(v) AS max FROM (
       SELECT population, answerable, top_score AS v, row_number() OVER (PARTITION BY population, answerable ORDER BY top_score) - 1 AS i,
              count(*) OVER (PARTITION BY population, answerable) AS c FROM pops) x GROUP BY population, answerable""",
    ("scored", "labelled"),
)
def _(t):
    return Z.distribution(t.scored, t.labelled)


@query(
    "separability",
    _POPS + f"""SELECT population, {_AUC} AS auc, count(DISTINCT a.rowid) AS n_answerable, count(DISTINCT u.rowid) AS n_unanswerable
        FROM (SELECT *, row_number() OVER () AS rowid FROM pops WHERE answerable) a JOIN (SELECT *, row_number() OVER () AS rowid FROM pops WHERE NOT answerable) u USING (population) GROUP BY population
        UNION ALL SELECT 'msa over gulf', {_AUC}, count(DISTINCT a.pair_id), count(DISTINCT u.pair_id)
        FROM (SELECT * FROM tagged WHERE answerable AND dialect_tag = 'msa') a CROSS JOIN (SELECT * FROM tagged WHERE answerable AND dialect_tag = 'gulf') u""",
    ("scored", "labelled"),
)
def _(t):
    return Z.separability(t.scored, t.labelled)


@query(
    "audit_refused",
    """SELECT p.query_id AS pair_id, dialect_tag, round(t.score, 6) AS top_score, count(h.rank) > 0 AS gold_in_context, coalesce(min(h.rank), 0) = 1 AS gold_at_rank_1
       FROM pairs p JOIN (SELECT query_id, score FROM lex WHERE rank = 1) t USING (query_id) JOIN qrels g USING (query_id)
       LEFT JOIN lex h ON h.query_id = p.query_id AND h.chunk_id = g.chunk_id AND h.rank <= 5 WHERE t.score < 8 GROUP BY p.query_id, dialect_tag, t.score""",
    ("pairs", "lex"),
)
def _(t):
    hits = L.lexical_search(t.index, t.queries)
    return Z.audit_refused(Z.score_pairs(t.pairs, hits), t.pairs, hits.where("rank <= 5"), 8.0)


@query(
    "score_margins",
    "SELECT query_id, round(max(score) - min(score), 6) AS margin FROM lex WHERE rank <= 5 GROUP BY query_id",
    ("lex",),
)
def _(t):
    return Z.margins(L.lexical_search(t.index, t.queries))


@query(
    "score_drift",
    """SELECT coalesce(d.id, l.id) AS pair_id, CASE WHEN l.id IS NULL THEN 'unscored' ELSE 'stale' END AS status FROM (SELECT 'p' || doc_id AS id FROM documents WHERE lang <> 'fr') d
       FULL JOIN (SELECT 'p' || doc_id AS id FROM labels) l ON d.id = l.id WHERE d.id IS NULL OR l.id IS NULL""",
)
def _(t):
    current = t.read("documents").where("lang <> 'fr'").select(F.concat(F.lit("p"), "doc_id").alias("query_id"))
    return Z.score_drift(t.scored, current)


@query(
    "threshold_sweep_by_dialect",
    _TAGGED + _GRID + """SELECT dialect_tag, threshold, CAST(sum(CASE WHEN NOT answerable AND top_score < threshold THEN 1 ELSE 0 END) AS BIGINT) AS true_refusals,
       CAST(sum(CASE WHEN answerable AND top_score < threshold THEN 1 ELSE 0 END) AS BIGINT) AS false_refusals FROM grid CROSS JOIN tagged GROUP BY dialect_tag, threshold""",
    ("scored", "labelled"),
)
def _(t):
    tags = t.labelled.select(F.col("query_id").alias("pair_id"), "dialect_tag")
    points = Z.sweep(t.scored.join(tags, "pair_id"), Z.thresholds(), ["dialect_tag"])
    return points.select("dialect_tag", "threshold", "true_refusals", "false_refusals")
