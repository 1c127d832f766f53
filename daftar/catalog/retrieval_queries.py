"""Planning, retrieval, fusion, context and the answer cache over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from daftar import settings as S
from daftar.catalog.base import query, sql_norm, sql_tokens
from daftar.functions import text as T
from daftar.operators import cache as K
from daftar.operators import citations as Z
from daftar.operators import dense as D
from daftar.operators import embedding as E
from daftar.operators import fusion as X
from daftar.operators import lexical as L
from daftar.operators import planning as P
from daftar.operators import vector_index as V
from daftar.plans import retrieval as R

HITS = ("query_id", "chunk_id", "score", "rank")

# --- planning: Latin stand-ins for the vocabularies, since the tables hold no Arabic -----------------

LATIN = P.Dialect(
    markers=("the", "que"), replacements={"the": "a", "and": "also", "que": "lo que", "for": "with"},
    prefix="xx", prefix_becomes="x", conjunction="y", conjunction_blocklist=("es",),
)
_IS_GULF = (
    "len(list_filter({tokens}, lambda k: k IN ('the', 'que') OR (starts_with(k, 'xx') AND length(k) >= 5)"
    " OR (starts_with(k, 'y') AND substr(k, 2) IN ('the', 'que')))) > 0"
)
_MAPPED = "CASE {x} WHEN 'the' THEN 'a' WHEN 'and' THEN 'also' WHEN 'que' THEN 'lo que' WHEN 'for' THEN 'with' WHEN 'yand' THEN 'yalso' WHEN 'ythe' THEN 'ya' ELSE {x} END"


def _sql_register(text: str) -> str:
    return f"CASE WHEN {_IS_GULF.format(tokens=sql_tokens(text))} THEN 'gulf' ELSE 'msa' END"


def _sql_rewrite(text: str) -> str:
    parts = f"regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')"
    return f"array_to_string(list_transform({parts}, lambda x: {_MAPPED.format(x='x')}), '')"


def _turns(t):
    return t.read("conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("question"), "role"
    )


_TURNS = "SELECT conv_id || '-' || turn AS query_id, text AS question, role FROM conversations"


@query("detect_register", f"SELECT query_id, {_sql_register('question')} AS register FROM ({_TURNS}) t")
def _(t):
    return _turns(t).select("query_id", P.detect_register("question", LATIN).alias("register"))


@query("rewrite_dialect", f"SELECT query_id, {_sql_rewrite('question')} AS rewritten FROM ({_TURNS}) t")
def _(t):
    return _turns(t).select("query_id", P.rewrite("question", LATIN).alias("rewritten"))


_WORDS = "VALUES ('the', 'replacement'), ('and', 'replacement'), ('que', 'replacement'), ('for', 'replacement'), ('the', 'marker'), ('que', 'marker'), ('zzz', 'unused')"


@query(
    "lexicon_audit",
    f"""SELECT category, key, coalesce(n, 0) AS used, coalesce(turns, 0) AS turns FROM ({_WORDS}) w(key, category) LEFT JOIN (
        SELECT key, count(*) AS n, count(DISTINCT (conv_id, turn)) AS turns FROM (
          SELECT conv_id, turn, unnest({sql_tokens(sql_norm('trim(text)'))}) AS key FROM conversations) u GROUP BY key) k USING (key)""",
)
def _(t):
    """How often the words that plans rewrite occur in the given conversations, and in how many turns."""
    rows = [(k, "replacement") for k in LATIN.replacements] + [(k, "marker") for k in LATIN.markers] + [("zzz", "unused")]
    lexicon = t.spark.createDataFrame(rows, "key string, category string")
    words = _turns(t).select("query_id", F.explode(T.tokens(T.normalize_query("question"))).alias("key"))
    used = words.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("turns"))
    found = F.broadcast(lexicon).join(used, "key", "left")
    return found.select("category", "key", F.coalesce("n", F.lit(0)).alias("used"), F.coalesce("turns", F.lit(0)).alias("turns"))


_LEXICON = """SELECT CASE WHEN user_id % 5 = 0 THEN '  ' ELSE '' END || 'k' || (user_id % 50) AS key,
    CASE WHEN user_id % 3 = 0 THEN 'k' || (user_id % 7) ELSE 'v' || (event_id % 2) END AS value FROM events"""


@query(
    "lexicon_problems",
    f"""WITH x AS ({_LEXICON})
        SELECT key, 'conflicting values' AS problem FROM x GROUP BY key HAVING count(DISTINCT value) > 1
        UNION ALL SELECT DISTINCT key, 'key not normalized' FROM x WHERE key <> trim(key)
        UNION ALL SELECT DISTINCT key, 'value is a key' FROM x WHERE value IN (SELECT key FROM x)""",
)
def _(t):
    # a lexicon made from the event table that breaks each rule
    number = F.col("user_id")
    key = F.concat(F.when(number % 5 == 0, F.lit("  ")).otherwise(""), F.lit("k"), (number % 50).cast("string"))
    value = F.when(number % 3 == 0, F.concat(F.lit("k"), (number % 7).cast("string"))).otherwise(F.concat(F.lit("v"), (F.col("event_id") % 2).cast("string")))
    return P.lexicon_problems(t.events.select(key.alias("key"), value.alias("value"), F.lit("made").alias("category")))


CLAUSES = P.Clauses(
    conjunction="th", stems=("the", "at"), asking=("the", "is", "que", "de"), proclitics=("t",), comma=",",
    sentence_end=".", trim=" \t\n,;.",
)


@query("decompose")
def _(t):
    parts = _turns(t).select("query_id", P.decompose("question", CLAUSES).alias("parts"))
    return parts.select("query_id", F.size("parts").alias("n"), F.array_join("parts", " | ").alias("parts"))


@query(
    "plan_noop",
    f"SELECT query_id, trim(question) AS search, {_sql_register('question')} AS register, 'noop' AS strategy FROM ({_TURNS}) t",
)
def _(t):
    plans = P.plan_noop(_turns(t), LATIN)
    return plans.select("query_id", F.element_at("search_queries", 1).alias("search"), "register", "strategy")


@query(
    "plan_rules",
    f"""SELECT query_id, register, CASE WHEN register = 'gulf' AND r <> question THEN question || ' | ' || trim(r) ELSE question END AS searches,
        CASE WHEN register = 'gulf' AND r <> question THEN r END AS rewritten FROM (
        SELECT query_id, question, {_sql_register('question')} AS register, {_sql_rewrite('question')} AS r FROM (SELECT query_id, trim(question) AS question FROM ({_TURNS}) a) t) u""",
)
def _(t):
    plans = P.plan_rules(_turns(t), LATIN)
    return plans.select("query_id", "register", F.array_join("search_queries", " | ").alias("searches"), "rewritten")


@query("plan_decomposed")
def _(t):
    plans = P.plan_rules(_turns(t), LATIN, CLAUSES, decompose_enabled=True)
    return plans.select("query_id", F.size("search_queries").alias("n"), F.array_join("search_queries", " | ").alias("searches"))


@query(
    "plan_from_replies",
    f"""SELECT query_id, CASE role WHEN 'user' THEN 'rules' ELSE 'llm' END AS strategy,
        CASE role WHEN 'user' THEN CASE WHEN register = 'gulf' AND r <> question THEN r END ELSE role END AS rewritten,
        CASE role WHEN 'user' THEN CASE WHEN register = 'gulf' AND r <> question THEN question || ' | ' || trim(r) ELSE question END
          ELSE question || ' | ' || role || ' | sub' END AS searches FROM (
        SELECT query_id, question, role, {_sql_register('question')} AS register, {_sql_rewrite('question')} AS r FROM (SELECT query_id, trim(question) AS question, role FROM ({_TURNS}) a) t) u""",
)
def _(t):
    good = F.concat(F.lit('sure: {"rewritten": "'), "role", F.lit('", "sub_queries": ["sub", " sub "]} done'))
    replies = _turns(t).withColumn("reply", F.when(F.col("role") == "user", F.lit("{broken")).otherwise(good))
    plans = P.plan_from_replies(replies, LATIN)
    return plans.select("query_id", "strategy", "rewritten", F.array_join("search_queries", " | ").alias("searches"))


# --- legs -----------------------------------------------------------------------------------------------


@query("lexical_search", "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM lex", ("lex",))
def _(t):
    return L.lexical_search(t.index, t.queries).select(*HITS)


@query("lexical_search_idf", "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM lexidf", ("lexidf",))
def _(t):
    return L.lexical_search(t.index, t.queries, idf=True, n_chunks=t.n_chunks).select(*HITS)


@query(
    "lexical_search_all_terms",
    """SELECT query_id, chunk_id, round(0.1 * mass, 6) AS score, rank FROM (
       SELECT query_id, chunk_id, mass, row_number() OVER (PARTITION BY query_id ORDER BY mass DESC, chunk_id) AS rank FROM (
         SELECT query_id, chunk_id, CAST(sum(tf) AS DOUBLE) AS mass FROM qterms JOIN post USING (term)
         JOIN (SELECT query_id, count(*) AS n FROM qterms GROUP BY query_id) n USING (query_id)
         GROUP BY query_id, chunk_id, n HAVING count(*) = n) a) b WHERE rank <= 20""",
    ("qterms", "post"),
)
def _(t):
    return L.lexical_search(t.index, t.queries, require_all=True).select(*HITS)


@query("dense_search", "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM dense", ("dense",))
def _(t):
    return D.dense_search(t.vectors, t.vector_queries).select(*HITS)


@query("dense_search_blocks", "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM dense", ("dense",))
def _(t):
    return D.dense_search(t.vectors, t.vector_queries, broadcast_values=0, block_rows=300).select(*HITS)


@query("dense_search_index", "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM dense", ("dense",))
def _(t):
    return V.exact_search(t.vector_index, t.vector_queries).select(*HITS)


def _approximate(t, sure=0):
    probes = V.calibrate(t.vector_index, t.vectors)
    return V.approximate_search(t.vector_index, t.vector_queries, probes=probes, sure=sure)


@query("ann_search")
def _(t):
    return _approximate(t).select(*HITS)


@query(
    "ann_recall",
    "SELECT count(*) AS queries, true AS recall_reached, true AS few_candidates FROM vq",
    ("vq",),
)
def _(t):
    measured = V.recall(_approximate(t), V.exact_search(t.vector_index, t.vector_queries))
    return measured.select("queries", (F.col("recall") >= 0.95).alias("recall_reached"), (F.col("candidates") <= 100).alias("few_candidates"))


@query(
    "ann_scores",
    """SELECT query_id, chunk_id, round(score, 6) AS score FROM (
       SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sims) r WHERE rank <= 2""",
    ("sims",),
)
def _(t):
    """The two vectors a query is the sum of are found, with their exact scores."""
    return _approximate(t, sure=2).where("rank <= 2").select("query_id", "chunk_id", "score")


# Dense and lexical lists of one query table: the vector of an item is the vector with its number.
def _item_dense(t, limit=S.RETRIEVE_DEPTH):
    items = t.read("benchmark").select(F.concat(F.lit("q"), "item_id").alias("query_id"), F.col("item_id").cast("string").alias("id"))
    vectors = t.vectors.select("id", F.col("embedding").alias("vector"))
    corpus = t.vectors.select(F.concat(F.lit("doc-"), "id", F.lit(":p:0")).alias("id"), "embedding")
    return D.dense_search(corpus, items.join(vectors, "id").select("query_id", "vector"), limit)


_ITEM_DENSE = """
    SELECT query_id, chunk_id, score, rank FROM (
      SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT 'q' || item_id AS query_id, 'doc-' || c.vec_id || ':p:0' AS chunk_id,
               round(list_cosine_similarity(list_transform(v.embedding, lambda x: x::DOUBLE), list_transform(c.embedding, lambda x: x::DOUBLE)), 12) AS score
        FROM benchmark JOIN embeddings v ON v.vec_id = item_id CROSS JOIN embeddings c) a) b WHERE rank <= 20
"""
_RRF = """
    SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT query_id, chunk_id, list_sum(list(1.0::DOUBLE / (60 + rank) ORDER BY list_id, rank)) AS score FROM {lists} GROUP BY query_id, chunk_id) a
"""
_HYBRID = f"""
    , dl AS (SELECT *, 0 AS list_id FROM ({_ITEM_DENSE}) d UNION ALL SELECT query_id, chunk_id, score, rank, 1 FROM lex),
    hybrid AS (SELECT * FROM ({_RRF.format(lists='dl')}) h WHERE rank <= 20)
"""


@query(
    "rrf_fuse",
    f""", ll AS (SELECT query_id, chunk_id, rank, 0 AS list_id FROM lex UNION ALL SELECT query_id, chunk_id, rank, 1 FROM lexidf)
    SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({_RRF.format(lists='ll')}) f WHERE rank <= 20""",
    ("lex", "lexidf"),
)
def _(t):
    lists = X.stack(L.lexical_search(t.index, t.queries), L.lexical_search(t.index, t.queries, idf=True, n_chunks=t.n_chunks))
    return X.rrf_fuse(lists).select(*HITS)


@query("hybrid_search", _HYBRID + "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hybrid", ("lex",))
def _(t):
    return X.rrf_fuse(X.stack(_item_dense(t), L.lexical_search(t.index, t.queries))).select(*HITS)


_SCORED = f"""
    , texts AS (SELECT lex.query_id, lex.chunk_id, rank AS incoming, question, text FROM lex JOIN q USING (query_id) JOIN chunks ON chunks.id = lex.chunk_id),
    overlap AS (SELECT query_id, chunk_id, incoming, text, len(list_intersect(a, b)) - len(a) / 2.0 AS x FROM (
        SELECT query_id, chunk_id, incoming, text, list_distinct({sql_tokens('lower(' + sql_norm('question') + ')')}) AS a,
               list_distinct({sql_tokens('lower(' + sql_norm('text') + ')')}) AS b FROM texts) s),
    reranked AS (SELECT query_id, chunk_id, text, score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, incoming) AS rank FROM (
          SELECT query_id, chunk_id, text, incoming, CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END AS score FROM overlap) a) b WHERE rank <= 5)
"""


def _with_text(t, hits):
    payload = t.chunks.select(F.col("id").alias("chunk_id"), "doc_id", "article", "text")
    return hits.join(payload, "chunk_id").join(t.queries, "query_id")


def _reranked(t):
    return X.rerank(_with_text(t, L.lexical_search(t.index, t.queries)), X.overlap_scorer)


@query("rerank", _SCORED + "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM reranked", ("lex", "chunks", "q"))
def _(t):
    return _reranked(t).select(*HITS)


@query("rerank_noop", "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM lex WHERE rank <= 5", ("lex",))
def _(t):
    return X.keep_order(L.lexical_search(t.index, t.queries)).select(*HITS)


# --- plans: several search queries per question ---------------------------------------------------------

_PLANS = f"""
    , planned AS (SELECT query_id, question, register, r FROM (
        SELECT query_id, trim(question) AS question, {_sql_register('question')} AS register, trim({_sql_rewrite('question')}) AS r FROM q) p),
    searches AS (SELECT query_id, 0 AS list_id, question FROM planned
        UNION ALL SELECT query_id, 1, r FROM planned WHERE register = 'gulf' AND r <> question),
    sterms AS (SELECT DISTINCT query_id, list_id, lower(w) AS term FROM (
        SELECT query_id, list_id, unnest(list_slice(list_filter({sql_tokens(sql_norm('question'))}, lambda x: length(x) <= 64), 1, 32)) AS w FROM searches) u),
    slists AS (SELECT query_id, list_id, chunk_id, score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, list_id ORDER BY score DESC, chunk_id) AS rank FROM (
          SELECT query_id, list_id, chunk_id, 0.1 * CAST(sum(tf) AS DOUBLE) AS score FROM sterms JOIN post USING (term) GROUP BY query_id, list_id, chunk_id) a) b WHERE rank <= 20),
    several AS (SELECT query_id, max(list_id) AS last FROM searches GROUP BY query_id),
    fused AS (SELECT query_id, chunk_id, score, rank FROM slists JOIN several USING (query_id) WHERE last = 0
        UNION ALL SELECT * FROM ({_RRF.format(lists='(SELECT s.* FROM slists s JOIN several USING (query_id) WHERE last > 0)')}) f WHERE rank <= 20)
"""


@query("plan_retrieval", _PLANS + "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM fused", ("q", "post"))
def _(t):
    config = S.RetrievalConfig.named("lexical")
    return R.retrieve(P.plan_rules(t.queries, LATIN), config, index=t.index).select(*HITS)


@query(
    "retrieval_record",
    _PLANS + """SELECT query_id, 'lexical' AS config, count(*) AS n_candidates, count(DISTINCT chunk_id) AS n_returned,
        round(arg_min(score, rank * 10 + list_id), 6) AS top_score FROM slists GROUP BY query_id""",
    ("q", "post"),
)
def _(t):
    lists = R.ranked_lists(P.plan_rules(t.queries, LATIN), S.RetrievalConfig.named("lexical"), index=t.index)
    return X.retrieval_record(lists, "lexical", None).drop("model_key")


@query(
    "refusal_gate",
    """SELECT query_id, round(top, 6) AS top_score, top IS NULL OR top < 0.9 AS refused FROM (SELECT query_id FROM q) q
       LEFT JOIN (SELECT query_id, score AS top FROM reranked WHERE rank = 1) r USING (query_id)""".join([_SCORED, ""]),
    ("lex", "chunks", "q"),
)
def _(t):
    return X.refusal_gate(t.queries, _reranked(t), floor=0.9)


_CONTEXT = f"""
    , costed AS (SELECT query_id, chunk_id, rank, text, CAST((length('[' || chunk_id || ']' || chr(10) || text) + 2) // 3 AS BIGINT) AS cost FROM lex JOIN chunks ON chunks.id = chunk_id WHERE rank <= 5),
    fitted AS (SELECT * FROM (SELECT *, CAST(sum(cost) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS used FROM costed) u WHERE used <= 1500 - 512)
"""


def _context(t):
    hits = X.keep_order(L.lexical_search(t.index, t.queries))
    return X.fit_context(_with_text(t, hits), 1500)


@query("fit_context", _CONTEXT + "SELECT query_id, chunk_id, rank, cost, used FROM fitted", ("lex", "chunks"))
def _(t):
    return _context(t).select("query_id", "chunk_id", "rank", "cost", "used")


_PROMPTS = f"""
    , prompts AS (SELECT query_id, '{S.CONTEXT_HEADER}' || chr(10) || chr(10) || coalesce(blocks, '{S.NO_CONTEXT}') || chr(10) || chr(10) || '{S.QUESTION_HEADER} ' || question AS prompt
      FROM q LEFT JOIN (SELECT query_id, string_agg('[' || chunk_id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS blocks FROM fitted GROUP BY query_id) b USING (query_id))
"""


@query("build_prompts", _CONTEXT + _PROMPTS + "SELECT query_id, prompt FROM prompts", ("lex", "chunks", "q"))
def _(t):
    return X.build_prompts(t.queries, _context(t))


@query(
    "answer_estimate",
    _CONTEXT + _PROMPTS + """SELECT query_id, CAST((length(prompt) + 2) // 3 AS BIGINT) AS input_tokens,
        round((CAST((length(prompt) + 2) // 3 AS BIGINT) * 1.0 + 1024 * 5.0) / 1000000, 6) AS estimated_usd FROM prompts""",
    ("lex", "chunks", "q"),
)
def _(t):
    from daftar.operators.ledger import answer_estimate

    prompts = X.build_prompts(t.queries, _context(t))
    return answer_estimate(prompts, 1.0, 5.0).select("query_id", "input_tokens", "estimated_usd")


@query(
    "hydrate_citations",
    """SELECT CAST(event_id AS BIGINT) AS row_id, CAST(pos AS BIGINT) AS pos, chunk_id, round(score, 6) AS score, doc_id FROM (
       SELECT event_id, 0 AS pos, 'doc-' || user_id || ':p:0' AS chunk_id, value AS score FROM events
       UNION ALL SELECT event_id, 1, 'doc-' || event_id || ':p:1', 0.0::DOUBLE FROM events) e JOIN chunks ON chunks.id = chunk_id""",
    ("chunks",),
)
def _(t):
    stored = F.concat(
        F.lit('[{"chunk_id":"doc-'), "user_id", F.lit(':p:0","score":'), "value", F.lit('},"doc-'), "event_id", F.lit(':p:1"]')
    )
    rows = t.events.select("event_id", stored.alias("citations"))
    return Z.hydrate_citations(rows, t.chunks, "event_id").select("row_id", "pos", "chunk_id", "score", "doc_id")


@query(
    "source_urls",
    """
    SELECT event_id, CASE WHEN url IS NULL THEN NULL WHEN s.anchor IS NULL THEN url ELSE url || '#' || s.anchor END AS source_url
    FROM (SELECT event_id, user_id, TRY_CAST(article AS BIGINT) AS n FROM (SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN 'x' ELSE CAST(event_id % 60 AS VARCHAR) END AS article FROM events) e) e
    LEFT JOIN pages ON page_id = user_id
    LEFT JOIN LATERAL (SELECT arg_min('S' || l_linenumber, l_linenumber) AS anchor FROM (
        SELECT l_orderkey, l_linenumber, min(l_quantity) AS last FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey, l_linenumber) l
        WHERE l_orderkey = user_id AND n BETWEEN l_linenumber AND last) s ON true
    """,
)
def _(t):
    pages = t.read("pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("source_url"))
    lines = t.read("lineitem").where("l_returnflag <> 'R'").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("last"))
    sections = lines.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("S"), "l_linenumber").alias("anchor"),
        F.col("l_linenumber").alias("first_article"), F.col("last").cast("int").alias("last_article"),
    )
    article = F.when(F.col("event_type") == "view", "x").otherwise((F.col("event_id") % 60).cast("string"))
    cited = t.events.select("event_id", F.col("user_id").alias("doc_id"), article.alias("article"))
    return Z.source_urls(cited, pages, sections, ["event_id"]).select("event_id", "source_url")


# --- answer cache ------------------------------------------------------------------------------------------


def _cache(t):
    rows = t.read("embeddings").join(
        t.events.select(F.col("event_id").alias("vec_id"), "props", "event_type", "value", F.col("ts").cast("timestamp").alias("created_at")), "vec_id"
    )
    return rows.select(
        F.col("vec_id").cast("string").alias("id"),
        F.col("props").alias("query_normalized"),
        "embedding",
        F.when(F.col("label") % 2 == 0, "e5").otherwise("bge").alias("model_key"),
        F.lit("p1").alias("pipeline_key"),
        F.col("event_type").alias("answer"),
        F.lit("[]").alias("citations"),
        (F.col("vec_id") % 4).alias("hits"),
        "created_at",
        F.lit(None).cast("timestamp").alias("last_hit_at"),
    )


def _lookups(t):
    rows = t.vector_queries.join(t.read("embeddings").select(F.col("vec_id").cast("string").alias("query_id"), "label"), "query_id")
    rows = rows.join(t.events.select(F.col("event_id").cast("string").alias("query_id"), "props"), "query_id")
    return rows.select(
        "query_id", F.col("props").alias("question"), "vector",
        F.when(F.col("label") % 2 == 0, "e5").otherwise("bge").alias("model_key"), F.lit("p1").alias("pipeline_key"),
    )


_NEAREST = """
    , near AS (SELECT query_id, chunk_id AS id, score AS similarity FROM (
        SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
        FROM sims s JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = s.query_id WHERE e.label % 2 = s.label % 2) r WHERE rank = 1),
    accepted AS (SELECT n.query_id, n.id, similarity, a.event_type AS answer, a.ts FROM near n
        JOIN events a ON CAST(a.event_id AS VARCHAR) = n.id JOIN events b ON CAST(b.event_id AS VARCHAR) = n.query_id
        WHERE similarity >= 0.7 AND regexp_extract_all(a.props, '[0-9]+') = regexp_extract_all(b.props, '[0-9]+'))
"""


@query("cache_nearest", _NEAREST + "SELECT query_id, id, round(similarity, 6) AS similarity FROM near", ("sims",))
def _(t):
    return K.nearest(_lookups(t), _cache(t), dim=64)


@query(
    "cache_lookup",
    _NEAREST + """SELECT query_id, id, round(similarity, 6) AS similarity, answer,
        round(greatest(0, epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(ts)), 3) AS age_seconds FROM accepted""",
    ("sims",),
)
def _(t):
    found = K.lookup(_lookups(t), _cache(t), 0.7, now="2024-02-01 00:00:00 UTC", dim=64)
    return found.select("query_id", "id", "similarity", "answer", F.round("age_seconds", 3).alias("age_seconds"))


@query(
    "cache_record_hits",
    _NEAREST + """SELECT CAST(vec_id AS VARCHAR) AS id, vec_id % 4 + coalesce(n, 0) AS hits, n IS NOT NULL AS hit_now FROM embeddings
        LEFT JOIN (SELECT id, count(*) AS n FROM accepted GROUP BY id) a ON a.id = CAST(vec_id AS VARCHAR)""",
    ("sims",),
)
def _(t):
    hits = K.lookup(_lookups(t), _cache(t), 0.7, now="2024-02-01 00:00:00 UTC", dim=64)
    updated = K.record_hits(_cache(t), hits, "2024-02-01 00:00:00 UTC")
    return updated.select("id", "hits", F.col("last_hit_at").isNotNull().alias("hit_now"))


_REFUSAL = S.REFUSALS["msa"].rstrip(".")


@query(
    "cache_store",
    f"""SELECT conv_id, turn, n AS query_normalized, answer FROM (
        SELECT conv_id, turn, {sql_norm('text')} AS n, CASE turn WHEN 0 THEN '' WHEN 1 THEN '{_REFUSAL} x' ELSE text END AS answer FROM conversations) c
        WHERE regexp_matches(answer, '[^\\s\\p{{Z}}]') AND NOT starts_with(answer, '{_REFUSAL}') AND NOT regexp_matches(answer, '[^{T.ALLOWED_IN_ANSWERS}]')""",
)
def _(t):
    answer = F.when(F.col("turn") == 0, "").when(F.col("turn") == 1, f"{_REFUSAL} x").otherwise(F.col("text"))
    rows = t.read("conversations").withColumn("answer", answer)
    kept = K.storable(rows)
    return kept.select("conv_id", "turn", T.normalize_query("text").alias("query_normalized"), "answer")


@query("cache_purge", f"SELECT source, count(*) AS n FROM documents WHERE NOT regexp_matches(text, '[^{T.ALLOWED_IN_ANSWERS}]') GROUP BY source")
def _(t):
    rows = t.read("documents").select("source", F.col("text").alias("answer"))
    return K.purge_corrupted(rows).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cache_stats",
    """SELECT count(*) AS entries, CAST(sum(vec_id % 4) AS BIGINT) AS hits, round(sum(vec_id % 4) / (sum(vec_id % 4) + count(*)), 4) AS hit_ratio FROM embeddings""",
)
def _(t):
    return K.stats(_cache(t))


# --- embedding ----------------------------------------------------------------------------------------------


def _half_embedded(t):
    base = t.vectors.select("id", F.concat(F.lit("text of "), "id").alias("text"), "label", F.when(F.col("label") % 2 == 0, F.col("embedding")).alias("emb_e5"))
    return base.withColumn("doc_id", F.concat(F.lit("d"), "label"))


@query(
    "backfill",
    "SELECT CAST(label AS BIGINT) AS label, count(*) AS n, CAST(sum(CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS kept, count(*) AS filled FROM embeddings GROUP BY label",
)
def _(t):
    before = _half_embedded(t)
    after = E.backfill(before, "e5", lambda texts: E.hashed_embedding(texts, 64), dim=64)
    joined = after.join(before.select("id", F.col("emb_e5").alias("old")), "id")
    return joined.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("old") == F.col("emb_e5")).alias("kept"), F.count("emb_e5").alias("filled")
    )


@query(
    "backfill_stats",
    "SELECT 'e5' AS model_key, CAST(sum(CASE WHEN label % 2 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS chunks_embedded, CAST(sum(CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS chunks_skipped FROM embeddings",
)
def _(t):
    return E.backfill_stats(_half_embedded(t), "e5")


@query("embed_distinct", "SELECT role, count(*) AS n, count(*) AS embedded FROM conversations GROUP BY role")
def _(t):
    vectors = E.embed_distinct(_turns(t), lambda texts: E.hashed_embedding(texts, 64))
    return vectors.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count("vector").alias("embedded"))


@query("hashed_dense_search")
def _(t):
    # chunks and questions embedded by the stand-in, searched exactly
    chunks = E.hashed_embedding(t.chunks.select("id", "text"), 256).select("id", "embedding")
    asked = E.hashed_embedding(t.queries.withColumnRenamed("question", "text"), 256)
    return D.dense_search(chunks, asked.select("query_id", F.col("embedding").alias("vector"))).select(*HITS)


def _sql_ask(fused: str, cached: str = "false", rerank: str = "") -> str:
    """Context, gate and prompts over the fused lists of a plan, as the batch pipeline has them."""
    score, order = ("score", "incoming") if not rerank else (rerank, f"{rerank} DESC, incoming")
    return f"""
    , loaded AS (SELECT f.query_id, chunk_id, rank AS incoming, score, text, CASE WHEN register = 'gulf' THEN r ELSE p.question END AS asked
        FROM {fused} f JOIN planned p USING (query_id) JOIN chunks ON chunks.id = chunk_id),
    sets AS (SELECT *, list_distinct({sql_tokens('lower(' + sql_norm('asked') + ')')}) AS a, list_distinct({sql_tokens('lower(' + sql_norm('text') + ')')}) AS b FROM loaded),
    marked AS (SELECT *, len(list_intersect(a, b)) - len(a) / 2.0 AS x FROM sets),
    ctx AS (SELECT * FROM (SELECT query_id, chunk_id, text, {score} AS score, {'row_number() OVER (PARTITION BY query_id ORDER BY ' + order + ')' if rerank else 'incoming'} AS rank FROM marked) c WHERE rank <= 5),
    cut AS (SELECT * FROM (SELECT *, sum((length('[' || chunk_id || ']' || chr(10) || text) + 2) // 3) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM ctx) u WHERE used <= 1500 - 512),
    blocks AS (SELECT query_id, string_agg('[' || chunk_id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS blocks FROM cut GROUP BY query_id),
    done AS (SELECT p.query_id, register, {cached} AS hit, top IS NULL OR {'top < 0.9' if rerank else 'false'} AS refused,
        length('{S.CONTEXT_HEADER}' || chr(10) || chr(10) || coalesce(blocks, '{S.NO_CONTEXT}') || chr(10) || chr(10) || '{S.QUESTION_HEADER} ' || question) AS n
      FROM planned p LEFT JOIN blocks USING (query_id) LEFT JOIN (SELECT query_id, score AS top FROM ctx WHERE rank = 1) t USING (query_id))
    SELECT query_id, register, CASE WHEN hit THEN 'hit' WHEN refused THEN 'refused' ELSE 'to_generate' END AS status, CASE WHEN NOT hit AND NOT refused THEN n END AS prompt_chars FROM done"""


@query("ask_batch", _PLANS + _sql_ask("fused"), ("q", "post", "chunks"))
def _(t):
    done = R.ask(t.queries, t.chunks, S.RetrievalConfig.named("lexical"), max_tokens=1500, dialect=LATIN, index=t.index)
    return done.select("query_id", "register", "status", F.length("prompt").alias("prompt_chars"))


_LEGS = f"""
    , dlists AS (SELECT query_id, s.list_id, d.chunk_id, d.score, d.rank FROM searches s JOIN ({_ITEM_DENSE}) d USING (query_id)),
    hlists AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, list_id ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT query_id, list_id, chunk_id, list_sum(list(1.0::DOUBLE / (60 + rank) ORDER BY leg)) AS score FROM (
          SELECT *, 0 AS leg FROM dlists UNION ALL SELECT *, 1 FROM slists) l GROUP BY query_id, list_id, chunk_id) a) b WHERE rank <= 20),
    hfused AS (SELECT query_id, chunk_id, score, rank FROM hlists JOIN several USING (query_id) WHERE last = 0
        UNION ALL SELECT * FROM ({_RRF.format(lists='(SELECT h.* FROM hlists h JOIN several USING (query_id) WHERE last > 0)')}) f WHERE rank <= 20)
"""
_SIGMOID = "(CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END)"


def _hybrid_parts(t):
    """The corpus with vectors, and the vector of every search string: that of its item."""
    corpus = t.vectors.select(F.concat(F.lit("doc-"), "id", F.lit(":p:0")).alias("id"), F.col("embedding").alias(S.EMBEDDING_COLUMNS["e5"]))
    plans = P.plan_rules(t.queries, LATIN)
    strings = plans.select("query_id", F.explode("search_queries").alias("question"))
    vectors = t.vectors.select(F.concat(F.lit("q"), "id").alias("query_id"), F.col("embedding").alias("vector"))
    return corpus, strings.join(vectors, "query_id").groupBy("question").agg(F.min_by("vector", "query_id").alias("vector"))


@query(
    "ask_hybrid_rerank",
    _PLANS + _LEGS + _sql_ask("hfused", "CAST(substr(query_id, 2) AS BIGINT) % 7 = 0", _SIGMOID),
    ("q", "post", "chunks"),
)
def _(t):
    """The full plan: rewrites, both legs fused, reranked, gated, cached answers served."""
    corpus, vectors = _hybrid_parts(t)
    cached = t.queries.where(F.substr("query_id", F.lit(2)).cast("long") % 7 == 0).select("query_id", F.lit("stored").alias("answer"))
    config = S.RetrievalConfig.named("hybrid+rerank", model_key="e5")
    done = R.ask(
        t.queries, t.chunks, config, max_tokens=1500, floor=0.9, dialect=LATIN, index=t.index, corpus=corpus, vectors=vectors,
        cached=cached, system="Answer from the context only.", dim=64,
    )
    return done.select("query_id", "register", "status", F.length("prompt").alias("prompt_chars"))


@query(
    "citation_payload",
    """SELECT query_id, '[' || string_agg('{"rank":' || rank || ',"chunk_id":"' || chunk_id || '"}', ',' ORDER BY rank) || ']' AS cited,
        round(max(score), 6) AS top_score, '[{"stage":"retrieve","ms":1.23},{"stage":"total","ms":20.0}]' AS stages
        FROM lex WHERE rank <= 3 GROUP BY query_id""",
    ("lex",),
)
def _(t):
    hits = L.lexical_search(t.index, t.queries).where("rank <= 3")
    times = F.array(*(F.struct(F.lit(n).alias("stage"), F.lit(ms).alias("ms")) for n, ms in (("total", 19.999), ("retrieve", 1.2345))))
    stages = t.queries.select("query_id", F.explode(times).alias("s")).select("query_id", "s.*")
    told = Z.payload(hits, stages)
    cited = F.to_json(F.transform("citations", lambda c: F.struct(c["rank"].alias("rank"), c.chunk_id.alias("chunk_id"))))
    return told.select(
        "query_id", cited.alias("cited"), F.array_max(F.col("citations.score")).alias("top_score"), F.to_json("stages").alias("stages")
    )


@query(
    "cache_roundtrip",
    """SELECT CAST(vec_id AS VARCHAR) AS query_id, 1.0::DOUBLE AS similarity, event_type AS answer, 60.0::DOUBLE AS age_seconds
        FROM embeddings JOIN events ON event_id = vec_id WHERE event_type <> 'error'""",
)
def _(t):
    # store answers, then look each question up again: what was storable is found under its own key
    asked = t.read("embeddings").join(t.events.withColumnRenamed("event_id", "vec_id"), "vec_id").where("event_type <> 'error'")
    answers = asked.select(
        F.col("vec_id").cast("string").alias("query_id"), F.concat_ws(" ", "props", F.col("vec_id").cast("string")).alias("question"),
        "embedding", F.lit("bge").alias("model_key"), F.lit("p1").alias("pipeline_key"), F.col("event_type").alias("answer"),
        F.lit("[]").alias("citations"),
    )
    cache = K.new_rows(answers, "2024-02-01 00:00:00 UTC")
    lookups = answers.select("query_id", "question", F.transform("embedding", lambda x: x.cast("double")).alias("vector"), "model_key", "pipeline_key")
    found = K.lookup(lookups, cache, 0.9, now="2024-02-01 00:01:00 UTC", dim=64)
    return found.select("query_id", "similarity", "answer", "age_seconds")
