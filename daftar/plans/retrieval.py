"""Whole-table retrieval: plan, search, fuse, rerank, gate, and build prompts in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar import settings as S
from daftar.operators import dense as D
from daftar.operators import fusion as X
from daftar.operators import lexical as L
from daftar.operators import planning as P
from daftar.operators.ranking import with_payload
from daftar.session import cut_lineage

LIST = ["query_id", "list_id"]


def _search(searches: DataFrame, config: S.RetrievalConfig, index, corpus, vectors, **options) -> DataFrame:
    """One ranked list per search query; ``searches`` has a single ``query_id`` naming the list."""
    legs = []
    if config.dense:
        if corpus is None or vectors is None:
            raise ValueError(f"config {config.name!r} needs vectors for the corpus and the queries")
        asked = searches.join(vectors, "question").select("query_id", "vector")
        column = S.EMBEDDING_COLUMNS[config.model_key]
        options = {"dim": S.EMBEDDING_DIMS[config.model_key], **options}
        legs.append(D.dense_search(corpus, asked, config.depth, vector=column, **options))
    if config.lexical:
        if index is None:
            raise ValueError(f"config {config.name!r} needs postings")
        legs.append(L.lexical_search(index, searches, config.depth))
    return legs[0] if len(legs) == 1 else X.rrf_fuse(X.stack(*legs), limit=config.depth)


def ranked_lists(plans: DataFrame, config: S.RetrievalConfig, index=None, corpus=None, vectors=None, **options) -> DataFrame:
    """Every list a plan asks for: (query_id, list_id, rank, chunk_id, score, source).

    ``index`` is :func:`block_index`; ``corpus`` has the model's vector column; ``vectors`` is
    (question, vector) with each distinct search string embedded once. Vectors of another length than
    the model's fail the job; ``dim`` names another length.
    """
    searches = P.fan_out(plans).select(
        F.to_json(F.struct(*LIST)).alias("query_id"), "question"
    )
    found = _search(searches, config, index, corpus, vectors, **options)
    key = F.from_json("query_id", "query_id string, list_id int")
    return found.withColumn("_k", key).select("_k.query_id", "_k.list_id", "rank", "chunk_id", "score", "source")


def retrieve(plans: DataFrame, config: S.RetrievalConfig, index=None, corpus=None, vectors=None, **options) -> DataFrame:
    """One list per query: a single search keeps its scores, several are fused."""
    # Stored: what follows reads the lists more than once, and with both legs in one plan with the
    # second fusion Spark 4.1 reuses an exchange of one leg for the other (a test holds this).
    lists = cut_lineage(ranked_lists(plans, config, index, corpus, vectors, **options))
    asked = plans.select("query_id", F.size("search_queries").alias("n_lists"))
    return X.fuse_plan(lists, limit=config.depth, keys=asked)


def to_context(plans: DataFrame, hits: DataFrame, chunks: DataFrame, config: S.RetrievalConfig, scorer: X.Scorer = X.overlap_scorer) -> DataFrame:
    """The context hits with their payload, reranked by the rewrite when there is one."""
    loaded = with_payload(hits, chunks)
    if not config.rerank:
        return X.keep_order(loaded, config.context_depth)
    asked = plans.select("query_id", F.coalesce("rewritten", "original").alias("question"))
    return X.rerank(loaded.join(asked, "query_id"), scorer, config.context_depth)


def ask(
    questions: DataFrame,
    chunks: DataFrame,
    config: S.RetrievalConfig,
    max_tokens: int = 8000,
    floor: float = 0.0,
    dialect: P.Dialect = P.Dialect(),
    scorer: X.Scorer = X.overlap_scorer,
    index: DataFrame | None = None,
    corpus: DataFrame | None = None,
    vectors: DataFrame | None = None,
    cached: DataFrame | None = None,
    system: str | None = None,
    **options,
) -> DataFrame:
    """(query_id, register, status, prompt, answer) for a table of questions; with ``system``, that part of the prompt too.

    The request's early exits are branches: ``cached`` answers are taken as they are, refused
    questions get their register's sentence, the rest get a prompt for a later generation job.
    """
    plans = P.plan_rules(questions, dialect)
    open_plans = plans
    if cached is not None:
        open_plans = plans.join(cached.select("query_id"), "query_id", "left_anti")
    index = L.block_index(chunks) if index is None and config.lexical else index
    hits = retrieve(open_plans, config, index, corpus, vectors, **options)
    context = to_context(open_plans, hits, chunks, config, scorer)
    gate = X.refusal_gate(open_plans, context, floor)
    prompts = X.build_prompts(
        open_plans.select("query_id", F.col("original").alias("question")), X.fit_context(context, max_tokens)
    )
    refusal = F.when(F.col("register") == P.GULF, S.REFUSALS["gulf"]).otherwise(S.REFUSALS["msa"])
    status = F.when(F.col("refused"), "refused").otherwise("to_generate")
    opened = open_plans.select("query_id", "register").join(gate, "query_id").join(prompts, "query_id")
    result = opened.select(
        "query_id",
        "register",
        status.alias("status"),
        F.when(~F.col("refused"), F.col("prompt")).alias("prompt"),
        F.when(F.col("refused"), refusal).alias("answer"),
    )
    if cached is not None:
        served = plans.join(cached.select("query_id", "answer"), "query_id").select(
            "query_id", "register", F.lit("hit").alias("status"), F.lit(None).cast("string").alias("prompt"), "answer"
        )
        result = result.unionByName(served)
    if system is not None:
        result = result.withColumn("system", F.when(F.col("prompt").isNotNull(), F.lit(system)))
    return result
