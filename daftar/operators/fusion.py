"""Fusing, reranking and trimming ranked lists.

A ranked-hit table has query_id, list_id (0-based), rank (1-based), chunk_id, score and source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daftar import settings as S
from daftar.functions import text as T
from daftar.functions.vectors import sigmoid
from daftar.operators.ranking import check_limit, top_k


def stack(*legs: DataFrame) -> DataFrame:
    """Ranked lists one below the other, numbered in the order given."""
    shape = ["query_id", "list_id", "rank", "chunk_id", "score", "source"]
    numbered = [leg.withColumn("list_id", F.lit(i)).select(*shape) for i, leg in enumerate(legs)]
    result = numbered[0]
    for leg in numbered[1:]:
        result = result.unionByName(leg)
    return result


def rrf_fuse(lists: DataFrame, k: int = S.RRF_K, limit: int = S.RETRIEVE_DEPTH) -> DataFrame:
    """Reciprocal rank fusion, ties by chunk id.

    Contributions are added in list order, so equal inputs give bit-equal scores. A chunk twice in
    one list counts twice.
    """
    check_limit(limit)
    if k < 1:
        raise ValueError(f"k must be >= 1, got {k}")
    # A group holds one entry per list position of one chunk: bounded by the number of lists.
    places = F.array_sort(F.collect_list(F.struct("list_id", "rank")))
    fused = lists.groupBy("query_id", "chunk_id").agg(places.alias("_places"))
    score = F.aggregate("_places", F.lit(0.0), lambda total, p: total + F.lit(1.0) / (p.rank + k))
    fused = fused.select("query_id", "chunk_id", score.alias("score"))
    order = [F.col("score").desc(), F.col("chunk_id")]
    return top_k(fused, ["query_id"], order, limit).withColumn("source", F.lit("rrf"))


def fuse_plan(lists: DataFrame, k: int = S.RRF_K, limit: int = S.RETRIEVE_DEPTH, keys=None) -> DataFrame:
    """One list per query keeps its own scores; several are fused.

    ``keys`` is (query_id, n_lists): the lists a plan asked for, found or not.
    """
    check_limit(limit)
    counted = lists.join(keys, "query_id")
    alone = F.col("n_lists") == 1
    # One pass over the lists: a plan that reads them twice searches twice.
    places = F.array_sort(F.collect_list(F.struct("list_id", "rank")))
    own = F.min_by(F.struct("score", "source"), F.struct("rank", "list_id"))
    fused = counted.groupBy("query_id", "chunk_id").agg(
        F.min("n_lists").alias("n_lists"), places.alias("_places"), own.alias("_own"), F.min("rank").alias("_first")
    )
    total = F.aggregate("_places", F.lit(0.0), lambda score, p: score + F.lit(1.0) / (p.rank + k))
    scored = fused.select(
        "query_id", "chunk_id", F.when(alone, F.col("_own.score")).otherwise(total).alias("score"),
        F.when(alone, F.col("_own.source")).otherwise("rrf").alias("source"), F.when(alone, F.col("_first")).alias("_first"),
    )
    order = [F.col("_first"), F.col("score").desc(), F.col("chunk_id")]
    return top_k(scored, ["query_id"], order, limit).select("query_id", "chunk_id", "score", "rank", "source")


Scorer = Callable[[Column, Column], Column]


def rerank(hits: DataFrame, scorer: Scorer, top: int = S.CONTEXT_DEPTH) -> DataFrame:
    """Reorder each list by the sigmoid of ``scorer(question, text)``; ties keep incoming order.

    ``hits`` carries ``question`` and ``text``. A model-backed scorer is a pandas UDF.
    """
    check_limit(top, "top_k")
    scored = hits.withColumn("score", sigmoid(scorer(F.col("question"), F.col("text"))))
    scored = scored.withColumnRenamed("rank", "_incoming")
    ranked = top_k(scored, ["query_id"], [F.col("score").desc(), F.col("_incoming")], top)
    return ranked.drop("_incoming").withColumn("source", F.lit("rerank"))


def keep_order(hits: DataFrame, top: int = S.CONTEXT_DEPTH) -> DataFrame:
    """The no-op reranker: the first ``top`` as they came."""
    check_limit(top, "top_k")
    return hits.where(F.col("rank") <= top)


def overlap_scorer(question: Column, text: Column) -> Column:
    """Deterministic stand-in scorer: shared distinct terms minus half the query's terms.

    A relevance model replaces this; nothing about quality is claimed.
    """
    asked = F.array_distinct(T.lexical_tokens(T.normalize_query(question)))
    found = F.array_distinct(T.lexical_tokens(T.normalize_for_index(text)))
    return F.size(F.array_intersect(asked, found)) - F.size(asked) / F.lit(2.0)


def refusal_gate(queries: DataFrame, hits: DataFrame, floor: float = 0.0) -> DataFrame:
    """(query_id, top_score, refused): nothing retrieved, or a reranked top hit under the floor."""
    top = hits.where(F.col("rank") == 1).select("query_id", F.col("score").alias("top_score"), F.col("source").alias("_source"))
    joined = queries.select("query_id").join(top, "query_id", "left")
    below = (F.col("_source") == "rerank") & (F.col("top_score") < floor)
    refused = F.col("_source").isNull() | F.coalesce(below, F.lit(False))
    return joined.select("query_id", "top_score", refused.alias("refused"))


def fit_context(hits: DataFrame, max_tokens: int, reserve: int = S.RESERVE_TOKENS) -> DataFrame:
    """The longest ranked prefix whose rendered chunks fit; adds cost and running used tokens.

    Costs are non-negative, so the running sum crosses the budget once: keeping the rows at or
    under it is the same as stopping at the first chunk that does not fit.
    """
    if reserve < 0:
        raise ValueError(f"reserve must be >= 0, got {reserve}")
    cost = T.estimate_tokens(T.render_hit("article", "chunk_id", "text"))
    prefix = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    running = hits.withColumn("cost", cost).withColumn("used", F.sum("cost").over(prefix))
    return running.where(F.col("used") <= max_tokens - reserve)


def build_prompts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, prompt): rendered context in rank order, then the question."""
    block = F.struct("rank", T.render_hit("article", "chunk_id", "text").alias("block"))
    # At most the context depth per query.
    context = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(block)).alias("_blocks"))
    joined = queries.join(context, "query_id", "left")
    material = F.array_join(F.transform("_blocks", lambda b: b.block), "\n\n")
    material = F.coalesce(material, F.lit(S.NO_CONTEXT))
    prompt = F.concat(
        F.lit(f"{S.CONTEXT_HEADER}\n\n"), material, F.lit(f"\n\n{S.QUESTION_HEADER} "), F.col("question")
    )
    return joined.select("query_id", prompt.alias("prompt"))


def retrieval_record(lists: DataFrame, config: str, model_key: str | None) -> DataFrame:
    """Per query: configuration, candidates over all lists, distinct chunks, best top score."""
    return lists.groupBy("query_id").agg(
        F.lit(config).alias("config"),
        F.lit(model_key).cast("string").alias("model_key"),
        F.count(F.lit(1)).alias("n_candidates"),
        F.count_distinct("chunk_id").alias("n_returned"),
        F.min_by("score", F.struct("rank", "list_id")).alias("top_score"),
    )
