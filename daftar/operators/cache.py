"""Reusing answers through a guarded nearest-neighbour join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar import settings as S
from daftar.functions import text as T
from daftar.operators.dense import dense_search

SCOPE = ["model_key", "pipeline_key"]


def check_model(model_key: str) -> str:
    if not model_key:
        raise ValueError("model_key is required: the cache never matches across models")
    if S.EMBEDDING_DIMS.get(model_key) != S.CACHE_DIM:
        raise ValueError(f"the cache holds {S.CACHE_DIM}-dimensional vectors; {model_key!r} has others")
    return model_key


def nearest(lookups: DataFrame, cache: DataFrame, dim: int | None = S.CACHE_DIM, **search) -> DataFrame:
    """The single nearest cache row per lookup within its scope: (query_id, id, similarity)."""
    found = dense_search(cache, lookups, 1, vector="embedding", dim=dim, scope=SCOPE, **search)
    return found.select("query_id", F.col("chunk_id").alias("id"), F.col("score").alias("similarity"))


def lookup(
    lookups: DataFrame,
    cache: DataFrame,
    threshold: float = S.CACHE_THRESHOLD,
    now: str | None = None,
    dim: int | None = S.CACHE_DIM,
    **search,
) -> DataFrame:
    """Accepted answers: (query_id, id, similarity, answer, citations, age_seconds).

    The nearest row is picked first. Only then do the threshold and the guard decide, so a nearest
    row that fails them is a miss even when the next one would pass.
    """
    near = nearest(lookups, cache, dim, **search).where(F.col("similarity") >= threshold)
    asked = lookups.select("query_id", T.guard_key(T.normalize_query("question")).alias("_asked"))
    rows = cache.select("id", "query_normalized", "answer", "citations", "created_at")
    rows = rows.withColumn("id", F.col("id").cast("string"))
    joined = near.join(rows, "id").join(asked, "query_id")
    # normalizing is idempotent, so the stored index form gives the same guard as the question
    hit = joined.where(T.guard_key(T.normalize_query("query_normalized")) == F.col("_asked"))
    clock = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    age = F.greatest(clock.cast("double") - F.col("created_at").cast("timestamp").cast("double"), F.lit(0.0))
    return hit.select("query_id", "id", "similarity", "answer", "citations", age.alias("age_seconds"))


def record_hits(cache: DataFrame, hits: DataFrame, at: str) -> DataFrame:
    """The cache with hit counts raised and the time of the last hit set."""
    counted = hits.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    joined = cache.withColumn("_key", F.col("id").cast("string"))
    joined = joined.join(counted.withColumnRenamed("id", "_key"), "_key", "left")
    raised = joined.withColumn("hits", F.col("hits") + F.coalesce("_n", F.lit(0)))
    stamped = F.when(F.col("_n").isNotNull(), F.lit(at).cast("timestamp")).otherwise(F.col("last_hit_at"))
    return raised.withColumn("last_hit_at", stamped).select(*cache.columns)


def storable(answers: DataFrame) -> DataFrame:
    """Answers worth keeping: not blank, not a refusal, nothing from a foreign script."""
    answer = F.col("answer")
    return answers.where(~T.is_blank(answer) & ~T.is_refusal_text(answer) & ~T.is_corrupted(answer))


def new_rows(answers: DataFrame, at: str) -> DataFrame:
    """Cache rows for storable answers, keyed by content so that a retried write adds nothing."""
    kept = storable(answers).withColumn("query_normalized", T.normalize_query("question"))
    key = F.sha2(F.concat_ws("\u0001", "model_key", "pipeline_key", "query_normalized", "answer"), 256)
    return kept.select(
        key.alias("id"), "query_normalized", "embedding", "model_key", "pipeline_key", "answer", "citations",
        F.lit(0).cast("long").alias("hits"),
        F.lit(at).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("last_hit_at"),
    )


def purge_corrupted(cache: DataFrame) -> DataFrame:
    return cache.where(~T.is_corrupted("answer"))


def stats(cache: DataFrame) -> DataFrame:
    """entries, hits and hits / (hits + entries)."""
    totals = cache.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
    ratio = F.try_divide(F.col("hits"), F.col("hits") + F.col("entries"))
    return totals.select("*", F.round(F.coalesce(ratio, F.lit(0.0)), 4).alias("hit_ratio"))
