"""Retrieval metrics, splits, the ablation matrix and the regression gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar import settings as S

METRICS = ("recall@3", "recall@10", "hit@3", "hit@10", "mrr")


def recall_at_k(retrieved, relevant, k: int) -> Column:
    """Share of distinct relevant ids in the positional top ``k``; NULL when nothing is relevant."""
    if k < 1:
        raise ValueError(f"k must be >= 1, got {k}")
    wanted = F.array_distinct(relevant)
    found = F.size(F.array_intersect(F.slice(retrieved, 1, k), wanted))
    return F.when(F.size(wanted) > 0, found / F.size(wanted))


def mrr(retrieved, relevant) -> Column:
    """One over the position of the first relevant id, 0 when there is none."""
    places = F.transform(retrieved, lambda id_, i: F.when(F.array_contains(relevant, id_), i + 1))
    return F.coalesce(1 / F.array_min(places), F.lit(0.0))


def hit_at_k(retrieved, relevant, k: int) -> Column:
    if k < 1:
        raise ValueError(f"k must be >= 1, got {k}")
    return F.arrays_overlap(F.slice(retrieved, 1, k), relevant).cast("double")


def per_query(
    pairs: DataFrame, hits: DataFrame, qrels: DataFrame, depths: Sequence[int] = S.METRIC_DEPTHS
) -> DataFrame:
    """Metrics per answerable pair from long tables; pairs without relevant ids are skipped.

    ``hits`` is (query_id, chunk_id, rank), ``qrels`` is (query_id, chunk_id). A repeated id counts
    at its best rank.
    """
    if any(k < 1 for k in depths):
        raise ValueError("depths must be >= 1")
    relevant = qrels.select("query_id", "chunk_id").distinct()
    ranked = hits.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    judged = relevant.join(ranked, ["query_id", "chunk_id"], "left")
    found = judged.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("rank").alias("_first"),
        *(F.count_if(F.col("rank") <= k).alias(f"_found_{k}") for k in depths),
    )
    measures = [
        column
        for k in depths
        for column in (
            (F.col(f"_found_{k}") / F.col("_n")).alias(f"recall@{k}"),
            (F.col(f"_found_{k}") > 0).cast("double").alias(f"hit@{k}"),
        )
    ]
    reciprocal = F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr")
    return pairs.join(found, "query_id").select(*pairs.columns, *measures, reciprocal)


def summarise(measured: DataFrame, by: Sequence[str] = (), metrics: Sequence[str] = METRICS) -> DataFrame:
    """n and mean metrics per group."""
    return measured.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *(F.avg(F.col(f"`{m}`")).alias(m) for m in metrics)
    )


def aggregate(measured: DataFrame, levels: Sequence[str] = ("dialect_tag", "source_doc")) -> DataFrame:
    """One pass for the overall line and every level: (level, value, n, metrics)."""
    sets = [[], *([F.col(level)] for level in levels)]
    grouped = measured.groupingSets(sets, *(F.col(level) for level in levels)).agg(
        *(F.grouping(level).alias(f"_g_{level}") for level in levels),
        F.count(F.lit(1)).alias("n"),
        *(F.avg(F.col(f"`{m}`")).alias(m) for m in METRICS),
    )
    name, value = F.lit("all"), F.lit("")
    for level in levels:
        inside = F.col(f"_g_{level}") == 0
        name = F.when(inside, F.lit(level)).otherwise(name)
        value = F.when(inside, F.col(level)).otherwise(value)
    return grouped.select(name.alias("level"), value.alias("value"), "n", *(F.col(f"`{m}`") for m in METRICS))


def unanswerable_line(pairs: DataFrame, qrels: DataFrame, hits: DataFrame) -> DataFrame:
    """n, with_hits, mean and max top score over pairs that have nothing relevant."""
    lone = pairs.join(qrels.select("query_id"), "query_id", "left_anti").select("query_id")
    top = hits.where(F.col("rank") == 1).select("query_id", "score")
    return lone.join(top, "query_id", "left").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("score").alias("with_hits"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("top_score_mean"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("top_score_max"),
    )


def split_membership(pairs: DataFrame) -> DataFrame:
    """(split, query_id, answerable); the matched split holds the standard-register pairs whose
    gold set some dialect pair also has."""
    gold = F.array_sort("source_chunk_ids")
    keyed = pairs.select("query_id", "dialect_tag", gold.alias("gold"), (F.size("source_chunk_ids") > 0).alias("answerable"))
    gulf = keyed.where((F.col("dialect_tag") == "gulf") & F.col("answerable")).select("gold").distinct()
    msa = keyed.where((F.col("dialect_tag") == "msa") & F.col("answerable"))
    matched = msa.join(gulf, "gold", "left_semi").withColumn("split", F.lit("msa_matched"))
    names = F.array(F.lit("all"), F.col("dialect_tag"))
    plain = keyed.withColumn("split", F.explode(names)).where(F.col("split").isin("all", *S.DIALECT_TAGS))
    columns = ["split", "query_id", "answerable"]
    return plain.select(*columns).unionByName(matched.select(*columns))


def matrix(measured: DataFrame, membership: DataFrame) -> DataFrame:
    """Cells (model, config, split): the retrieval of each (model, config) is measured once and
    every split is a filter over its per-query metrics. Splits without pairs have no cell."""
    fed = membership.groupBy("split").agg(F.count(F.lit(1)).alias("n_pairs"))
    cells = measured.join(membership.select("split", "query_id"), "query_id")
    return summarise(cells, ["model", "config", "split"]).join(fed, "split")


def model_status(coverage: DataFrame, models: DataFrame) -> DataFrame:
    """(model, status, reason): a model without vectors is listed as not run."""
    joined = models.join(coverage, "model", "left")
    n = F.coalesce("n_vectors", F.lit(0))
    return joined.select(
        "model",
        F.when(n > 0, F.lit("run")).otherwise(F.lit("not_run")).alias("status"),
        F.when(n == 0, F.lit("no vectors in the corpus")).alias("reason"),
    )


def dialect_gap(cells: DataFrame, metric: str = "recall@10") -> DataFrame:
    """Matched standard register against dialect, in points and relative percent."""
    wide = cells.groupBy("model", "config").pivot("split", list(S.SPLITS)).agg(
        F.first("n").alias("n"), F.first(F.col(f"`{metric}`")).alias("m")
    )
    gap = F.col("gulf_m") - F.col("msa_matched_m")
    complete = F.col("msa_m").isNotNull() & F.col("msa_matched_m").isNotNull() & F.col("gulf_m").isNotNull()
    return wide.where(complete).select(
        "model",
        "config",
        F.col("msa_m").alias("msa"),
        F.col("msa_n").alias("n_msa"),
        F.col("msa_matched_m").alias("matched"),
        F.col("msa_matched_n").alias("n_matched"),
        F.col("gulf_m").alias("gulf"),
        F.col("gulf_n").alias("n_gulf"),
        (gap * 100).alias("gap_points"),
        F.coalesce(F.try_divide(gap * 100, F.col("msa_matched_m")), F.lit(0.0)).alias("gap_percent"),
    )


def headline(cells: DataFrame) -> DataFrame:
    """(model, config, metric, matched, gulf, change_points) for the three leading metrics."""
    names = ("recall@10", "recall@3", "mrr")
    long = cells.where(F.col("split").isin("msa_matched", "gulf")).select(
        "model", "config", "split",
        F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("v")) for m in names))).alias("c"),
    ).select("model", "config", "split", "c.metric", "c.v")
    wide = long.groupBy("model", "config", "metric").pivot("split", ["msa_matched", "gulf"]).agg(F.first("v"))
    wide = wide.where(F.col("msa_matched").isNotNull() & F.col("gulf").isNotNull())
    return wide.select(
        "model", "config", "metric", F.col("msa_matched").alias("matched"), "gulf",
        ((F.col("gulf") - F.col("msa_matched")) * 100).alias("change_points"),
    )


def entry_key(config, model, dense) -> Column:
    """model:config, or the config alone when it reads no vectors."""
    return F.when(dense, F.concat_ws(":", model, config)).otherwise(config)


def drop_points(current, baseline) -> Column:
    return (baseline - current) * 100


def within_tolerance(current, baseline, tolerance: float) -> Column:
    """A drop of exactly the tolerance still passes."""
    return drop_points(current, baseline) <= tolerance + S.FLOAT_SLACK


def compare_to_baseline(
    current: DataFrame, baseline: DataFrame, keys: Sequence[str], metric: str, tolerance: float
) -> DataFrame:
    """Rows of both sides with the metric's change in points and whether it is tolerated."""
    left = current.select(*keys, F.col(f"`{metric}`").alias("current"))
    right = baseline.select(*keys, F.col(f"`{metric}`").alias("baseline"))
    joined = left.join(right, list(keys))
    return joined.select(
        *keys, "current", "baseline",
        (-drop_points(F.col("current"), F.col("baseline"))).alias("change_points"),
        within_tolerance(F.col("current"), F.col("baseline"), tolerance).alias("passed"),
    )


def gate(
    current: DataFrame,
    baseline: DataFrame,
    metric: str = "recall@10",
    tolerance: float = S.GATE_TOLERANCE_PTS,
    by_doc_tolerance: float = S.BY_DOC_TOLERANCE_PTS,
) -> DataFrame:
    """Check two :func:`aggregate` tables: (level, value, metric, current, baseline, change, verdict).

    The overall line and every document are gated, other metrics are context. A document that
    disappeared fails, a new one is only reported, and a changed pair count is a warning line.
    """
    names = [metric, *(m for m in METRICS if m != metric)]

    def long(side: DataFrame, alias: str) -> DataFrame:
        # The gate compares numbers as they are published: four decimals.
        entries = [F.struct(F.lit(m).alias("metric"), F.round(F.col(f"`{m}`"), 4).alias("v")) for m in names]
        entries.append(F.struct(F.lit("n").alias("metric"), F.col("n").cast("double").alias("v")))
        rows = side.where(F.col("level").isin("all", "source_doc")).select("level", "value", F.explode(F.array(*entries)).alias("e"))
        wanted = (F.col("level") == "all") | (F.col("e.metric") == metric)
        return rows.where(wanted).select("level", "value", "e.metric", F.col("e.v").alias(alias))

    joined = long(current, "current").join(long(baseline, "baseline"), ["level", "value", "metric"], "full")
    change = (F.col("current") - F.col("baseline")) * 100
    allowed = F.when(F.col("level") == "all", F.lit(tolerance)).otherwise(F.lit(by_doc_tolerance))
    ok = -change <= allowed + S.FLOAT_SLACK
    verdict = (
        F.when(F.col("metric") == "n", F.when(F.col("current") == F.col("baseline"), "same pairs").otherwise("warning: other pairs"))
        .when(F.col("metric") != metric, "context")
        .when(F.col("current").isNull(), "fail: missing now")
        .when(F.col("baseline").isNull(), "new")
        .when(ok, "pass")
        .otherwise("fail")
    )
    return joined.withColumn("change_points", change).withColumn("verdict", verdict)


def gate_passed(checked: DataFrame) -> DataFrame:
    return checked.agg((F.count_if(F.col("verdict").startswith("fail")) == 0).alias("passed"))
