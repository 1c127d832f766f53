"""Calibrating the refusal threshold from (pair_id, answerable, top_score)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar import settings as S
from daftar.operators.ordered import rounded_index, running_totals

QUARTILES = {"p25": 0.25, "median": 0.50, "p75": 0.75}


def score_pairs(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    """(pair_id, answerable, top_score) with the no-hits score where nothing was retrieved."""
    top = hits.where(F.col("rank") == 1).select(F.col("query_id").alias("pair_id"), F.col("score").alias("top_score"))
    known = pairs.select(F.col("query_id").alias("pair_id"), (F.size("source_chunk_ids") > 0).alias("answerable"))
    joined = known.join(top, "pair_id", "left")
    return joined.withColumn("top_score", F.coalesce("top_score", F.lit(S.NO_HITS_SCORE)))


def thresholds(step: float = 0.01, maximum: float = 0.9) -> list[float]:
    if step <= 0:
        raise ValueError(f"step must be > 0, got {step}")
    if maximum < 0:
        raise ValueError(f"maximum must be >= 0, got {maximum}")
    return [round(i * step, 6) for i in range(round(maximum / step) + 1)]


def sweep(scored: DataFrame, grid: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts per threshold; refused means the score is below it.

    Scores are counted into the intervals between thresholds in one pass, so the grid never
    multiplies the table; the cumulative step runs over grid-sized data.
    """
    grid = sorted(grid)
    if not grid:
        raise ValueError("no thresholds to sweep")
    points = F.array(*map(F.lit, grid))
    interval = F.size(F.filter(points, lambda t: t <= F.col("top_score")))
    counted = scored.groupBy(*by, interval.alias("_interval")).agg(
        F.count_if("answerable").alias("_a"), F.count_if(~F.col("answerable")).alias("_u")
    )
    totals = counted.groupBy(*by).agg(
        F.collect_list(F.struct("_interval", "_a", "_u")).alias("_cells"),  # at most one per interval
        F.sum("_a").alias("_na"),
        F.sum("_u").alias("_nu"),
    )
    lines = totals.select(*by, "_cells", "_na", "_nu", F.posexplode(points).alias("_i", "threshold"))
    below = F.filter("_cells", lambda c: c._interval <= F.col("_i"))

    def total(name: str):
        return F.aggregate(below, F.lit(0).cast("long"), lambda acc, c: acc + c[name])

    lines = lines.select(*by, "threshold", "_na", "_nu", total("_u").alias("true_refusals"), total("_a").alias("false_refusals"))
    return lines.select(
        *by,
        "threshold",
        "true_refusals",
        "false_refusals",
        (F.col("_na") - F.col("false_refusals")).alias("true_answers"),
        (F.col("_nu") - F.col("true_refusals")).alias("false_answers"),
    )


def _ratio(top, bottom):
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def with_rates(points: DataFrame) -> DataFrame:
    """Precision, recall, F1, false-refusal rate and break-even prevalence; 0 on empty denominators."""
    tr, fr, ta, fa = map(F.col, ("true_refusals", "false_refusals", "true_answers", "false_answers"))
    rated = points.select(
        "*",
        _ratio(tr, tr + fr).alias("precision"),
        _ratio(tr, tr + fa).alias("recall"),
        _ratio(fr, fr + ta).alias("false_refusal_rate"),
    )
    p, r, f = map(F.col, ("precision", "recall", "false_refusal_rate"))
    return rated.select("*", _ratio(2 * p * r, p + r).alias("f1"), _ratio(f, r + f).alias("break_even_prevalence"))


def recommend(
    rated: DataFrame,
    max_false_refusals: float = S.MAX_FALSE_REFUSAL_RATE,
    min_precision: float = S.MIN_REFUSAL_PRECISION,
) -> DataFrame:
    """One row: the chosen threshold, whether any point was eligible, and why.

    Most refusal recall among eligible points, then fewer false refusals, then the lower threshold;
    with none eligible the point that costs answerable questions least.
    """
    eligible = (F.col("false_refusal_rate") <= max_false_refusals) & (F.col("precision") >= min_precision)
    marked = rated.withColumn("eligible", eligible)
    key = F.struct(
        (~F.col("eligible")).alias("a"),
        F.when(F.col("eligible"), -F.col("recall")).otherwise(F.lit(0.0)).alias("b"),
        F.col("false_refusal_rate").alias("c"),
        F.col("threshold").alias("d"),
    )
    fields = ["threshold", "eligible", "precision", "recall", "false_refusal_rate", "f1"]
    best = marked.agg(F.min_by(F.struct(*fields), key).alias("best"), F.max("precision").alias("best_precision"))
    reason = F.when(
        F.col("best.eligible"), F.lit("most refusal recall inside the false-refusal budget and precision floor")
    ).otherwise(F.lit("no threshold is eligible: the score does not separate the populations"))
    return best.select("best.*", "best_precision", reason.alias("reason"))


def refusal_by_dialect(scored: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Answerable, scored pairs only: n, refused and rate per dialect tag."""
    tags = pairs.select(F.col("query_id").alias("pair_id"), "dialect_tag")
    joined = scored.where("answerable").join(tags, "pair_id")
    grouped = joined.groupBy("dialect_tag").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("top_score") < threshold).alias("refused")
    )
    return grouped.withColumn("rate", F.col("refused") / F.col("n"))


def auc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """P(an unanswerable pair scores below an answerable one), ties half; 0 when a side is empty.

    Works on distinct scores with counts, so ties collapse and no pair of rows is ever formed.
    """
    counts = scored.groupBy(*by, "top_score").agg(
        F.count_if("answerable").alias("a"), F.count_if(~F.col("answerable")).alias("u")
    )
    ranked = running_totals(counts, by, "top_score", ["u"])
    wins = F.col("a") * (F.col("cum_u") - F.col("u") + 0.5 * F.col("u"))
    grouped = ranked.groupBy(*by).agg(
        F.sum(wins).alias("_wins"), F.sum("a").alias("n_answerable"), F.sum("u").alias("n_unanswerable")
    )
    value = _ratio(F.col("_wins"), F.col("n_answerable") * F.col("n_unanswerable"))
    return grouped.select(*by, value.alias("auc"), "n_answerable", "n_unanswerable")


def populations(scored: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every scored pair once under "all" and once under its dialect tag."""
    tags = pairs.select(F.col("query_id").alias("pair_id"), "dialect_tag")
    tagged = scored.join(tags, "pair_id", "left")
    names = F.array_compact(F.array(F.lit("all"), F.col("dialect_tag")))
    return tagged.withColumn("population", F.explode(names))


def distribution(scored: DataFrame, pairs: DataFrame) -> DataFrame:
    """Score quantiles per population and answerability."""
    return rounded_index(populations(scored, pairs), ["population", "answerable"], "top_score", QUARTILES)


def separability(scored: DataFrame, pairs: DataFrame) -> DataFrame:
    """AUC per population, and standard against dialect register over answerable pairs."""
    grouped = auc(populations(scored, pairs), ["population"])
    tags = pairs.select(F.col("query_id").alias("pair_id"), "dialect_tag")
    registers = scored.where("answerable").join(tags, "pair_id").where(F.col("dialect_tag").isin(*S.DIALECT_TAGS))
    registers = registers.withColumn("answerable", F.col("dialect_tag") == "msa").withColumn("population", F.lit("msa over gulf"))
    return grouped.unionByName(auc(registers, ["population"]))


def audit_refused(scored: DataFrame, pairs: DataFrame, contexts: DataFrame, threshold: float) -> DataFrame:
    """Refused answerable pairs: was the gold chunk in the context, and was it first?"""
    gold = pairs.select(
        F.col("query_id").alias("pair_id"), "dialect_tag", F.explode("source_chunk_ids").alias("chunk_id")
    )
    refused = scored.where(F.col("answerable") & (F.col("top_score") < threshold))
    hits = contexts.select(F.col("query_id").alias("pair_id"), "chunk_id", "rank")
    judged = refused.join(gold, "pair_id").join(hits, ["pair_id", "chunk_id"], "left")
    return judged.groupBy("pair_id", "dialect_tag", "top_score").agg(
        (F.count("rank") > 0).alias("gold_in_context"),
        (F.count_if(F.col("rank") == 1) > 0).alias("gold_at_rank_1"),
    )


def margins(hits: DataFrame, depth: int = S.CONTEXT_DEPTH) -> DataFrame:
    """(query_id, margin): top score minus the score at ``depth``, or at the last hit above it."""
    shallow = hits.where(F.col("rank") <= depth)
    return shallow.groupBy("query_id").agg(
        (F.max_by("score", -F.col("rank")) - F.max_by("score", "rank")).alias("margin")
    )


def score_drift(scored: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, status): pairs without a cached score, and scores whose pair is gone."""
    left = pairs.select(F.col("query_id").alias("pair_id"), F.lit(True).alias("_p"))
    right = scored.select("pair_id", F.lit(True).alias("_s"))
    joined = left.join(right, "pair_id", "full")
    status = F.when(F.col("_s").isNull(), "unscored").when(F.col("_p").isNull(), "stale")
    return joined.select("pair_id", status.alias("status")).where(F.col("status").isNotNull())
