"""Stage latency, histograms, counters and status summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from daftar import settings as S
from daftar.operators.ordered import nearest_rank


def budget_table(spark: SparkSession, budget: dict[str, float] | None = None, total: float = S.TOTAL_BUDGET_MS) -> DataFrame:
    budget = S.STAGE_BUDGET_MS if budget is None else budget
    rows = [(i, name, float(ms)) for i, (name, ms) in enumerate(budget.items())]
    return spark.createDataFrame([*rows, (len(rows), "total", float(total))], "position int, stage string, budget double")


def stage_summary(samples: DataFrame, budget: DataFrame) -> DataFrame:
    """n, p50, p95 and budget per stage; budgeted stages without samples and unknown ones are kept.

    The end-to-end stage is listed only when it was sampled. ``position`` gives the report order.
    """
    found = nearest_rank(samples, ["stage"], "ms", {"p50": 0.50, "p95": 0.95})
    joined = budget.join(found, "stage", "full")
    joined = joined.where((F.col("stage") != "total") | F.col("n").isNotNull())
    return joined.select(
        "stage",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.round(F.coalesce("p50", F.lit(0.0)), 2).alias("p50"),
        F.round(F.coalesce("p95", F.lit(0.0)), 2).alias("p95"),
        "budget",
        "position",
    )


def budget_verdicts(summary: DataFrame, generated: bool) -> DataFrame:
    """One line per stage: ok, no samples, unbudgeted, over, or skipped without generation."""
    skipped = F.col("stage").isin("total", "generate") & F.lit(not generated)
    verdict = (
        F.when(skipped, "skipped")
        .when(F.col("n") == 0, "no samples")
        .when(F.col("budget").isNull(), "unbudgeted")
        .when(F.col("p95") > F.col("budget"), "over")
        .otherwise("ok")
    )
    over = F.when(F.col("p95") > F.col("budget"), F.col("p95") - F.col("budget"))
    return summary.withColumn("verdict", verdict).withColumn("over_ms", F.when(verdict == "over", over))


def seeded_sample(pairs: DataFrame, n: int, seed: int = 0, key: str = "query_id") -> DataFrame:
    """``n`` answerable pairs in a fixed pseudo-random order; all of them when there are fewer."""
    if n < 1:
        raise ValueError(f"n must be >= 1, got {n}")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return pairs.where(F.size("source_chunk_ids") > 0).orderBy(order, key).limit(n)


def histogram(samples: DataFrame, by: Sequence[str], value: str, bounds: Sequence[float] = S.LATENCY_BOUNDS_S) -> DataFrame:
    """Cumulative counts per upper bound, with a last infinite one: (by, le, count)."""
    edges = F.array(*map(F.lit, bounds))
    slot = F.size(F.filter(edges, lambda b: b < F.col(value)))
    counted = samples.groupBy(*by, slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
    cells = counted.groupBy(*by).agg(F.collect_list(F.struct("_slot", "_n")).alias("_cells"))  # at most one per bound
    every = F.concat(edges, F.array(F.lit(float("inf"))))
    lines = cells.select(*by, "_cells", F.posexplode(every).alias("_i", "le"))
    upto = F.filter("_cells", lambda c: c._slot <= F.col("_i"))
    total = F.aggregate(upto, F.lit(0).cast("long"), lambda acc, c: acc + c._n)
    return lines.select(*by, "le", total.alias("count"))


def histogram_quantile(buckets: DataFrame, by: Sequence[str], q: float, totals: DataFrame | None = None) -> DataFrame:
    """Quantile by linear interpolation inside the first bucket that reaches it.

    ``buckets`` is (by, le, count) with any further labels; series of one group are added per bound
    first. ``totals`` (by, total) gives the observation counts where they come from their own
    series; otherwise the last bucket's count is the total.
    """
    summed = buckets.groupBy(*by, "le").agg(F.sum("count").alias("count"))
    if totals is None:
        totals = summed.groupBy(*by).agg(F.max_by("count", "le").alias("total"))
    ordered = Window.partitionBy(*by).orderBy("le")  # one row per bound
    stepped = summed.withColumns(
        {
            "_le0": F.coalesce(F.lag("le").over(ordered), F.lit(0.0)),
            "_n0": F.coalesce(F.lag("count").over(ordered), F.lit(0.0)),
        }
    ).join(totals, list(by))
    target = F.lit(q) * F.col("total")
    span = F.col("count") - F.col("_n0")
    inside = F.col("_le0") + (F.col("le") - F.col("_le0")) * ((target - F.col("_n0")) / span)
    value = F.when(F.col("le") == float("inf"), F.col("_le0")).when(span <= 0, F.col("le")).otherwise(inside)
    reached = F.when(F.col("count") >= target, F.struct("le", value.alias("v")))
    found = stepped.withColumn("_hit", reached).groupBy(*by).agg(
        F.min("_hit").alias("_hit"), F.max("le").alias("_last"), F.first("total").alias("total")
    )
    return found.select(*by, "total", F.coalesce("_hit.v", "_last").alias("quantile"))


def stage_rows(samples: DataFrame, q: float = 0.95) -> DataFrame:
    """Per stage from metric samples (name, labels, value): calls, mean and a bucket quantile."""
    stage = F.try_element_at("labels", F.lit("stage"))
    staged = samples.withColumn("stage", stage).where(F.col("stage").isNotNull())
    prefix = "rag_stage_duration_seconds"
    sums = staged.groupBy("stage").agg(
        F.coalesce(F.sum(F.when(F.col("name") == f"{prefix}_count", F.col("value"))), F.lit(0.0)).alias("calls"),
        F.coalesce(F.sum(F.when(F.col("name") == f"{prefix}_sum", F.col("value"))), F.lit(0.0)).alias("_sum"),
    )
    le = F.try_element_at("labels", F.lit("le"))
    bound = F.when(le == "+Inf", F.lit(float("inf"))).otherwise(le.try_cast("double"))
    buckets = staged.where(F.col("name") == f"{prefix}_bucket").select("stage", bound.alias("le"), F.col("value").alias("count"))
    quantile = histogram_quantile(buckets, ["stage"], q, sums.select("stage", F.col("calls").alias("total")))
    mean = F.coalesce(F.try_divide(F.col("_sum"), F.col("calls")), F.lit(0.0))
    joined = sums.join(quantile.drop("total"), "stage", "left")
    return joined.select("stage", "calls", mean.alias("mean"), F.coalesce("quantile", F.lit(0.0)).alias("quantile"))


def label(name: str) -> Column:
    return F.try_element_at("labels", F.lit(name))


def cards(samples: DataFrame) -> DataFrame:
    """One row of headline numbers from metric samples."""

    def total(name: str, where: Column | None = None) -> Column:
        wanted = F.col("name") == name if where is None else (F.col("name") == name) & where
        return F.coalesce(F.sum(F.when(wanted, F.col("value"))), F.lit(0.0))

    tokens, lookups = "gen_ai_client_token_usage_total", "rag_cache_lookups_total"
    row = samples.agg(
        total("rag_requests_total").alias("requests"),
        total(lookups, label("hit") == "true").alias("cache_hits"),
        total(lookups, label("hit") == "false").alias("cache_misses"),
        total(tokens, label("gen_ai_token_type") == "input").alias("input_tokens"),
        total(tokens, label("gen_ai_token_type") == "output").alias("output_tokens"),
        total("rag_cost_usd_total").alias("cost_usd"),
    )
    rate = F.try_divide(F.col("cache_hits"), F.col("cache_hits") + F.col("cache_misses"))
    return row.withColumn("cache_hit_rate", rate)


def spend_by_model(samples: DataFrame) -> DataFrame:
    """Tokens in, tokens out and cost per provider and model."""
    name = F.col("name")
    wanted = name.startswith("gen_ai_client_token_usage_total") | (name == "rag_cost_usd_total")
    cost = F.when(name == "rag_cost_usd_total", F.col("value"))
    is_input = label("gen_ai_token_type") == "input"
    read = F.when((name != "rag_cost_usd_total") & F.coalesce(is_input, F.lit(False)), F.col("value"))
    written = F.when((name != "rag_cost_usd_total") & ~F.coalesce(is_input, F.lit(False)), F.col("value"))
    return samples.where(wanted).groupBy(
        F.coalesce(label("gen_ai_provider_name"), F.lit("?")).alias("provider"),
        F.coalesce(label("gen_ai_request_model"), F.lit("?")).alias("model"),
    ).agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for c, n in ((read, "input"), (written, "output"), (cost, "cost"))))


# --- counters -------------------------------------------------------------------------------------


def _step(value: str, before: str, window: WindowSpec) -> Column:
    """What a cumulative counter gained since the row before; all of it where it fell, NULL at the start."""
    gained = F.col(value) - F.lag(before).over(window)
    return F.when(gained < 0, F.col(value)).otherwise(gained)


def counter_increases(samples: DataFrame, series: Sequence[str], bucket: str = "1 hour", slices: int = 256) -> DataFrame:
    """Increase of each cumulative series per time bucket: (series, bucket, increase).

    A drop means the counter restarted, so the new value is the increase; the first sample of a
    series has none. The carry goes up in levels: samples within one of a bucket's ``slices``, slices
    within the bucket, buckets within the series. Each level keeps its own increase and its edge
    samples only, so no task orders more than a slice of a hot bucket or a bucket's row per slice.
    """
    span = F.window(F.col("ts").cast("timestamp"), bucket)
    placed = samples.select(*series, span.alias("_w"), "ts", "value")
    start, end = F.unix_micros("_w.start"), F.unix_micros("_w.end")
    share = (F.unix_micros(F.col("ts").cast("timestamp")) - start) * slices / (end - start)
    placed = placed.select(*series, F.col("_w.start").alias("bucket"), F.floor(share).alias("_slice"), "ts", "value")
    inside = Window.partitionBy(*series, "bucket", "_slice").orderBy("ts", "value")
    at = F.struct("ts", "value")
    cut = placed.withColumn("_inc", _step("value", "value", inside)).groupBy(*series, "bucket", "_slice").agg(
        F.coalesce(F.sum("_inc"), F.lit(0.0)).alias("_inside"), F.min_by("value", at).alias("_first"), F.max_by("value", at).alias("_last")
    )
    between = Window.partitionBy(*series, "bucket").orderBy("_slice")
    edges = cut.withColumn("_jump", _step("_first", "_last", between)).groupBy(*series, "bucket").agg(
        F.sum(F.col("_inside") + F.coalesce("_jump", F.lit(0.0))).alias("_inside"),
        F.min_by("_first", "_slice").alias("_first"), F.max_by("_last", "_slice").alias("_last"),
    )
    across = Window.partitionBy(*series).orderBy("bucket")
    joined = edges.withColumn("_jump", _step("_first", "_last", across))
    return joined.select(*series, "bucket", (F.col("_inside") + F.coalesce("_jump", F.lit(0.0))).alias("increase"))


def rates(events: DataFrame, by: Sequence[str] = (), bucket: str = "1 hour") -> DataFrame:
    """Per time bucket from raw request events: rate per second, error share, spend per hour."""
    start = F.window(F.col("ts").cast("timestamp"), bucket)
    grouped = events.groupBy(*by, start.alias("w")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") != "ok").alias("errors"),
        F.sum("usd").alias("usd"),
    )
    seconds = F.col("w.end").cast("long") - F.col("w.start").cast("long")
    return grouped.select(
        *by,
        F.col("w.start").alias("bucket"),
        (F.col("n") / seconds).alias("per_second"),
        (100 * F.col("errors") / F.col("n")).alias("error_percent"),
        (3600 * F.col("usd") / seconds).alias("usd_per_hour"),
    )


def dashboard_panels(increases: DataFrame, seconds: int) -> DataFrame:
    """Every panel of the service dashboard from counter increases (name, labels, bucket, increase).

    One conditional aggregation per bucket: request rate, error share, cache-hit share, share of
    misses refused before generation, token rate, burn rate and failed-provider rate.
    """

    def total(name: str, where: Column | None = None) -> Column:
        wanted = F.col("name") == name if where is None else (F.col("name") == name) & where
        return F.coalesce(F.sum(F.when(wanted, F.col("increase"))), F.lit(0.0))

    ask = label("route") == "/ask"
    sums = increases.groupBy("bucket").agg(
        total("rag_requests_total", ask).alias("_asked"),
        total("rag_requests_total", ask & (label("status") != "ok")).alias("_failed"),
        total("rag_requests_total", ask & (label("status") == "providers_failed")).alias("_exhausted"),
        total("rag_cache_lookups_total").alias("_lookups"),
        total("rag_cache_lookups_total", label("hit") == "true").alias("_hits"),
        total("rag_cache_lookups_total", label("hit") == "false").alias("_misses"),
        total("rag_stage_duration_seconds_count", label("stage") == "generate").alias("_generated"),
        total("gen_ai_client_token_usage_total").alias("_tokens"),
        total("rag_cost_usd_total").alias("_usd"),
    )
    refused = F.greatest(F.col("_misses") - F.col("_generated"), F.lit(0.0))
    return sums.select(
        "bucket",
        (F.col("_asked") / seconds).alias("requests_per_second"),
        F.try_divide(100 * F.col("_failed"), F.col("_asked")).alias("error_percent"),
        F.try_divide(100 * F.col("_hits"), F.col("_lookups")).alias("cache_hit_percent"),
        F.try_divide(100 * refused, F.col("_misses")).alias("refusal_percent"),
        (F.col("_tokens") / seconds).alias("tokens_per_second"),
        (3600 * F.col("_usd") / seconds).alias("usd_per_hour"),
        (F.col("_exhausted") / seconds).alias("exhausted_per_second"),
    )


def rate_by_label(increases: DataFrame, name: str, key: str, seconds: int) -> DataFrame:
    """Per-second rate of one counter, split by one label."""
    wanted = increases.where(F.col("name") == name)
    return wanted.groupBy("bucket", label(key).alias(key)).agg((F.sum("increase") / seconds).alias("rate"))


def stage_means(increases: DataFrame) -> DataFrame:
    """Mean milliseconds per stage and bucket: increase of the sum over increase of the count."""
    prefix = "rag_stage_duration_seconds"
    grouped = increases.groupBy("bucket", label("stage").alias("stage")).agg(
        F.sum(F.when(F.col("name") == f"{prefix}_sum", F.col("increase"))).alias("_s"),
        F.sum(F.when(F.col("name") == f"{prefix}_count", F.col("increase"))).alias("_n"),
    )
    return grouped.where(F.col("_n").isNotNull()).select("bucket", "stage", F.try_divide(1000 * F.col("_s"), F.col("_n")).alias("mean_ms"))


# --- corpus and status ------------------------------------------------------------------------------


def corpus_stats(chunks: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """One row: chunks, distinct documents, and per model the embedded count and coverage."""
    columns = S.EMBEDDING_COLUMNS if columns is None else columns
    present = {k: c for k, c in columns.items() if c in chunks.columns}
    totals = chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_distinct("doc_id").alias("documents"),
        *(F.count(c).alias(f"{k}_chunks") for k, c in present.items()),
    )
    covered = {
        f"{k}_coverage": F.round(F.coalesce(F.try_divide(F.col(f"{k}_chunks"), F.col("chunks")), F.lit(0.0)), 4)
        for k in present
    }
    return totals.withColumns(covered) if covered else totals


def document_stats(chunks: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Chunk and embedding counts per document plus a total row (doc_id NULL)."""
    columns = S.EMBEDDING_COLUMNS if columns is None else columns
    present = {k: c for k, c in columns.items() if c in chunks.columns}
    counts = [F.count(F.lit(1)).alias("chunks"), *(F.count(c).alias(k) for k, c in present.items())]
    return chunks.rollup("doc_id").agg(*counts)


def status_summary(corpus: DataFrame, cache: DataFrame, spend: DataFrame, configured: str, available: Sequence[str]) -> DataFrame:
    """Corpus, cache and spend rows side by side, and the configured providers without a key."""
    names = [name.strip() for name in configured.split(",") if name.strip()]
    wanted, ready = (F.array(*map(F.lit, x)).cast("array<string>") for x in (names, list(available)))
    row = corpus
    for part in (cache, spend):
        row = row.join(F.broadcast(part))  # each side is one aggregate row
    return row.withColumn("configured", F.array_join(wanted, ",")).withColumn(
        "missing_keys", F.array_join(F.array_except(wanted, ready), ",")
    )
