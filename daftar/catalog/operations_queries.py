"""Cost, admission, latency, counters, status and table maintenance over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from daftar import settings as S
from daftar.catalog.base import MONEY, query
from daftar.operators import ledger as G
from daftar.operators import opsmetrics as O
from daftar.operators.ordered import nearest_rank
from daftar.sources import labelled as L
from daftar.sources import tables as U
from daftar.streaming import metrics as X

_MODEL = """CASE event_type WHEN 'view' THEN 'claude-haiku-4-5-20251001' WHEN 'click' THEN 'gemini-2.5-pro' WHEN 'purchase' THEN 'claude-opus-5' WHEN 'signup' THEN 'gemini-2.5-flash' ELSE 'other-model' END"""
_USAGE = f"SELECT event_id, ts, {_MODEL} AS model, user_id * 100 AS input_tokens, CAST(floor(value) AS BIGINT) AS output_tokens, props AS text, user_id FROM events"


def _usage(t):
    kind = F.col("event_type")
    model = (
        F.when(kind == "view", "claude-haiku-4-5-20251001").when(kind == "click", "gemini-2.5-pro")
        .when(kind == "purchase", "claude-opus-5").when(kind == "signup", "gemini-2.5-flash").otherwise("other-model")
    )
    return t.events.select(
        "event_id", "ts", model.alias("model"), (F.col("user_id") * 100).alias("input_tokens"),
        F.floor("value").alias("output_tokens"), F.col("props").alias("text"), "user_id",
    )


def _price(position: int) -> str:
    cases = " ".join(f"WHEN starts_with(model, '{k}') THEN {v[position]}" for k, v in S.PREFIX_PRICES.items())
    return f"CASE {cases} END"


_PRICED = f"SELECT *, (input_tokens * {_price(0)} + output_tokens * {_price(1)}) / 1000000 AS cost_usd FROM ({_USAGE}) u"


@query(
    "prefix_priced",
    f"SELECT event_id, round(cost_usd, 9) AS cost_usd, CASE WHEN cost_usd IS NULL THEN 'no price' END AS reject_reason FROM ({_PRICED}) p",
    places=MONEY,
)
def _(t):
    return G.prefix_priced(_usage(t)).select("event_id", "cost_usd", "reject_reason")


@query(
    "completed_usage",
    f"""SELECT event_id, output_tokens, round(CASE model WHEN 'claude-haiku-4-5-20251001' THEN (input_tokens * 1.0 + output_tokens * 5.0) / 1000000
        WHEN 'gemini-2.5-flash' THEN (input_tokens * 0.3 + output_tokens * 2.5) / 1000000 END, 9) AS cost_usd,
        CASE WHEN model NOT IN ('claude-haiku-4-5-20251001', 'gemini-2.5-flash') THEN 'no price' END AS reject_reason
        FROM (SELECT event_id, model, input_tokens, CASE WHEN output_tokens = 0 THEN length(text) // 3 ELSE output_tokens END AS output_tokens FROM ({_USAGE}) u) v""",
    places=MONEY,
)
def _(t):
    return G.completed_usage(_usage(t)).select("event_id", "output_tokens", "cost_usd", "reject_reason")


@query(
    "daily_spend",
    f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, round(sum(cost_usd), 9) AS usd, count(*) AS calls, round(greatest(0, 0.5 - sum(cost_usd)), 9) AS remaining
        FROM ({_PRICED}) p WHERE cost_usd IS NOT NULL GROUP BY 1""",
    places=MONEY,
)
def _(t):
    return G.daily_spend(G.prefix_priced(_usage(t)).where("cost_usd IS NOT NULL"), 0.5)


def _holds(t):
    """Every event holds its value; errors never settle, the rest settle at half an hour later."""
    reserve = t.events.select("event_id", "ts", F.col("event_id").alias("request_id"), F.lit("reserve").alias("kind"), F.col("value").alias("usd"))
    settle = t.events.where("event_type <> 'error'").select(
        (F.col("event_id") + 10_000_000).alias("event_id"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("ts"),
        F.col("event_id").alias("request_id"), F.lit("settle").alias("kind"), (F.col("value") / 2).alias("usd"),
    )
    return reserve.unionByName(settle)


# One event of every day in each step; the state is the total, the calls and what is held.
_WALK = """
    WITH RECURSIVE held AS (
      SELECT event_id, ts, event_id AS request_id, 'reserve' AS kind, value AS usd FROM events
      UNION ALL SELECT event_id + 10000000, ts + INTERVAL 30 MINUTES, event_id, 'settle', value / 2 FROM events WHERE event_type <> 'error'),
    e AS (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS n,
                 CAST(usd AS DECIMAL(38, 12)) AS amount FROM held),
    walk AS (
      SELECT date, 0::BIGINT AS n, 0::BIGINT AS event_id, NULL::BOOLEAN AS accepted, 0::DECIMAL(38, 12) AS usd, 0::BIGINT AS calls, MAP {}::MAP(BIGINT, DECIMAL(38, 12)) AS open
      FROM (SELECT DISTINCT date FROM e) d
      UNION ALL
      SELECT w.date, e.n, e.event_id, CASE WHEN e.kind = 'reserve' THEN w.usd + e.amount < 2500 END,
        CASE WHEN e.kind = 'reserve' THEN CASE WHEN w.usd + e.amount < 2500 THEN w.usd + e.amount ELSE w.usd END
             WHEN map_contains(w.open, e.request_id) THEN greatest(0, w.usd - w.open[e.request_id] + e.amount) ELSE w.usd END,
        w.calls + CASE WHEN e.kind = 'settle' AND map_contains(w.open, e.request_id) THEN 1 ELSE 0 END,
        CASE WHEN e.kind = 'settle' THEN map_from_entries(list_filter(map_entries(w.open), lambda h: h.key <> e.request_id))
             WHEN w.usd + e.amount < 2500 THEN map_concat(w.open, MAP {e.request_id: e.amount}) ELSE w.open END
      FROM walk w JOIN e ON e.date = w.date AND e.n = w.n + 1)
"""


@query("spend_admission", _WALK + "SELECT event_id, accepted, round(usd::DOUBLE, 6) AS usd, calls FROM walk WHERE n > 0")
def _(t):
    return G.spend_admission(_holds(t), 2500.0)


@query(
    "daily_admission",
    _WALK + """SELECT date, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE NOT accepted) AS rejected,
        round(arg_max(usd, n)::DOUBLE, 6) AS usd, arg_max(calls, n) AS calls FROM walk WHERE n > 0 GROUP BY date""",
)
def _(t):
    return G.daily_admission(_holds(t), 2500.0)


def _sql_windows(key: str, limit: int, seconds: int) -> str:
    """One request of every key in each step; the state is the accepted times of the last window."""
    return f"""
    WITH RECURSIVE e AS (SELECT event_id, {key} AS k, epoch_us(ts) AS us, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM events),
    walk AS (
      SELECT k, 0::BIGINT AS n, 0::BIGINT AS event_id, false AS accepted, []::BIGINT[] AS kept FROM (SELECT DISTINCT k FROM e) d
      UNION ALL
      SELECT w.k, e.n, e.event_id, len(list_filter(w.kept, lambda x: e.us - x < {seconds * 1_000_000})) < {limit},
        CASE WHEN len(list_filter(w.kept, lambda x: e.us - x < {seconds * 1_000_000})) < {limit}
             THEN list_append(list_filter(w.kept, lambda x: e.us - x < {seconds * 1_000_000}), e.us)
             ELSE list_filter(w.kept, lambda x: e.us - x < {seconds * 1_000_000}) END
      FROM walk w JOIN e ON e.k = w.k AND e.n = w.n + 1)
    SELECT event_id, accepted FROM walk WHERE n > 0"""


@query("sliding_window_admission", _sql_windows("user_id", 2, 6 * 3600))
def _(t):
    return G.sliding_window_admission(t.events, 2, 6 * 3600)


@query("sliding_window_global", _sql_windows("'all'", 3, 900))
def _(t):
    # one key holds every request: the hot case
    return G.sliding_window_admission(t.events.withColumn("k", F.lit("all")), 3, 900, key="k")


def _attempts(t):
    order = F.col("l_linenumber")
    status = F.when(order % 4 == 0, 429).when(order % 4 == 1, 503).when(order % 4 == 2, 400)
    rows = t.read("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    return rows.select(
        F.col("l_orderkey").alias("request_id"), order.alias("attempt"),
        F.when(order <= 2, "anthropic").otherwise("gemini").alias("provider"), (F.col("q") > 40).alias("ok"), status.alias("status"),
    )


_ATTEMPTS = """SELECT l_orderkey AS request_id, l_linenumber AS attempt, CASE WHEN l_linenumber <= 2 THEN 'anthropic' ELSE 'gemini' END AS provider, max(l_quantity) > 40 AS ok,
    CASE l_linenumber % 4 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'server' WHEN 2 THEN 'fatal' ELSE 'server' END AS kind FROM lineitem GROUP BY l_orderkey, l_linenumber"""


@query(
    "classify_attempts",
    f"SELECT provider, kind, count(*) AS n, kind <> 'fatal' AS retryable, kind <> 'fatal' AS fails_over FROM ({_ATTEMPTS}) a WHERE NOT ok GROUP BY provider, kind",
)
def _(t):
    failed = G.classify_attempts(_attempts(t)).where(~F.col("ok"))
    return failed.groupBy("provider", "kind", "retryable", "fails_over").agg(F.count(F.lit(1)).alias("n"))


@query(
    "failover_chains",
    f"""SELECT request_id, coalesce(string_agg(provider || ':' || kind, ' > ' ORDER BY attempt) FILTER (WHERE NOT ok), '') AS chain, arg_min(provider, attempt) AS first_provider,
        max(provider) FILTER (WHERE ok) AS served_by, coalesce(max(provider) FILTER (WHERE ok) <> arg_min(provider, attempt), false) AS failed_over FROM ({_ATTEMPTS}) a GROUP BY request_id""",
)
def _(t):
    return G.failover_chains(_attempts(t))


# --- latency ----------------------------------------------------------------------------------------------

_RANKED = "SELECT stage, ms, row_number() OVER (PARTITION BY stage ORDER BY ms) AS i, count(*) OVER (PARTITION BY stage) AS c FROM ({src}) s"
_STAGES = """SELECT CASE event_type WHEN 'view' THEN 'plan' WHEN 'click' THEN 'embed' WHEN 'purchase' THEN 'retrieve' WHEN 'signup' THEN 'total' ELSE event_type END AS stage, value AS ms FROM events"""
_BUDGET = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {v}::DOUBLE)" for i, (k, v) in enumerate([*S.STAGE_BUDGET_MS.items(), ("total", S.TOTAL_BUDGET_MS)])) + ") b(position, stage, budget)"
_SUMMARY = f"""
    SELECT coalesce(b.stage, g.stage) AS stage, coalesce(n, 0) AS n, round(coalesce(p50, 0), 2) AS p50, round(coalesce(p95, 0), 2) AS p95, budget, CAST(position AS BIGINT) AS position
    FROM ({_BUDGET}) b FULL JOIN (SELECT stage, count(*) AS n, max(ms) FILTER (WHERE i = ceil(0.5 * c)) AS p50, max(ms) FILTER (WHERE i = ceil(0.95 * c)) AS p95
      FROM ({_RANKED.format(src=_STAGES)}) r GROUP BY stage) g ON b.stage = g.stage
"""


def _samples(t):
    names = {"view": "plan", "click": "embed", "purchase": "retrieve", "signup": "total"}
    stage = F.col("event_type")
    for old, new in names.items():
        stage = F.when(F.col("event_type") == old, new).otherwise(stage)
    return t.events.select(stage.alias("stage"), F.col("value").alias("ms"), "ts")


@query(
    "nearest_rank",
    f"SELECT stage AS user, count(*) AS n, max(ms) FILTER (WHERE i = ceil(0.5 * c)) AS p50, max(ms) FILTER (WHERE i = ceil(0.9 * c)) AS p90 FROM ({_RANKED.format(src='SELECT user_id AS stage, value AS ms FROM events')}) r GROUP BY stage",
)
def _(t):
    return nearest_rank(t.events.withColumnRenamed("user_id", "user"), ["user"], "value", {"p50": 0.5, "p90": 0.9})


@query("stage_summary", f"SELECT stage, n, p50, p95, budget FROM ({_SUMMARY}) s")
def _(t):
    return O.stage_summary(_samples(t), O.budget_table(t.spark)).drop("position")


@query(
    "budget_verdicts",
    f"""SELECT stage, n, p95, CASE WHEN stage IN ('total', 'generate') THEN 'skipped' WHEN n = 0 THEN 'no samples' WHEN budget IS NULL THEN 'unbudgeted' WHEN p95 > budget THEN 'over' ELSE 'ok' END AS verdict FROM ({_SUMMARY}) s""",
)
def _(t):
    return O.budget_verdicts(O.stage_summary(_samples(t), O.budget_table(t.spark)), generated=False).select("stage", "n", "p95", "verdict")


@query(
    "seeded_sample",
    "SELECT query_id FROM labelled WHERE len(source_chunk_ids) > 0 ORDER BY md5('0:' || query_id), query_id LIMIT 30",
    ("labelled",),
)
def _(t):
    return O.seeded_sample(t.labelled, 30).select("query_id")


_BOUNDS = "SELECT unnest([" + ", ".join(map(str, S.LATENCY_BOUNDS_S)) + ", 'inf'::DOUBLE]) AS le"
_HIST = f"SELECT stage, le, CAST(sum(CASE WHEN ms / 100 <= le THEN 1 ELSE 0 END) AS BIGINT) AS n FROM ({_STAGES}) s CROSS JOIN ({_BOUNDS}) b GROUP BY stage, le"


def _hist(t):
    return O.histogram(_samples(t).withColumn("s", F.col("ms") / 100), ["stage"], "s")


@query("latency_histogram", f"SELECT stage, CAST(le AS VARCHAR) AS le, n AS count FROM ({_HIST}) h")
def _(t):
    le = F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string"))
    return _hist(t).withColumn("le", le)


@query(
    "histogram_quantile",
    f"""SELECT stage, CAST(any_value(total) AS BIGINT) AS total, round(arg_min(CASE WHEN isinf(le) THEN le0 WHEN n - n0 <= 0 THEN le ELSE le0 + (le - le0) * ((0.95 * total - n0) / (n - n0)) END, le), 6) AS quantile FROM (
        SELECT stage, le, n, coalesce(lag(le) OVER w, 0) AS le0, coalesce(lag(n) OVER w, 0) AS n0, max(n) OVER (PARTITION BY stage) AS total FROM ({_HIST}) h WINDOW w AS (PARTITION BY stage ORDER BY le)) x
        WHERE n >= 0.95 * total GROUP BY stage""",
)
def _(t):
    return O.histogram_quantile(_hist(t), ["stage"], 0.95)


def _exposition(t):
    """Events as metric samples: one counter and one stage-duration series per kind and outcome."""
    labels = F.create_map(F.lit("stage"), F.col("stage"), F.lit("error"), (F.col("ms") > 100).cast("string"))
    prefix = "rag_stage_duration_seconds"
    base = _samples(t).withColumn("s", F.col("ms") / 100)
    hist = O.histogram(base.withColumn("error", (F.col("ms") > 100).cast("string")), ["stage", "error"], "s")
    le = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string"))
    buckets = hist.select(
        F.lit(f"{prefix}_bucket").alias("name"),
        F.create_map(F.lit("stage"), F.col("stage"), F.lit("error"), F.col("error"), F.lit("le"), le).alias("labels"),
        F.col("count").cast("double").alias("value"),
    )
    sums = base.groupBy(labels["stage"].alias("stage"), labels["error"].alias("error")).agg(F.sum("s").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    both = F.create_map(F.lit("stage"), F.col("stage"), F.lit("error"), F.col("error"))
    entries = F.explode(F.array(F.struct(F.lit(f"{prefix}_sum").alias("name"), F.col("s").alias("value")), F.struct(F.lit(f"{prefix}_count").alias("name"), F.col("n").alias("value"))))
    flat = sums.select(both.alias("labels"), entries.alias("e")).select("e.name", "labels", "e.value")
    return buckets.unionByName(flat)


@query(
    "stage_rows",
    f"""SELECT g.stage, calls, round(mean, 6) AS mean, round(quantile, 6) AS quantile FROM (SELECT stage, CAST(count(*) AS DOUBLE) AS calls, avg(ms / 100) AS mean FROM ({_STAGES}) s GROUP BY stage) g JOIN (
        SELECT stage, arg_min(CASE WHEN isinf(le) THEN le0 WHEN n - n0 <= 0 THEN le ELSE le0 + (le - le0) * ((0.95 * total - n0) / (n - n0)) END, le) AS quantile FROM (
        SELECT stage, le, n, coalesce(lag(le) OVER w, 0) AS le0, coalesce(lag(n) OVER w, 0) AS n0, max(n) OVER (PARTITION BY stage) AS total FROM ({_HIST}) h WINDOW w AS (PARTITION BY stage ORDER BY le)) x
        WHERE n >= 0.95 * total GROUP BY stage) q ON q.stage = g.stage""",
)
def _(t):
    return O.stage_rows(_exposition(t))


def _usage_samples(t):
    usage = G.prefix_priced(_usage(t)).where("cost_usd IS NOT NULL")
    provider = F.when(F.col("model").startswith("claude"), "anthropic").otherwise("gemini")
    key = [F.lit("gen_ai_provider_name"), provider, F.lit("gen_ai_request_model"), F.col("model")]

    def sample(name, value, *labels):
        return F.struct(F.lit(name).alias("name"), F.create_map(*labels).alias("labels"), value.cast("double").alias("value"))

    hit = F.when(F.col("user_id") % 3 == 0, "true").otherwise("false")
    rows = F.array(
        sample("gen_ai_client_token_usage_total", F.col("input_tokens"), *key, F.lit("gen_ai_token_type"), F.lit("input")),
        sample("gen_ai_client_token_usage_total", F.col("output_tokens"), *key, F.lit("gen_ai_token_type"), F.lit("output")),
        sample("rag_cost_usd_total", F.col("cost_usd"), *key),
        sample("rag_requests_total", F.lit(1), F.lit("route"), F.lit("/ask"), F.lit("status"), F.when(F.col("user_id") % 5 == 0, "rejected").otherwise("ok")),
        sample("rag_cache_lookups_total", F.lit(1), F.lit("hit"), hit),
        sample("rag_stage_duration_seconds_count", (F.col("user_id") % 3 > 0).cast("int"), F.lit("stage"), F.lit("generate")),
        sample("rag_stage_duration_seconds_sum", F.col("output_tokens") / 1000, F.lit("stage"), F.lit("generate")),
    )
    return usage.select("ts", F.explode(rows).alias("e")).select("ts", "e.*")


@query(
    "metric_cards",
    f"""SELECT CAST(count(*) AS DOUBLE) AS requests, CAST(sum(CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS cache_hits, CAST(sum(CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 END) AS DOUBLE) AS cache_misses,
        CAST(sum(input_tokens) AS DOUBLE) AS input_tokens, CAST(sum(output_tokens) AS DOUBLE) AS output_tokens, round(sum(cost_usd), 6) AS cost_usd,
        round(sum(CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END) / count(*), 6) AS cache_hit_rate FROM ({_PRICED}) p WHERE cost_usd IS NOT NULL""",
)
def _(t):
    return O.cards(_usage_samples(t))


@query(
    "spend_by_model",
    f"""SELECT CASE WHEN starts_with(model, 'claude') THEN 'anthropic' ELSE 'gemini' END AS provider, model, CAST(sum(input_tokens) AS DOUBLE) AS input, CAST(sum(output_tokens) AS DOUBLE) AS output, round(sum(cost_usd), 6) AS cost
        FROM ({_PRICED}) p WHERE cost_usd IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    return O.spend_by_model(_usage_samples(t))


_STEPS = """SELECT user_id, date_trunc('hour', ts) AS bucket, CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS inc FROM (
    SELECT user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, value) AS prev FROM events) e"""


@query(
    "counter_increases",
    f"SELECT user_id, strftime(bucket, '%Y-%m-%d %H:%M') AS bucket, round(sum(inc), 6) AS increase FROM ({_STEPS}) s GROUP BY user_id, bucket",
)
def _(t):
    found = O.counter_increases(t.events.select("user_id", "ts", "value"), ["user_id"])
    return found.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm"))


@query(
    "request_rates",
    """SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS bucket, round(count(*) / 3600, 6) AS per_second,
       round(100 * sum(CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END) / count(*), 6) AS error_percent, round(sum(value), 6) AS usd_per_hour FROM events GROUP BY event_type, date_trunc('hour', ts)""",
)
def _(t):
    status = F.when(F.col("user_id") % 5 == 0, "failed").otherwise("ok")
    rows = t.events.select("event_type", "ts", status.alias("status"), F.col("value").alias("usd"))
    return O.rates(rows, ["event_type"]).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm"))


def _increases(t):
    day = F.to_date("ts").cast("string").alias("bucket")
    return _usage_samples(t).select(day, "name", "labels", F.col("value").alias("increase"))


@query(
    "dashboard_panels",
    f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS bucket, round(count(*) / 86400, 6) AS requests_per_second, round(100 * sum(CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END) / count(*), 6) AS error_percent,
        round(100 * sum(CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END) / count(*), 6) AS cache_hit_percent, 0.0::DOUBLE AS refusal_percent, round(sum(input_tokens + output_tokens) / 86400, 6) AS tokens_per_second,
        round(3600 * sum(cost_usd) / 86400, 6) AS usd_per_hour, 0.0::DOUBLE AS exhausted_per_second FROM ({_PRICED}) p WHERE cost_usd IS NOT NULL GROUP BY 1""",
)
def _(t):
    return O.dashboard_panels(_increases(t), 86400)


@query(
    "rate_by_status",
    f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS bucket, CASE WHEN user_id % 5 = 0 THEN 'rejected' ELSE 'ok' END AS status, round(count(*) / 86400, 6) AS rate FROM ({_PRICED}) p WHERE cost_usd IS NOT NULL GROUP BY 1, 2",
)
def _(t):
    return O.rate_by_label(_increases(t), "rag_requests_total", "status", 86400)


@query(
    "stage_means",
    f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS bucket, 'generate' AS stage, round(1000 * sum(output_tokens / 1000) / sum(CASE WHEN user_id % 3 > 0 THEN 1 ELSE 0 END), 6) AS mean_ms FROM ({_PRICED}) p WHERE cost_usd IS NOT NULL GROUP BY 1",
)
def _(t):
    return O.stage_means(_increases(t).where("name LIKE 'rag_stage%'"))


@query(
    "windowed_metrics",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS bucket, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY date_trunc('hour', ts), event_type""",
)
def _(t):
    live = X.windowed(X.with_event_time(t.events), ["event_type"], "value", "1 hour", watermark=None)
    return live.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("bucket"), "event_type", "n", "total")


# --- corpus, status, tables ---------------------------------------------------------------------------------


def _embedded(t):
    return t.read("embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("d"), "label").alias("doc_id"), F.col("embedding").alias("emb_e5"),
        F.when(F.col("label") % 2 == 0, F.col("embedding")).alias("emb_bge"),
    )


_CORPUS = """SELECT count(*) AS chunks, count(DISTINCT label) AS documents, count(*) AS e5_chunks, CAST(sum(CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bge_chunks,
    1.0::DOUBLE AS e5_coverage, round(sum(CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END) / count(*), 4) AS bge_coverage FROM embeddings"""


@query("corpus_stats", _CORPUS)
def _(t):
    return O.corpus_stats(_embedded(t))


@query(
    "document_stats",
    """SELECT CASE WHEN label IS NOT NULL THEN 'd' || label END AS doc_id, count(*) AS chunks, count(*) AS e5, CAST(sum(CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bge
       FROM (SELECT label FROM embeddings) e GROUP BY ROLLUP (label)""",
)
def _(t):
    return O.document_stats(_embedded(t))


@query(
    "status_summary",
    f"""SELECT c.chunks, c.documents, 500 + 0 * e.n AS entries, s.usd, s.calls, 'anthropic,gemini,huggingface' AS configured, 'gemini,huggingface' AS missing_keys
        FROM ({_CORPUS}) c, (SELECT count(*) AS n FROM embeddings) e, (SELECT round(sum(cost_usd), 6) AS usd, count(*) AS calls FROM ({_PRICED}) p WHERE cost_usd IS NOT NULL AND CAST(ts AS DATE) = DATE '2024-01-02') s""".replace("500 + 0 * e.n", "e.n"),
)
def _(t):
    cache = t.read("embeddings").agg(F.count(F.lit(1)).alias("entries"))
    spend = G.daily_spend(G.prefix_priced(_usage(t)).where("cost_usd IS NOT NULL"), 100.0).where("date = '2024-01-02'").select("usd", "calls")
    row = O.status_summary(O.corpus_stats(_embedded(t)), cache, spend, "anthropic, gemini,huggingface", ["anthropic"])
    return row.select("chunks", "documents", "entries", "usd", "calls", "configured", "missing_keys")


_TARGET = "SELECT event_id AS id, user_id AS doc_id, event_type AS text, 'old' AS created_at FROM events WHERE user_id % 3 < 2"
_SOURCE = "SELECT event_id AS id, user_id AS doc_id, 'new ' || event_type AS text, 'now' AS created_at FROM events WHERE user_id % 3 > 0 AND event_type <> 'view'"


def _versions(t):
    rows = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("doc_id"), F.col("event_type").alias("text"))
    target = rows.where("doc_id % 3 < 2").withColumn("created_at", F.lit("old"))
    source = rows.where("doc_id % 3 > 0 AND text <> 'view'").withColumn("text", F.concat(F.lit("new "), "text")).withColumn("created_at", F.lit("now"))
    return target, source


@query(
    "upsert",
    f"SELECT coalesce(t.id, s.id) AS id, coalesce(s.doc_id, t.doc_id) AS doc_id, coalesce(s.text, t.text) AS text, coalesce(t.created_at, s.created_at) AS created_at FROM ({_TARGET}) t FULL JOIN ({_SOURCE}) s ON t.id = s.id",
)
def _(t):
    return U.upsert(*_versions(t))


@query(
    "upsert_pruned",
    f"""SELECT coalesce(t.id, s.id) AS id, coalesce(s.text, t.text) AS text FROM ({_TARGET}) t FULL JOIN ({_SOURCE}) s ON t.id = s.id
        WHERE s.id IS NOT NULL OR t.doc_id NOT IN (SELECT doc_id FROM ({_SOURCE}) x)""",
)
def _(t):
    target, source = _versions(t)
    return U.prune(U.upsert(target, source), source).select("id", "text")


@query(
    "last_writer",
    "SELECT user_id, arg_max(event_type, epoch_us(ts)) AS event_type, arg_max(value, epoch_us(ts)) AS value FROM events GROUP BY user_id",
)
def _(t):
    return U.last_writer(t.events.select("user_id", "event_type", "value", "ts"), ["user_id"], ["ts"]).drop("ts")


@query(
    "merge_sections",
    "SELECT coalesce(n.k, o.k) AS section, coalesce(n.v, o.v) AS body FROM (SELECT event_id AS k, props AS v FROM events WHERE event_type <> 'view') o FULL JOIN (SELECT event_id AS k, event_type AS v FROM events WHERE user_id % 2 = 0) n ON o.k = n.k",
)
def _(t):
    old = t.events.where("event_type <> 'view'").select(F.col("event_id").alias("section"), F.col("props").alias("body"))
    new = t.events.where("user_id % 2 = 0").select(F.col("event_id").alias("section"), F.col("event_type").alias("body"))
    return L.merge_sections(old, new)


@query(
    "update_baseline",
    "SELECT user_id AS entry_key, CASE WHEN user_id < 20 THEN 1.0::DOUBLE ELSE round(avg(value), 6) END AS m FROM events GROUP BY user_id",
)
def _(t):
    baseline = t.events.groupBy(F.col("user_id").alias("entry_key")).agg(F.avg("value").alias("m"))
    entry = baseline.where("entry_key < 20").withColumn("m", F.lit(1.0))
    return L.update_baseline(baseline, entry)


@query(
    "check_scores",
    """SELECT event_id AS index, CASE WHEN event_type = 'view' THEN 'missing top_score' WHEN event_type = 'click' THEN 'top_score is not a number' WHEN event_type = 'error' THEN 'not an object' END AS reject_reason,
       CASE WHEN event_type IN ('signup', 'purchase') THEN round(value, 6) END AS top_score FROM events""",
)
def _(t):
    kind = F.col("event_type")
    head = F.concat(F.lit('{"pair_id":"p'), "event_id", F.lit('","answerable":true'))
    record = (
        F.when(kind == "view", F.concat(head, F.lit("}"))).when(kind == "click", F.concat(head, F.lit(',"top_score":"x"}')))
        .when(kind == "error", F.lit("[1]")).otherwise(F.concat(head, F.lit(',"top_score":'), "value", F.lit("}")))
    )
    return L.check_scores(t.events.select(F.col("event_id").alias("index"), record.alias("record"))).select("index", "reject_reason", "top_score")
