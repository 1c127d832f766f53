"""Cost, spend and admission over usage tables."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daftar import settings as S
from daftar.functions.text import estimate_tokens
from daftar.operators.ordered import running_totals
from daftar.session import checkpoint_dir, cut_lineage, within_rows


def usage_cost(input_tokens, output_tokens, price_in, price_out) -> Column:
    """Money is added up as decimals, six places per price; the double is the nearest to the exact cost."""

    def spent(tokens: str, price: Column) -> Column:
        return F.col(tokens).cast("decimal(18,0)") * price.cast("decimal(12,6)")

    total = (spent(input_tokens, price_in) + spent(output_tokens, price_out)).cast("decimal(30,6)")
    return total.cast("double") / F.lit(float(S.TOKENS_PER_MILLION))


def price_table(spark: SparkSession, prices: dict[str, tuple[float, float]]) -> DataFrame:
    rows = [(name, *pair) for name, pair in prices.items()]
    return spark.createDataFrame(rows, "name string, price_in double, price_out double")


def prefix_priced(usage: DataFrame, prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Cost by the longest model-id prefix with a price; ``reject_reason`` where there is none."""
    prices = S.PREFIX_PRICES if prices is None else prices
    # Longest first: the first branch that applies is the longest prefix.
    ordered = sorted(prices.items(), key=lambda item: -len(item[0]))
    found = F.coalesce(
        *(
            F.when(F.col("model").startswith(name), F.struct(F.lit(p_in).alias("i"), F.lit(p_out).alias("o")))
            for name, (p_in, p_out) in ordered
        )
    )
    negative = (F.col("input_tokens") < 0) | (F.col("output_tokens") < 0)
    priced = usage.withColumn("_p", found)
    reason = F.when(negative, "negative tokens").when(F.col("_p").isNull(), "no price")
    cost = F.when(reason.isNull(), usage_cost("input_tokens", "output_tokens", F.col("_p.i"), F.col("_p.o")))
    return priced.withColumns({"cost_usd": cost, "reject_reason": reason}).drop("_p")


def completed_usage(usage: DataFrame, prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Fill missing output counts by the floor of length over three, then price by exact model."""
    table = price_table(usage.sparkSession, S.MODEL_PRICES if prices is None else prices)
    guess = F.floor(F.length(F.coalesce("text", F.lit(""))) / S.CHARS_PER_TOKEN)
    filled = usage.withColumns(
        {
            "input_tokens": F.coalesce("input_tokens", F.lit(0)),
            "output_tokens": F.coalesce(F.nullif(F.col("output_tokens"), F.lit(0)), guess),
        }
    )
    joined = filled.join(F.broadcast(table.withColumnRenamed("name", "model")), "model", "left")
    cost = usage_cost("input_tokens", "output_tokens", F.col("price_in"), F.col("price_out"))
    reason = F.when(F.col("price_in").isNull(), "no price")
    return joined.withColumns({"cost_usd": cost, "reject_reason": reason}).drop("price_in", "price_out")


def daily_spend(usage: DataFrame, cap_usd: float) -> DataFrame:
    """usd, calls and what is left of the cap per UTC day."""
    days = usage.groupBy(F.to_date("ts").cast("string").alias("date"))
    totals = days.agg(F.sum("cost_usd").alias("usd"), F.count(F.lit(1)).alias("calls"))
    return totals.withColumn("remaining", F.greatest(F.lit(cap_usd) - F.col("usd"), F.lit(0.0)))


def answer_estimate(prompts: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Cost of each prompt if its answer reaches the token limit."""
    tokens = sum((estimate_tokens(c) for c in ("system", "prompt") if c in prompts.columns), F.lit(0))
    estimated = prompts.withColumn("input_tokens", tokens).withColumn("output_tokens", F.lit(S.ANSWER_MAX_TOKENS))
    return estimated.withColumn(
        "estimated_usd", usage_cost("input_tokens", "output_tokens", F.lit(price_in), F.lit(price_out))
    )


# --- ordered admission ------------------------------------------------------------------------


#: A key that never pauses is read in pieces of about this many requests.
PIECE_ROWS = 1_000_000
_WALKED = ["_key", "_segment", "_piece"]


def _admission_fold(limit: int, window_us: int, carried: bool = False):
    """Verdicts of the requests; with ``carried``, the accepted times that still count where each piece ends."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept, ended = None, deque(), []
        for frame in frames:
            verdicts = []
            for key, segment, piece, at, warm in zip(*(frame[c] for c in (*_WALKED, "_us", "_warm"))):
                if (key, segment, piece) != current:
                    ended += [(*current, t) for t in kept] if carried and current else []
                    current, kept = (key, segment, piece), deque()
                while kept and at - kept[0] >= window_us:
                    kept.popleft()
                admitted = warm or len(kept) < limit
                if admitted:
                    kept.append(at)
                verdicts.append(admitted)
            if not carried:
                frame = frame.assign(accepted=verdicts)
                yield frame.loc[~frame["_warm"], ["event_id", "accepted"]]
        if carried:
            ended += [(*current, t) for t in kept] if current else []
            yield pd.DataFrame(ended, columns=[*_WALKED, "_us"])

    return fold


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_WALKED).sortWithinPartitions(*_WALKED, "_us", "event_id")


def _carried(rows: DataFrame, pieces: int, limit: int, window_us: int) -> list[DataFrame]:
    """The accepted times that count where each further piece of a segment begins, as warm rows of that piece.

    Pieces of one segment are walked one after another, those of all segments together; only their
    times are stored, a folder for each number of piece, and a step reads one folder.
    """
    spark = rows.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/pieces-{uuid.uuid4().hex}"
    rows.repartition(*_WALKED).write.partitionBy("_piece").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    found: list[DataFrame] = []
    for number in range(pieces - 1):
        mine = stored.where(F.col("_piece") == number).select(*rows.columns)
        mine = mine.unionByName(found[-1]) if found else mine
        ended = _in_order(mine).mapInPandas(
            _admission_fold(limit, window_us, carried=True), "_key string, _segment long, _piece long, _us long"
        )
        after = ended.select(
            F.lit(None).cast("long").alias("event_id"), "_key", "_us", "_segment", (F.col("_piece") + 1).alias("_piece"), F.lit(True).alias("_warm")
        )
        found.append(cut_lineage(after))
    return found


def sliding_window_admission(
    requests: DataFrame, limit: int, window_s: int = S.RATE_WINDOW_S, key: str = "user_id", piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """(event_id, accepted): accept while fewer than ``limit`` accepted requests are under a window old.

    The rule is sequential per key, but it forgets: where two neighbouring window-sized slots
    together hold at most ``limit`` requests, the second was accepted whole, so the state after it
    is known. Keys are cut at those points and the segments run in parallel, each warmed up with
    the slot before it.

    A segment of more than ``piece_rows`` requests is cut between slots into pieces of about that
    many. First the state is carried from piece to piece, at most ``limit`` times, by a job for each
    number of piece; then all pieces run in parallel. So a task holds a piece, or a slot if one has more.
    """
    if limit <= 0:
        return requests.select("event_id", F.lit(True).alias("accepted"))
    window_us = window_s * 1_000_000
    timed = requests.select(
        "event_id",
        F.col(key).cast("string").alias("_key"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"),
    ).withColumn("_slot", F.floor(F.col("_us") / window_us))
    # One row per occupied slot of a key, however many requests it holds.
    slots = timed.groupBy("_key", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy("_key").orderBy("_slot")
    last, last_n, before = F.lag("_slot", 1).over(by_key), F.lag("_n", 1).over(by_key), F.lag("_slot", 2).over(by_key)
    before_n = F.when(before == F.col("_slot") - 2, F.lag("_n", 2).over(by_key)).otherwise(0)
    adjacent = last == F.col("_slot") - 1
    starts = last.isNull() | ~adjacent | (last_n + F.coalesce(before_n, F.lit(0)) <= limit)
    slots = slots.withColumn("_starts", starts).withColumn("_warms", F.coalesce(adjacent, F.lit(False)) & starts)
    # cut points numbered along the key: the input is one row per slot, not per request
    slots = slots.withColumn("_segment", F.max(F.when(F.col("_starts"), F.col("_slot"))).over(by_key))
    so_far = F.sum("_n").over(Window.partitionBy("_key", "_segment").orderBy("_slot")) - F.col("_n")
    slots = slots.withColumn("_piece", F.floor(so_far / piece_rows))
    placed = timed.join(slots.select("_key", "_slot", "_segment", "_piece"), ["_key", "_slot"]).withColumn("_warm", F.lit(False))
    warmups = slots.where("_warms").select("_key", (F.col("_slot") - 1).alias("_slot"), "_segment", "_piece")
    warm = timed.join(warmups, ["_key", "_slot"]).withColumn("_warm", F.lit(True))
    columns = ["event_id", "_key", "_us", "_segment", "_piece", "_warm"]
    both = placed.select(*columns).unionByName(warm.select(*columns))
    pieces = 1 if within_rows(requests, piece_rows) else slots.agg(F.max("_piece")).first()[0] + 1
    if pieces > 1:
        long = slots.where("_piece > 0").select("_key", "_segment").distinct()
        walked = both.join(long, ["_key", "_segment"], "left_semi").select(*columns)
        for carried in _carried(walked, pieces, limit, window_us):
            both = both.unionByName(carried)
    return _in_order(both).mapInPandas(_admission_fold(limit, window_us), "event_id long, accepted boolean")


_MONEY = "decimal(38,12)"  # a price has six decimals and a token is a millionth


def _spend_fold(cap: Decimal):
    """Walk the rows of days in order; each row says where its day's walk starts and what it finds held."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        day, usd, calls, held = None, Decimal(0), 0, {}
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                if row.date != day:
                    day, usd, calls, held = row.date, row.start_usd, row.start_calls, {}
                if row.prior is not None:
                    held[row.request_id] = row.prior
                accepted = None
                if row.kind == "reserve":
                    accepted = usd + row.usd < cap
                    if accepted:
                        usd += row.usd
                        held[row.request_id] = row.usd
                elif row.request_id in held:
                    usd = max(Decimal(0), usd - held.pop(row.request_id) + row.usd)
                    calls += 1
                rows.append((row.event_id, accepted, usd, calls))
            yield pd.DataFrame(rows, columns=["event_id", "accepted", "usd", "calls"])

    return fold


def _admitted(events: DataFrame, cap_usd: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is sure (date, ts, event_id, accepted, usd, calls), what was walked (event_id, ...), and the walked rows."""
    cap = F.lit(Decimal(str(cap_usd))).cast(_MONEY)
    kept = F.coalesce(F.col("usd").cast(_MONEY), F.lit(0).cast(_MONEY)).alias("usd")
    dated = events.select(F.to_date("ts").cast("string").alias("date"), "ts", "event_id", "request_id", "kind", kept)
    # As if every reserve were accepted: what each event adds. A request has a handful of events.
    before = Window.partitionBy("date", "request_id").orderBy("ts", "event_id")
    at = F.struct("ts", "event_id")
    previous = F.lag(F.struct("kind", "usd", at.alias("at"))).over(before)
    known = dated.withColumn("_held", F.when((previous["kind"] == "reserve") & F.col("request_id").isNotNull(), previous))
    closes = (F.col("kind") == "settle") & F.col("_held").isNotNull()
    reserve = F.col("kind") == "reserve"
    delta = F.when(reserve, F.col("usd")).when(closes, F.col("usd") - F.col("_held.usd")).otherwise(F.lit(0))
    known = known.withColumns({"delta": delta.cast(_MONEY), "call": closes.cast("long")})
    summed = running_totals(known, ["date"], ["ts", "event_id"], ["delta", "call"])
    summed = summed.withColumns({"cum_delta": F.col("cum_delta").cast(_MONEY), "_at": at})
    # Up to the first reserve that would reach the cap, or the first total that would be below
    # nothing, every reserve is accepted and the running totals are the state.
    ends = (reserve & (F.col("cum_delta") >= cap)) | (F.col("cum_delta") < 0)
    stops = summed.where(ends).groupBy("date").agg(
        F.min("_at").alias("_stop"),
        F.min_by((F.col("cum_delta") - F.col("delta")).cast(_MONEY), F.col("_at")).alias("start_usd"),
        F.min_by(F.col("cum_call") - F.col("call"), F.col("_at")).alias("start_calls"),
    )
    placed = summed.join(F.broadcast(stops), "date", "left")  # a row per day at most
    free = placed.where(F.col("_stop").isNull() | (F.col("_at") < F.col("_stop")))
    sure = free.select("date", "ts", "event_id", F.when(reserve, F.lit(True)).alias("accepted"), F.col("cum_delta").alias("usd"), F.col("cum_call").alias("calls"))
    tail = placed.where(F.col("_at") >= F.col("_stop"))
    prior = F.when(F.col("_held.at") < F.col("_stop"), F.col("_held.usd")).alias("prior")
    ordered = tail.select("date", "ts", "event_id", "request_id", "kind", "usd", prior, "start_usd", "start_calls")
    ordered = ordered.repartition("date").sortWithinPartitions("date", "ts", "event_id")
    walked = ordered.drop("ts").mapInPandas(_spend_fold(Decimal(str(cap_usd))), f"event_id long, accepted boolean, usd {_MONEY}, calls long")
    return sure, walked, tail


def spend_admission(events: DataFrame, cap_usd: float) -> DataFrame:
    """(event_id, accepted, usd, calls) after each reserve or settle, in order within a UTC day.

    ``events`` has event_id, ts, request_id, kind (reserve or settle) and usd; a null amount is
    nothing. A reserve is rejected when held plus estimate reaches the cap; a rejected one holds
    nothing and its settle is ignored. Amounts are added up as decimals.

    Running totals decide all of a day up to where it could first reach the cap, in as many tasks as
    the day has rows for. Only what comes after is one ordered pass, with the open holds as state.
    """
    sure, walked, _ = _admitted(events, cap_usd)
    found = sure.select("event_id", "accepted", "usd", "calls").unionByName(walked)
    return found.withColumn("usd", F.col("usd").cast("double"))


def daily_admission(events: DataFrame, cap_usd: float) -> DataFrame:
    """Per UTC day: accepted and rejected reserves, final usd and settled calls."""
    sure, walked, tail = _admitted(events, cap_usd)
    rest = tail.select("event_id", "date", "ts").join(walked, "event_id").select(*sure.columns)
    last = F.struct("ts", "event_id")
    return sure.unionByName(rest).groupBy("date").agg(
        F.count_if(F.col("accepted")).alias("accepted"),
        F.count_if(~F.col("accepted")).alias("rejected"),
        F.max_by(F.col("usd").cast("double"), last).alias("usd"),
        F.max_by("calls", last).alias("calls"),
    )


# --- attempts ---------------------------------------------------------------------------------


def error_kind(status) -> Column:
    """Failure class of an HTTP status: 429 and 5xx are worth another try, other codes are ours."""
    status = F.col(status)
    return (
        F.when(status.isNull(), "server").when(status == 429, "rate_limit").when(status >= 500, "server").otherwise("fatal")
    )


def classify_attempts(attempts: DataFrame) -> DataFrame:
    """Failed attempts get kind, retryable and fails_over; successful ones keep NULLs."""
    kind = F.when(~F.col("ok"), error_kind("status"))
    tagged = attempts.withColumn("kind", kind)
    return tagged.withColumns(
        {"retryable": F.col("kind").isin("rate_limit", "server"), "fails_over": F.col("kind") != "fatal"}
    )


def failover_chains(attempts: DataFrame) -> DataFrame:
    """Per request: the (provider, reason) chain, who served it, and whether that was a failover.

    A request has at most a handful of attempts, so its chain is a bounded list.
    """
    tagged = classify_attempts(attempts)
    failed = F.when(~F.col("ok"), F.struct("attempt", F.concat_ws(":", "provider", "kind").alias("step")))
    grouped = tagged.groupBy("request_id").agg(
        F.array_sort(F.collect_list(failed)).alias("_chain"),
        F.min_by(F.col("provider"), F.col("attempt")).alias("first_provider"),
        F.max(F.when(F.col("ok"), F.col("provider"))).alias("served_by"),
    )
    chain = F.array_join(F.transform("_chain", lambda c: c.step), " > ")
    over = F.coalesce(F.col("served_by") != F.col("first_provider"), F.lit(False))
    return grouped.select("request_id", chain.alias("chain"), "first_provider", "served_by", over.alias("failed_over"))
