"""Stateful admission on a stream: a sliding-window limit per key and a spend cap per day.

State lives in RocksDB and is forgotten by event-time timers: while a source stalls the watermark
stands still and nothing is forgotten. The time column itself does not reach the operator, so rows
behind the watermark are not dropped and still get a verdict.

The rows of one key and micro-batch are read as a stream of frames. A key with several frames is
sorted outside memory: each frame becomes a sorted run of small blocks in the state store, and the
runs are merged block by block, so a hot key holds one block per run and no more.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from decimal import Decimal
from itertools import chain, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from daftar import settings as S

_DAY_MS = 24 * 3600 * 1000
_MONEY = "decimal(38,12)"
_BLOCK, _FRAME, _CACHED = 256, 4096, 50_000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need a state store that can hold several named states."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


class _Ordered(StatefulProcessor):
    """Reads the rows of one key in the order of their first two columns."""

    columns: dict[str, str]  # name to type, in order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        arrays = ", ".join(f"{name} array<{kind}>" for name, kind in self.columns.items())
        self.spool = handle.getMapState("spool", "run int, block int", arrays)

    def in_order(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        names = list(self.columns)
        first, second = next(frames, None), next(frames, None)

        def rows(frame: pd.DataFrame) -> list[tuple]:
            return list(frame[names].sort_values(names[:2], kind="stable").itertuples(index=False, name=None))

        if second is None:
            yield from rows(first) if first is not None else ()
            return
        sizes = []
        for run, frame in enumerate(chain([first, second], frames)):
            ordered = rows(frame)
            for block, at in enumerate(range(0, len(ordered), _BLOCK)):
                self.spool.updateValue((run, block), tuple(list(c) for c in zip(*ordered[at : at + _BLOCK], strict=True)))
            sizes.append(-(-len(ordered) // _BLOCK))

        def blocks(run: int) -> Iterator[tuple]:
            for block in range(sizes[run]):
                values = self.spool.getValue((run, block))
                self.spool.removeKey((run, block))
                yield from zip(*values, strict=True)

        yield from heapq.merge(*(blocks(run) for run in range(len(sizes))), key=lambda row: row[:2])


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    while part := list(islice(rows, _FRAME)):
        yield pd.DataFrame(part, columns=columns)


class _RateLimit(_Ordered):
    columns = {"us": "bigint", "event_id": "bigint"}

    def __init__(self, limit: int, window_us: int) -> None:
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.times = handle.getListState("times", "us bigint")  # accepted and not yet a window old
        self.timer = handle.getValueState("timer", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [row[0] for row in self.times.get()] if self.times.exists() else []

        def verdicts() -> Iterator[tuple]:
            nonlocal kept
            for us, event_id in self.in_order(rows):
                kept = [t for t in kept if us - t < self.window_us]
                accepted = self.limit <= 0 or len(kept) < self.limit
                if accepted and self.limit > 0:
                    kept.append(us)
                yield key[0], event_id, accepted

        yield from _frames(verdicts(), ["key", "event_id", "accepted"])
        if not kept:
            return
        self.times.put([(us,) for us in kept])
        due = (max(kept) + self.window_us) // 1000 + 1
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(due)
        self.timer.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        self.timer.clear()
        yield from ()

    def close(self) -> None:
        pass


def rate_limited(
    requests: DataFrame, limit: int, window_s: int = S.RATE_WINDOW_S, key: str = "user_id", lateness: str = "1 minute"
) -> DataFrame:
    """(key, event_id, accepted) for a stream of (key, event_id, ts).

    The state of a key is its accepted times inside the window, at most ``limit`` of them. A key
    is forgotten when the watermark, ``lateness`` behind the newest event, has passed its last
    window; that is what keeps the state from growing with the keys seen.
    """
    use_rocksdb(requests.sparkSession)
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    keyed = timed.select(F.col(key).cast("string").alias("key"), "event_id", F.unix_micros("ts").alias("us"))
    return keyed.groupBy("key").transformWithStateInPandas(
        _RateLimit(limit, window_s * 1_000_000), "key string, event_id long, accepted boolean", "Append", "EventTime"
    )


class _SpendCap(_Ordered):
    columns = {"us": "bigint", "event_id": "bigint", "request": "string", "kind": "string", "usd": _MONEY}

    def __init__(self, cap: Decimal) -> None:
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.total = handle.getValueState("total", f"usd {_MONEY}, calls bigint")
        self.held = handle.getMapState("held", "request string", f"usd {_MONEY}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        usd, calls = self.total.get() if self.total.exists() else (Decimal(0), 0)
        touched: dict[str, Decimal | None] = {}  # a bounded part of the open holds; None is closed

        def store() -> None:
            for request, amount in touched.items():
                if amount is not None:
                    self.held.updateValue((request,), (amount,))
                elif self.held.containsKey((request,)):
                    self.held.removeKey((request,))
            touched.clear()

        def verdicts() -> Iterator[tuple]:
            nonlocal usd, calls
            for _, event_id, request, kind, amount in self.in_order(rows):
                accepted = None
                if len(touched) >= _CACHED:
                    store()
                if kind == "reserve":
                    accepted = usd + amount < self.cap
                    if accepted:
                        usd += amount
                        if request:
                            touched[request] = amount
                elif request:
                    if request not in touched:
                        touched[request] = self.held.getValue((request,))[0] if self.held.containsKey((request,)) else None
                    if touched[request] is not None:
                        usd = max(Decimal(0), usd - touched[request] + amount)
                        touched[request] = None
                        calls += 1
                yield key[0], event_id, accepted, float(usd), calls

        yield from _frames(verdicts(), ["date", "event_id", "accepted", "usd", "calls"])
        store()
        self.total.update((usd, calls))
        self.handle.registerTimer(int(pd.Timestamp(key[0]).value // 1_000_000) + 2 * _DAY_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.total.clear()
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def spend_capped(events: DataFrame, cap_usd: float, lateness: str = "1 minute") -> DataFrame:
    """(date, event_id, accepted, usd, calls) for a stream of reserves and settles.

    State per UTC day: the running total, the settled calls and the open holds. A day's state is
    dropped when the watermark is a day past its end. Amounts are added up as decimals; a null
    amount is nothing, and a row without a request id holds and settles nothing.
    """
    use_rocksdb(events.sparkSession)
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    keyed = timed.select(
        F.to_date("ts").cast("string").alias("date"), "event_id", F.coalesce(F.col("request_id").cast("string"), F.lit("")).alias("request"), "kind",
        F.coalesce(F.col("usd").cast(_MONEY), F.lit(0).cast(_MONEY)).alias("usd"), F.unix_micros("ts").alias("us"),
    )
    return keyed.groupBy("date").transformWithStateInPandas(
        _SpendCap(Decimal(str(cap_usd))), "date string, event_id long, accepted boolean, usd double, calls long", "Append", "EventTime"
    )
