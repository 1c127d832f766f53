"""Streams run over what has arrived, are restarted from their checkpoint, and agree with the batch."""

import base64
import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from daftar import settings as S
from daftar.operators import embedding as E
from daftar.operators import ledger as G
from daftar.streaming import admission, ingestion, metrics

SF = "/root/testdata/sf0.001"


def push(message_id, document):
    data = base64.b64encode(json.dumps(document).encode()).decode()
    return json.dumps({"message": {"data": data, "messageId": message_id}, "subscription": "s"})


def doc(doc_id, text):
    return {"doc_id": doc_id, "title": "t", "text": text}


def land(spark, folder, rows):
    shape = "body string, received_at timestamp"
    frame = spark.createDataFrame(rows, "body string, at string")
    frame.select("body", F.col("at").cast("timestamp").alias("received_at")).coalesce(1).write.mode("append").parquet(folder)
    return shape


def test_ingestion_is_idempotent_and_restartable(spark, tmp_path):
    inbox, root, table, checkpoint = (str(tmp_path / n) for n in ("inbox", "root", "table", "checkpoint"))
    first = [
        (push("m1", doc("a", "one two")), "2024-01-01 00:00:00"),
        (push("m1", doc("a", "one two")), "2024-01-01 00:00:00"),  # delivered twice
        (push("m2", doc("b", "old text")), "2024-01-01 00:00:01"),
        (push("m3", doc("b", "new text")), "2024-01-01 00:00:02"),
        ("not json", "2024-01-01 00:00:03"),
        (push("m4", doc("c:1", "x")), "2024-01-01 00:00:04"),
    ]
    shape = land(spark, inbox, first)
    ingestion.start_ingestion(spark.readStream.schema(shape).parquet(inbox), root, checkpoint).awaitTermination()
    rows = {r.id: r.text for r in ingestion.pending_chunks(spark, root).collect()}
    assert rows == {"a:p:0": "one two", "b:p:0": "new text"}
    reasons = sorted(r.reject_reason for r in ingestion.rejected(spark, root).collect())
    assert reasons == ["doc_id: colon", "push body is not JSON"]

    ingestion.compact(spark, root, table)
    land(spark, inbox, [(push("m5", doc("a", "edited")), "2024-01-02 00:00:00")])
    ingestion.start_ingestion(spark.readStream.schema(shape).parquet(inbox), root, checkpoint).awaitTermination()
    assert ingestion.compact(spark, root, table) == 2
    current = {r.id: (r.text, str(r.created_at)) for r in ingestion.read_version(spark, table).collect()}
    assert current["a:p:0"] == ("edited", "2024-01-01 00:00:00")  # updated in place, creation time kept
    assert ingestion.read_version(spark, table, 1).count() == 2

    # replaying a batch changes nothing
    batch = spark.read.schema(shape).parquet(inbox)
    before = ingestion.pending_chunks(spark, root).count()
    ingestion.ingest_batch(batch, 99, root)
    ingestion.ingest_batch(batch, 99, root)
    assert ingestion.pending_chunks(spark, root).count() == before


def test_dead_letters(spark):
    rows = [("m1", "2024-01-01 00:00:00")] * 5 + [("m2", "2024-01-09 00:00:00")] * 6 + [("m3", "2024-01-09 00:00:00")]
    failures = spark.createDataFrame(rows, "message_id string, at string").withColumn("received_at", F.col("at").cast("timestamp"))
    letters = ingestion.dead_letters(failures)
    assert sorted(r.message_id for r in letters.collect()) == ["m1", "m2"]
    assert [r.message_id for r in ingestion.retained(letters, "2024-01-10 00:00:00").collect()] == ["m2"]


def _stream(spark, tmp_path, frame, name):
    folder = str(tmp_path / name)
    frame.coalesce(1).write.parquet(folder)
    return spark.readStream.schema(frame.schema).parquet(folder)


def _drain(query_frame, spark, tmp_path, name, mode="append"):
    query = (
        query_frame.writeStream.outputMode(mode).format("memory").queryName(name)
        .option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.table(name)


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "ts")
    live = _drain(admission.rate_limited(_stream(spark, tmp_path, events, "requests"), 2, 6 * 3600), spark, tmp_path, "limited")
    batch = G.sliding_window_admission(events, 2, 6 * 3600)
    assert {(r.event_id, r.accepted) for r in live.collect()} == {(r.event_id, r.accepted) for r in batch.collect()}


def test_spend_cap_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    holds = events.select("event_id", "ts", F.col("event_id").alias("request_id"), F.lit("reserve").alias("kind"), F.col("value").alias("usd"))
    live = _drain(admission.spend_capped(_stream(spark, tmp_path, holds, "holds"), 300.0), spark, tmp_path, "capped")
    batch = G.spend_admission(holds, 300.0)
    got = {(r.event_id, r.accepted, round(r.usd, 6)) for r in live.collect()}
    assert got == {(r.event_id, r.accepted, round(r.usd, 6)) for r in batch.collect()}


def test_windowed_metrics_stream(spark, tmp_path):
    events = metrics.with_event_time(spark.read.parquet(f"{SF}/events.parquet")).select("ts", "event_type", "value")
    stream = _stream(spark, tmp_path, events, "events")
    live = _drain(metrics.windowed(stream, ["event_type"], "value", "1 hour"), spark, tmp_path, "windows", "update")
    batch = metrics.windowed(events, ["event_type"], "value", "1 hour", watermark=None)
    assert live.select("window", "event_type", "n").exceptAll(batch.select("window", "event_type", "n")).count() == 0
    assert live.count() == batch.count()


def _run(frame, checkpoint, out):
    """One run over what has arrived, from the checkpoint, into a folder."""
    query = (
        frame.writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _held(spark, checkpoint, name, mapped=False):
    reader = spark.read.format("statestore").option("stateVarName", name)
    return reader.load(checkpoint).count()


def test_state_outlives_a_stalled_source_and_goes_with_the_watermark(spark, tmp_path):
    inbox, checkpoint, out = (str(tmp_path / n) for n in ("inbox", "checkpoint", "out"))
    shape = "event_id long, user_id long, ts timestamp"

    def land(rows):
        frame = spark.createDataFrame(rows, "event_id long, user_id long, at string")
        frame.select("event_id", "user_id", F.col("at").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(inbox)
        _run(admission.rate_limited(spark.readStream.schema(shape).parquet(inbox), 1, 3600), checkpoint, out)

    land([(1, 7, "2024-01-01 00:00:00"), (2, 8, "2024-01-01 00:10:00")])
    assert _held(spark, checkpoint, "times") == 2
    land([(3, 7, "2024-01-01 00:20:00")])  # the clock has not passed the window: the first request still counts
    assert _held(spark, checkpoint, "times") == 2
    land([(4, 9, "2024-01-01 05:00:00")])  # now it has
    assert _held(spark, checkpoint, "times") == 1
    land([(5, 7, "2024-01-01 00:30:00")])  # behind the watermark, and judged all the same
    found = {r.event_id: r.accepted for r in spark.read.parquet(out).collect()}
    assert found == {1: True, 2: True, 3: False, 4: True, 5: True}


def test_hot_day_is_sorted_outside_memory(spark, tmp_path):
    """One key with many frames out of order: batch and stream agree, and the spool is empty after."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        rows = spark.range(6000).select(
            F.col("id").alias("event_id"), (F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("id") * 7919) % 6000)).alias("ts"),
            F.floor(F.col("id") / 2).alias("request_id"), F.when(F.col("id") % 2 == 0, "reserve").otherwise("settle").alias("kind"),
            F.when(F.col("id") % 2 == 0, F.lit(0.7)).otherwise(0.35).alias("usd"),
        )
        checkpoint, out = str(tmp_path / "checkpoint"), str(tmp_path / "out")
        _run(admission.spend_capped(_stream(spark, tmp_path, rows, "hot"), 400.0), checkpoint, out)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    got = {tuple(r) for r in spark.read.parquet(out).selectExpr("event_id", "accepted", "round(usd, 6)", "calls").collect()}
    want = {tuple(r) for r in G.spend_admission(rows, 400.0).selectExpr("event_id", "accepted", "round(usd, 6)", "calls").collect()}
    assert got == want and any(r[1] is False for r in got)
    assert _held(spark, checkpoint, "spool") == 0


def test_poison_is_set_apart_after_five_attempts(spark, tmp_path):
    inbox, root, checkpoint = (str(tmp_path / n) for n in ("inbox", "root", "checkpoint"))
    shape = land(spark, inbox, [(push(f"m{i}", doc(f"d{i}", "boom" if i == 3 else f"text {i}")), f"2024-01-01 00:00:0{i}") for i in range(8)])

    def handle(batch, number, where):
        text = F.unbase64(F.get_json_object("body", "$.message.data")).cast("string")
        if batch.where(text.contains("boom")).count():
            raise RuntimeError("cannot store boom")
        ingestion.ingest_batch(batch, number, where)

    def go():
        stream = spark.readStream.schema(shape).parquet(inbox)
        ingestion.start_ingestion(stream, root, checkpoint, handle=handle).awaitTermination()

    for attempt in range(1, 5):
        with pytest.raises(Exception, match="cannot store boom"):
            go()
        assert ingestion.attempts(spark, root).agg(F.max("attempt")).first()[0] == attempt
    go()  # the fifth failure sets the message apart
    letters = ingestion.letters(spark, root).collect()
    assert [(r.message_id, r.attempts) for r in letters] == [("m3", 5)] and "boom" in letters[0].error
    assert sorted(r.doc_id for r in ingestion.pending_chunks(spark, root).collect()) == [f"d{i}" for i in range(8) if i != 3]
    # failures by message, as the log has them: every message of the batch was tried five times
    assert ingestion.dead_letters(ingestion.attempts(spark, root)).count() == 8
    land(spark, inbox, [(push("n1", doc("later", "fine")), "2024-01-02 00:00:00")])
    go()
    assert "later" in {r.doc_id for r in ingestion.pending_chunks(spark, root).collect()}


def test_when_everything_fails_everything_is_set_apart(spark, tmp_path):
    root = str(tmp_path / "root")
    rows = [(push(f"m{i}", doc(f"d{i}", f"text {i}")), "2024-01-01 00:00:00") for i in range(40)]
    batch = spark.createDataFrame(rows, "body string, at string").select("body", F.col("at").cast("timestamp").alias("received_at"))
    jobs = []

    def handle(part, number, where):
        jobs.append(1)
        if part.count():
            raise RuntimeError("storage is gone")

    for _ in range(4):
        with pytest.raises(RuntimeError):
            ingestion.deliver(batch, 5, root, handle)
    ingestion.deliver(batch, 5, root, handle, trials=10)
    assert ingestion.letters(spark, root).count() == 40 and len(jobs) <= 5 + 12


def test_embedding_on_arrival_and_compaction_of_new_batches_only(spark, tmp_path):
    root, table = str(tmp_path / "root"), str(tmp_path / "table")

    def batch(*documents):
        rows = [(push(f"m{d['doc_id']}", d), "2024-01-01 00:00:00") for d in documents]
        return spark.createDataFrame(rows, "body string, at string").select("body", F.col("at").cast("timestamp").alias("received_at"))

    embed = {"e5": lambda texts: E.apply_embedder(texts, lambda: lambda some: np.array([[len(t)] * 1024 for t in some]), 1024)}
    ingestion.ingest_batch(batch(doc("a", "one"), doc("b", "two words")), 0, root, embed)
    assert ingestion.compact(spark, root, table) == 1
    first = {r.doc_id: r for r in ingestion.read_version(spark, table).collect()}
    column = S.EMBEDDING_COLUMNS["e5"]
    assert first["a"][column][0] == len("passage: one") and first["a"][S.EMBEDDING_COLUMNS["bge"]] is None

    ingestion.ingest_batch(batch(doc("b", "changed"), doc("c", "new")), 1, root, embed)
    shutil.rmtree(f"{root}/chunks/batch_id=0")  # folded already: not read again
    assert ingestion.compact(spark, root, table) == 2
    second = {r.doc_id: r for r in ingestion.read_version(spark, table).collect()}
    assert set(second) == {"a", "b", "c"} and second["b"].text == "changed" and second["b"][column][0] == len("passage: changed")
    assert second["a"][column] == first["a"][column]
    with pytest.raises(Exception, match="expected"):
        ingestion.ingest_batch(batch(doc("z", "x")), 2, root, {"e5": lambda t: E.apply_embedder(t, lambda: lambda some: np.zeros((len(some), 3)), 1024)})
