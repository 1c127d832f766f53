"""Push ingestion as a stream.

Every micro-batch appends to its own folder, named by the batch id and overwritten when the batch is
replayed, so a retried batch changes nothing. The current chunk table is the last writer per id;
:func:`compact` folds the batches that came since the last time into a new version of it.

A batch that fails is written to the attempt log, one row per message, before the failure stops
the stream. When it has failed as often as a message may be delivered, it is cut in halves to find the
messages that make it fail: those become dead letters, the others are ingested, and the stream goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from daftar import settings as S
from daftar.operators.chunking import chunk_documents
from daftar.operators.embedding import backfill
from daftar.sources.messages import decode_push
from daftar.sources.tables import TEXT_COLUMNS, last_writer, read_version, upsert, write_version

_VECTORS = tuple(S.EMBEDDING_COLUMNS.values())
CHUNKS = (
    "id string, doc_id string, article string, seq int, text string, text_normalized string, "
    + "".join(f"{c} array<float>, " for c in _VECTORS)
    + "received_at timestamp, batch_id long"
)
REJECTS = "message_id string, body string, reject_reason string, received_at timestamp, batch_id long"
ATTEMPTS = "message_id string, error string, received_at timestamp, batch_id long, attempt int"
LETTERS = "message_id string, body string, attempts int, error string, received_at timestamp, batch_id long"

# Maps (id, text) to (id, embedding); one for each model whose column is filled on arrival.
Embedders = Mapping[str, Callable[[DataFrame], DataFrame]]


def ingest_batch(batch: DataFrame, batch_id: int, root: str, embedders: Embedders | None = None, **chunking) -> None:
    """One micro-batch of (body, received_at): good documents become chunks, bad ones rejects.

    ``embedders`` fill the vector columns of their models; other models' columns stay NULL for
    the backfill job. A bad message is recorded and done with; an exception here fails the batch.
    """
    batch = batch.withColumn("_body", F.col("body"))
    decoded = decode_push(batch, "body").withColumnRenamed("_body", "body")
    decoded = decoded.persist()
    try:
        rejects = decoded.where(F.col("reject_reason").isNotNull())
        rejects = rejects.select("message_id", "body", "reject_reason", "received_at")
        rejects.write.mode("overwrite").parquet(f"{root}/rejects/batch_id={batch_id}")
        good = decoded.where(F.col("reject_reason").isNull())
        # the same document twice in one batch: the later delivery wins
        latest = last_writer(good.select("doc_id", "text", "received_at", "message_id"), ["doc_id"], ["received_at", "message_id"])
        chunks = chunk_documents(latest, **chunking).join(latest.select("doc_id", "received_at"), "doc_id")
        chunks = chunks.select("id", *TEXT_COLUMNS, *(F.lit(None).cast("array<float>").alias(c) for c in _VECTORS), "received_at")
        for model_key, embed in (embedders or {}).items():
            chunks = backfill(chunks, model_key, embed)
        chunks.write.mode("overwrite").parquet(f"{root}/chunks/batch_id={batch_id}")
    finally:
        decoded.unpersist()


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _failed(spark: SparkSession, root: str, batch_id: int) -> int:
    """How often a batch is known to have failed: its complete attempts."""
    fs, path = _folder(spark, f"{root}/attempts/batch_id={batch_id}")
    if not fs.exists(path):
        return 0
    return sum(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")) for s in fs.listStatus(path))


def _named(batch: DataFrame) -> DataFrame:
    """(message_id, body, received_at); a body without an id is named by its hash."""
    decoded = decode_push(batch.withColumn("_body", F.col("body")), "body").withColumnRenamed("_body", "body")
    name = F.when(F.col("message_id") != "", F.col("message_id")).otherwise(F.concat(F.lit("sha256:"), F.sha2("body", 256)))
    return decoded.select(name.alias("message_id"), "body", "received_at")


def _poison(batch: DataFrame, attempt: Callable[[DataFrame], None], trials: int) -> tuple[DataFrame | None, DataFrame]:
    """(messages that pass, messages that fail), found by halving what fails, at most ``trials`` times.

    Halves are cut by a hash of the message, so they are the same whenever they are computed. What
    still fails when the trials are used up fails together.
    """
    mark = F.xxhash64("body")
    good, bad, open_ = [], [], [(batch, 0)]
    while open_:
        part, depth = open_.pop(0)
        if depth == 64 or trials < 2:
            bad.append(part)
            continue
        for half in (0, 1):
            mine = part.where(F.shiftrightunsigned(mark, depth).bitwiseAND(F.lit(1).cast("long")) == half)
            size = mine.select("body").distinct().limit(2).count()
            if not size:
                continue
            trials -= 1
            try:
                attempt(mine)
                good.append(mine)
            except Exception:  # noqa: BLE001 - whatever makes a message fail makes it a dead letter
                if size == 1:
                    bad.append(mine)
                else:
                    open_.append((mine, depth + 1))
    union = lambda parts: parts[0].unionByName(union(parts[1:])) if len(parts) > 1 else parts[0]
    return (union(good) if good else None), (union(bad) if bad else batch.limit(0))


def deliver(
    batch: DataFrame, batch_id: int, root: str, handle: Callable[[DataFrame, int, str], None],
    most: int = S.MAX_DELIVERY_ATTEMPTS, trials: int = 64,
) -> None:
    """Hand a micro-batch to ``handle``; record a failure, and set its messages apart once it has failed ``most`` times.

    The attempt is written before the exception leaves, so a restarted stream counts on from it.
    ``trials`` bounds the jobs that look for the messages at fault.
    """
    spark = batch.sparkSession
    try:
        handle(batch, batch_id, root)
        return
    except Exception as failure:  # noqa: BLE001 - the log keeps what it was
        error, cause = f"{type(failure).__name__}: {failure}".splitlines()[0][:500], failure
    attempt = _failed(spark, root, batch_id) + 1
    named = _named(batch)
    log = named.select("message_id", F.lit(error).alias("error"), "received_at").distinct()
    log.write.mode("overwrite").parquet(f"{root}/attempts/batch_id={batch_id}/attempt={attempt}")
    if attempt < most:
        raise cause
    good, bad = _poison(batch, lambda part: handle(part, batch_id, f"{root}/trial"), trials)
    handle(batch.limit(0) if good is None else good, batch_id, root)
    letters = _named(bad).select("message_id", "body", F.lit(attempt).alias("attempts"), F.lit(error).alias("error"), "received_at")
    letters.write.mode("overwrite").parquet(f"{root}/letters/batch_id={batch_id}")


def start_ingestion(
    messages: DataFrame, root: str, checkpoint: str, embedders: Embedders | None = None,
    handle: Callable[[DataFrame, int, str], None] | None = None, **chunking,
) -> StreamingQuery:
    """Run the stream over what has arrived; call again with the same checkpoint to go on.

    A batch that fails stops the stream and is delivered again by the next call; see :func:`deliver`.
    """
    work = handle or (lambda batch, n, where: ingest_batch(batch, n, where, embedders, **chunking))
    return (
        messages.writeStream.foreachBatch(lambda batch, n: deliver(batch, n, root, work))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def pending_chunks(spark: SparkSession, root: str, after: int = -1) -> DataFrame:
    """Last writer per chunk id over the batches after ``after``; ``created_at`` is when the id first appeared there."""
    rows = spark.read.schema(CHUNKS).parquet(f"{root}/chunks").where(F.col("batch_id") > after)
    newest = last_writer(rows, ["id"], ["batch_id", "received_at"])
    first = rows.groupBy("id").agg(F.min("received_at").alias("created_at"))
    return newest.join(first, "id").select("id", *TEXT_COLUMNS, *_VECTORS, "created_at")


def _folded(spark: SparkSession, table: str) -> int:
    """The last batch that the newest version of ``table`` holds."""
    fs, path = _folder(spark, f"{table}/folded")
    return spark.read.schema("last long").json(f"{table}/folded").agg(F.max("last")).first()[0] if fs.exists(path) else -1


def compact(spark: SparkSession, root: str, table: str) -> int:
    """Upsert the batches that no version of ``table`` holds yet into a new version of it.

    Only their folders are read. The mark that they are folded is written after the version, so a
    job that dies between the two folds them again, which changes nothing.
    """
    fs, path = _folder(spark, f"{root}/chunks")
    last = max(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if "=" in s.getPath().getName())
    incoming = pending_chunks(spark, root, _folded(spark, table))
    try:
        merged = upsert(read_version(spark, table), incoming, TEXT_COLUMNS + _VECTORS)
    except ValueError:
        merged = incoming
    version = write_version(merged, table)
    spark.createDataFrame([(last,)], "last long").coalesce(1).write.mode("append").json(f"{table}/folded")
    return version


def rejected(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(REJECTS).parquet(f"{root}/rejects")


def attempts(spark: SparkSession, root: str) -> DataFrame:
    """The attempt log: a row for each message of each failed delivery."""
    return spark.read.schema(ATTEMPTS).parquet(f"{root}/attempts")


def letters(spark: SparkSession, root: str) -> DataFrame:
    """Messages set apart by the stream, with their bodies, so that they can be sent again."""
    return spark.read.schema(LETTERS).parquet(f"{root}/letters")


def dead_letters(failures: DataFrame, attempts: int = S.MAX_DELIVERY_ATTEMPTS) -> DataFrame:
    """(message_id, attempts, last_at) of messages that failed too often; ``failures`` has one row per try."""
    grouped = failures.groupBy("message_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.max("received_at").alias("last_at")
    )
    return grouped.where(F.col("attempts") >= attempts)


def retained(letters: DataFrame, now: str, days: int = S.DEAD_LETTER_DAYS) -> DataFrame:
    return letters.where(F.col("last_at") > F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))
