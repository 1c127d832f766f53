"""What the operators of this package share: stored intermediate tables, word patterns, batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(column: Column | str) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


class Scratch:
    """A folder of Parquet tables below the shared checkpoint folder, one per call of an operator.

    A stored table cuts the lineage: it is read again instead of being computed again, and it
    survives lost executors. Tables that a later round replaces are removed at once; the rest
    belongs to the result, which reads them, and goes when the cluster clears its checkpoint folder.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


KEPT: dict = {}  # what a worker keeps from task to task, by call; each has a close()


def let_go() -> None:
    """Close what an earlier call left in this worker, and give back what Arrow keeps: the memory is wanted for other tasks."""
    for old in KEPT.values():
        old.close()
    KEPT.clear()
    pa.default_memory_pool().release_unused()


def over_rows(df: DataFrame, columns: list[str], convert, schema: str) -> DataFrame:
    """``convert(list, list, ...) -> pyarrow arrays`` over bounded batches of the named columns.

    ``convert`` gets one Python list for each column and returns one array for each field of
    ``schema``. Only the named columns are read, so further columns can have any name.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from daftar.llm.common import let_go  # the worker's own module, which outlives the task

        let_go()
        for part in parts:
            for piece in slices(part):
                yield convert(*(column.to_pylist() for column in piece.columns))

    return df.select(*columns).mapInArrow(batches, schema)


def slices(part: pa.RecordBatch, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about ``most_bytes``; one longer row makes a piece of its own."""
    pieces = max(1, min(part.num_rows, -(-part.nbytes // most_bytes)))
    rows = -(-part.num_rows // pieces) if part.num_rows else 0
    for at in range(0, part.num_rows, max(1, rows)):
        yield part.slice(at, rows)


def local_folder(name: str) -> str:
    """A folder of the executor's own for what only this task reads."""
    import tempfile

    return tempfile.mkdtemp(prefix=f"{name}-", dir=os.environ.get("TMPDIR"))
