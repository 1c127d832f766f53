"""Session helpers shared by tests and the benchmark; a cluster brings its own session."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "20g", partitions: int = 8) -> SparkSession:
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("daftar")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.local.dir", scratch)
        .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, unlike a local one."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


_tables: dict[tuple[str, str], str] = {}


def _state(spark: SparkSession, path: str) -> str:
    """When what a path holds was last changed: the newest of its files."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    return f"{len(files)}-{max((f.getModificationTime() for f in files), default=0)}"


def stored_path(spark: SparkSession, name: str, source: str, write) -> str:
    """The folder that ``write(folder)`` filled, once per application, with what is derived from ``source``.

    It lies in the shared checkpoint folder. Changed source files make a new one.
    """
    key = (spark.sparkContext.applicationId, f"{name} {source} {_state(spark, source)}")
    if key not in _tables:
        path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        write(path)
        _tables[key] = path
    return _tables[key]


def stored(df: DataFrame, name: str, source: str, **options: str) -> DataFrame:
    """A table derived from the files at ``source``, written once per application and read from there on.

    Plans over it start from a scan that prunes columns and takes filters, and survive lost executors.
    ``options`` go to the writer.
    """
    path = stored_path(df.sparkSession, name, source, df.write.options(**options).parquet)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def within_rows(df: DataFrame, bound: int) -> bool:
    """True when the table has at most ``bound`` rows; reads no more than bound + 1 of them."""
    return df.limit(bound + 1).count() <= bound


def spread(df: DataFrame) -> DataFrame:
    """Widen a scan that has fewer splits than there are cores; a large table is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows go to Python in batches of at most this size: Spark's own bound is sixteen times that, and an executor
#: holds a batch of each running task twice, outside its heap and in the worker.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of a session whose settings do not name a bound."""
    if not spark.sparkContext.getConf().contains(_BATCHES):
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers once per application, wherever they and the driver were started.

    Every session that comes here gets :func:`bounded_batches`.
    """
    bounded_batches(spark)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(), "daftar"), "zip", os.path.dirname(package), os.path.basename(package)
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
