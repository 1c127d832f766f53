"""Keyed upserts over Parquet, and tables written as immutable versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_COLUMNS = ("doc_id", "article", "seq", "text", "text_normalized")


def last_writer(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the latest by ``order``; copies combine before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*rows.columns)


def upsert(target: DataFrame, source: DataFrame, columns: Sequence[str] = TEXT_COLUMNS, key: str = "id") -> DataFrame:
    """Insert new keys and update ``columns`` of known ones; every other column keeps its value.

    One full outer join on the key. Rows the source no longer has stay, see :func:`prune`.
    """
    incoming = source.select(key, F.lit(True).alias("_in"), *(F.col(c).alias(f"_s_{c}") for c in source.columns if c != key))
    joined = target.join(incoming, key, "full")

    def value(name: str):
        if name == key:
            return F.col(key)
        if name not in source.columns:
            return F.col(name)
        fresh = F.col(f"_s_{name}")
        if name in columns:
            return F.when(F.col("_in"), fresh).otherwise(F.col(name)).alias(name)
        return F.coalesce(F.col(name), fresh).alias(name)  # insert-only, such as created_at

    return joined.select(*(value(c) for c in target.columns))


def prune(target: DataFrame, source: DataFrame, key: str = "id", document: str = "doc_id") -> DataFrame:
    """Drop rows of re-ingested documents that the new text no longer produces."""
    touched = source.select(document).distinct()
    untouched = target.join(touched, document, "left_anti")
    return untouched.unionByName(target.join(source.select(key), key, "left_semi"))


def _versions(spark: SparkSession, root: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    done = [p for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done if p.getName().startswith("version="))


def write_version(df: DataFrame, root: str, partition_by: Sequence[str] = ()) -> int:
    """Write a new version next to the old ones; readers switch when its success marker appears."""
    version = (_versions(df.sparkSession, root) or [0])[-1] + 1
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/version={version}")
    return version


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The latest complete version, or a named one."""
    known = _versions(spark, root)
    if not known:
        raise ValueError(f"no complete version under {root}")
    return spark.read.parquet(f"{root}/version={known[-1] if version is None else version}")
