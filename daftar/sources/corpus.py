"""Manifests and text corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.functions import text as T

SECTION = "struct<anchor:string,label:string,first_article:int,last_article:int,preamble:boolean>"
DOCUMENT = (
    "struct<doc_id:string,title:string,source_url:string,license:string,"
    f"start_marker:string,end_marker:string,sections:array<{SECTION}>>"
)
REQUIRED = ("doc_id", "title", "license")


def fail_when(df: DataFrame, broken: Column, message: Column) -> DataFrame:
    """Let rows through unchanged, failing the job on the first broken one."""
    checked = F.when(broken, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return df.where(checked)


def manifest_documents(text: Column) -> Column:
    """Documents of a manifest given as an object with ``documents`` or as a bare list."""
    listed = F.from_json(text, f"array<{DOCUMENT}>")
    wrapped = F.from_json(text, f"documents array<{DOCUMENT}>").documents
    return F.when(T.strip(text).startswith("["), listed).otherwise(wrapped)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per document; a missing required field or an empty manifest fails the job."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode_outer(manifest_documents(F.col("value"))).alias("d"))
    rows = fail_when(rows, F.col("d").isNull(), F.lit("manifest has no documents")).select("d.*")
    missing = F.lit(False)
    for name in REQUIRED:
        missing = missing | F.coalesce(T.is_blank(name), F.lit(True))
    label = F.concat(F.lit("manifest entry lacks a required field: "), F.coalesce("doc_id", F.lit("?")))
    return fail_when(rows, missing, label)


def load_corpus(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Manifest columns plus the stripped text of ``<doc_id>.txt``; a missing or blank file fails."""
    files = spark.read.text(f"{folder}/*.txt", wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.txt\z", 1).alias("doc_id"),
        T.strip("value").alias("text"),
    )
    joined = manifest.join(files, "doc_id", "left")
    empty = F.coalesce("text", F.lit("")) == ""
    return fail_when(joined, empty, F.concat(F.lit("no text for document "), F.col("doc_id")))
