"""The corpus pipeline: documents through five stages, each written and read again as the next one's input.

Every stage but the last returns the columns it was given, so that of ``documents`` stay as they are;
the last returns a row of tokens per document. Nulls, empty tables, repeated rows and further columns
are handled as the operators say; each stage's function says what it decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from daftar.llm import bpe, decontaminate, language, nearcopies, secrets
from daftar.llm.common import Scratch
from daftar.llm.queries import tokenizer
from daftar.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that are null, empty, without a letter, or in which no language holds two fifths of the letters."""
    ship_package(spark)
    return language.accept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays, the one with the smallest doc_id.

    Links are SimHash fingerprints at 3 or fewer bits, and similarities of 0.8, both on five-word shingles.
    """
    ship_package(spark)
    return nearcopies.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that overlap an item of ``benchmark``."""
    ship_package(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced and n_chars is counted anew."""
    ship_package(spark)
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document."""
    ship_package(spark)
    path, pattern = tokenizer()
    return bpe.encode_texts(docs, bpe.read_ranks(spark, path), pattern, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", near_dedup),
    ("decontamination", remove_benchmark),
    ("secret_scan", remove_secrets),
    ("bpe_encode", encode),
]

#: Fingerprints, forests and merges are not SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the table ``documents`` of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), f"{number}-{name}")
    return docs
