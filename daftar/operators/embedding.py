"""Embedding columns: a pluggable function, its default stand-in, and the backfill job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar import settings as S
from daftar.functions import text as T
from daftar.functions.vectors import check_dims

# Turns a batch of texts into one row of floats per text. Build it once per Python worker.
EmbedFn = Callable[[list[str]], np.ndarray]
EmbedFactory = Callable[[], EmbedFn]


def apply_embedder(texts: DataFrame, factory: EmbedFactory, dim: int, text: str = "text", out: str = "embedding") -> DataFrame:
    """(id, text) -> (id, vector) in Arrow batches; the model is built once per task."""
    kind = dict(texts.dtypes)["id"]

    def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for frame in frames:
            vectors = np.asarray(model(frame[text].tolist()), dtype=np.float32)
            if vectors.shape != (len(frame), dim):
                raise ValueError(f"embedder returned {vectors.shape}, expected {(len(frame), dim)}")
            yield pd.DataFrame({"id": frame["id"], out: list(vectors)})

    return texts.select("id", text).mapInPandas(embed, f"id {kind}, {out} array<float>")


def hashed_embedding(texts: DataFrame, dim: int, text: str = "text", out: str = "embedding") -> DataFrame:
    """Deterministic stand-in: hashed term counts, unit length. No claim about quality."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = texts.withColumn("_words", T.lexical_tokens(T.normalize_for_index(text)))
    counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim).transform(words)
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(counted)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")


def embed_distinct(texts: DataFrame, embed: Callable[[DataFrame], DataFrame], text: str = "question") -> DataFrame:
    """Embed each distinct string once and join the vectors back."""
    once = texts.select(F.col(text).alias("text")).distinct().withColumn("id", F.sha2("text", 256))
    vectors = embed(once).select("id", F.col("embedding").alias("vector"))
    return texts.withColumn("id", F.sha2(text, 256)).join(vectors, "id").drop("id")


def backfill(
    chunks: DataFrame,
    model_key: str,
    embed: Callable[[DataFrame], DataFrame],
    only_missing: bool = True,
    dim: int | None = None,
) -> DataFrame:
    """Chunks with the model's column filled; with ``only_missing`` just the NULLs are computed.

    ``embed`` maps (id, text) to (id, embedding). The original text is embedded, as a passage.
    Rows already done keep their vector, so an interrupted run resumes from what was written.
    """
    if model_key not in S.EMBEDDING_COLUMNS:
        raise ValueError(f"unknown model key {model_key!r}")
    column = S.EMBEDDING_COLUMNS[model_key]
    dim = S.EMBEDDING_DIMS[model_key] if dim is None else dim
    pending = chunks.where(F.col(column).isNull()) if only_missing else chunks
    passages = pending.select("id", T.with_prefix("text", model_key, "passage").alias("text"))
    fresh = embed(passages).select("id", check_dims("embedding", dim).alias("_new"))
    joined = chunks.join(fresh, "id", "left")
    return joined.withColumn(column, F.coalesce("_new", column)).drop("_new").select(*chunks.columns)


def backfill_stats(before: DataFrame, model_key: str, only_missing: bool = True) -> DataFrame:
    """One row: rows a run embeds and rows it leaves alone."""
    column = F.col(S.EMBEDDING_COLUMNS[model_key])
    todo = F.count_if(column.isNull()) if only_missing else F.count(F.lit(1))
    counted = before.agg(F.count(F.lit(1)).alias("_n"), todo.alias("chunks_embedded"))
    skipped = F.greatest(F.col("_n") - F.col("chunks_embedded"), F.lit(0))
    return counted.select(F.lit(model_key).alias("model_key"), "chunks_embedded", skipped.alias("chunks_skipped"))
