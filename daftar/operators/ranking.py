"""Small pieces every ranked list shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daftar import settings as S
from daftar.session import within_rows


def check_limit(limit: int, name: str = "limit") -> int:
    if limit < 1:
        raise ValueError(f"{name} must be >= 1, got {limit}")
    return limit


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows per key with a 1-based ``rank``.

    The planner trims every partition to ``k`` rows per key before the shuffle, so a hot key
    moves at most ``k`` rows per task.
    """
    check_limit(k)
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def with_payload(hits: DataFrame, chunks: DataFrame, broadcast_rows: int = S.BROADCAST_ROWS) -> DataFrame:
    """Attach doc_id, article and text to final hits; until here lists carry ids only.

    Up to ``broadcast_rows`` hits go to the chunks, so that no text is shuffled for them; they are
    counted first, so they should come from lists that are stored. More are joined by a shuffle.
    """
    payload = chunks.select(F.col("id").alias("chunk_id"), "doc_id", "article", "text")
    return (F.broadcast(hits) if within_rows(hits, broadcast_rows) else hits).join(payload, "chunk_id")
