"""Stored citations back to chunks, and links to the page an article is printed on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.functions import text as T


def hydrate_citations(rows: DataFrame, chunks: DataFrame, key: str = "id") -> DataFrame:
    """One row per stored citation still in the corpus, in stored order.

    ``rows`` has ``key`` and the JSON ``citations``. A cited id is an ordinary join key; the many
    copies of a popular chunk are spread by adaptive skew handling.
    """
    cited = rows.select(F.col(key).alias("row_id"), F.posexplode_outer(T.cited_scores("citations")).alias("pos", "c"))
    cited = cited.where(F.col("c").isNotNull()).select("row_id", "pos", "c.chunk_id", "c.score")
    payload = chunks.select(
        F.col("id").alias("chunk_id"), "doc_id", "article", T.excerpt("text").alias("excerpt")
    )
    return cited.join(payload, "chunk_id")


def manifest_sections(manifest: DataFrame) -> DataFrame:
    """(doc_id, source_url, sections) -> one row per usable section in page order."""
    sections = manifest.select("doc_id", F.posexplode_outer("sections").alias("pos", "s"))
    usable = F.col("s").isNotNull() & ~F.coalesce(F.col("s.preamble"), F.lit(False))
    sections = sections.where(usable)
    return sections.select("doc_id", "pos", "s.anchor", "s.first_article", "s.last_article")


def source_urls(cited: DataFrame, manifest: DataFrame, sections: DataFrame, key: list[str]) -> DataFrame:
    """Add ``source_url``: the document's page, plus the anchor of the first section with the article.

    Equi join on the document first, the range is only a filter on its sections.
    """
    number = T.normalize_digits(T.strip(F.col("article"))).try_cast("int")
    pages = manifest.where(F.col("source_url") != "").select("doc_id", F.col("source_url").alias("_url"))
    numbered = cited.withColumn("_number", number).join(pages, "doc_id", "left")
    ranges = sections.select(
        F.col("doc_id").alias("_doc"), "pos", "anchor", "first_article", "last_article"
    )
    inside = F.col("_number").between(F.col("first_article"), F.col("last_article"))
    hit = numbered.join(ranges, (F.col("doc_id") == F.col("_doc")) & inside)
    anchors = hit.groupBy(*key).agg(F.min_by("anchor", "pos").alias("_anchor"))
    joined = numbered.join(anchors, key, "left")
    anchored = F.concat(F.col("_url"), F.lit("#"), F.col("_anchor"))
    return joined.withColumn("source_url", F.coalesce(anchored, F.col("_url"))).drop(
        "_number", "_url", "_anchor"
    )


def payload(hits: DataFrame, stages: DataFrame | None = None) -> DataFrame:
    """What an answer reports: scores at six decimals and, joined by query, stage times at two.

    The edge of the library: nothing is computed from rounded values. ``hits`` has query_id, rank,
    chunk_id and score, ``stages`` query_id, stage and ms.
    """
    cited = F.struct("rank", "chunk_id", F.round("score", 6).alias("score"))
    answers = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(cited)).alias("citations"))
    if stages is None:
        return answers
    spent = F.struct("stage", F.round("ms", 2).alias("ms"))
    times = stages.groupBy("query_id").agg(F.array_sort(F.collect_list(spent)).alias("stages"))
    return answers.join(times, "query_id", "left")
