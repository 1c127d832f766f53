"""The ablation matrix: every model and configuration from lists that are searched once.

One lexical list per question and one dense list per question and model are enough: hybrid lists are
fused from them, reranked ones reordered, and shallower ones are their first ranks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar import settings as S
from daftar.operators import evaluation as M
from daftar.operators import fusion as X
from daftar.operators.ranking import with_payload

NO_MODEL = "-"


def _lists(lexical: DataFrame, dense: Mapping[str, DataFrame], chunks: DataFrame, queries: DataFrame, depth: int, scorer: X.Scorer) -> Iterator[tuple[str, str, DataFrame]]:
    """(model, config, hits) of every cell's configuration."""

    def first(hits: DataFrame) -> DataFrame:
        return hits.where(F.col("rank") <= depth)

    yield NO_MODEL, "lexical", first(lexical)
    for model, hits in dense.items():
        yield model, "dense", first(hits)
        both = X.rrf_fuse(X.stack(first(hits), first(lexical)), limit=depth)
        yield model, "hybrid", both
        loaded = with_payload(both, chunks).join(queries.select("query_id", "question"), "query_id")
        yield model, "hybrid+rerank", X.rerank(loaded, scorer, depth)


def measured_matrix(
    lexical: DataFrame, dense: Mapping[str, DataFrame], chunks: DataFrame, pairs: DataFrame, qrels: DataFrame,
    depth: int = S.RETRIEVE_DEPTH, scorer: X.Scorer = X.overlap_scorer,
) -> DataFrame:
    """(model, config, query_id, metrics): each pair's metrics under every model and configuration.

    ``lexical`` and each of ``dense`` are ranked lists of at least ``depth``, written before: every
    configuration reads them. ``pairs`` has the question, its tag and its source.
    """
    asked = pairs.select("query_id", "dialect_tag", "source_doc")
    cells = [
        M.per_query(asked, hits, qrels).select(F.lit(model).alias("model"), F.lit(config).alias("config"), "*")
        for model, config, hits in _lists(lexical, dense, chunks, pairs, depth, scorer)
    ]
    return reduce(DataFrame.unionByName, cells)


def refusal_table(
    lexical: DataFrame, dense: Mapping[str, DataFrame], chunks: DataFrame, pairs: DataFrame, qrels: DataFrame,
    depth: int = S.RETRIEVE_DEPTH, scorer: X.Scorer = X.overlap_scorer,
) -> DataFrame:
    """(model, config, n, with_hits, top_score_mean, top_score_max) over the pairs that nothing answers."""
    asked = pairs.select("query_id", "dialect_tag", "source_doc")
    lines = [
        M.unanswerable_line(asked, qrels, hits).select(F.lit(model).alias("model"), F.lit(config).alias("config"), "*")
        for model, config, hits in _lists(lexical, dense, chunks, pairs, depth, scorer)
    ]
    return reduce(DataFrame.unionByName, lines)
