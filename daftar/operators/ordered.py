"""Order statistics without sorting a group in one task.

Rows are dealt to partitions once, by ranges of (group, value). Each partition is summed on its own;
what lies before it in a group is one small sum per partition, because only the first group of a
partition can have begun in an earlier one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daftar.session import cut_lineage


def running_totals(df: DataFrame, by: Sequence[str], order: str | Sequence[str], values: Sequence[str]) -> DataFrame:
    """Add ``cum_<value>``: the inclusive running sum over ``order`` inside each ``by`` group.

    ``df`` has one row per (by, order). It is computed once and dealt by one range exchange; the
    dealing is stored, so that every later pass sees the same partitions. A group of any size is
    spread over as many partitions as its rows fill. Null groups are groups.
    """
    by, order = list(by), [order] if isinstance(order, str) else list(order)
    dealt = cut_lineage(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({f"cum_{v}": F.sum(v).over(inside) for v in values})

    totals = dealt.groupBy(*by, "_part").agg(*(F.sum(v).alias(f"_t_{v}") for v in values))
    # One row per partition at most is not the first of its group, however many groups there are.
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.withColumns({f"_o_{v}": F.sum(f"_t_{v}").over(before) for v in values})
    earlier = earlier.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy("_part"))).where("_at > 1")
    offsets = earlier.select(F.col("_part").alias("_p"), *(F.col(b).alias(f"_b_{b}") for b in by), *(f"_o_{v}" for v in values))
    same = reduce(lambda c, b: c & F.col(b).eqNullSafe(F.col(f"_b_{b}")), by, F.col("_part") == F.col("_p"))
    met = summed.join(F.broadcast(offsets), same, "left")
    met = met.withColumns({f"cum_{v}": F.col(f"cum_{v}") + F.coalesce(f"_o_{v}", F.lit(0)) for v in values})
    return met.select(*df.columns, *(f"cum_{v}" for v in values))


def _counted(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counts, by, value, ["n"])


def _with_size(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    if not by:
        return counted.join(F.broadcast(counted.agg(F.sum("n").alias("_size"))))  # one row
    return counted.join(counted.groupBy(*by).agg(F.sum("n").alias("_size")), list(by))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Percentiles at position ceil(p * n), plus ``n``; ``points`` maps output name to p."""
    counted = _with_size(_counted(df, by, value), by)
    picks = [
        F.min(F.when(F.col("cum_n") >= F.greatest(F.ceil(F.lit(p) * F.col("_size")), F.lit(1)), F.col(value))).alias(name)
        for name, p in points.items()
    ]
    return counted.groupBy(*by).agg(F.sum("n").alias("n"), *picks)


def rounded_index(df: DataFrame, by: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Quantiles at 0-based index int(f * (n - 1) + 0.5), plus n, min and max.

    Not :func:`nearest_rank`: the two conventions differ and both are in use.
    """
    counted = _with_size(_counted(df, by, value), by)
    picks = [
        F.min(F.when(F.col("cum_n") > F.floor(F.lit(f) * (F.col("_size") - 1) + 0.5), F.col(value))).alias(name)
        for name, f in points.items()
    ]
    return counted.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min(value).alias("min"), *picks, F.max(value).alias("max")
    )
