"""Connected components by star contraction, with hubs kept out of the shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from daftar.llm.common import Scratch

_HUBS = 100_000  # no more nodes than this are broadcast


def _with_least(edges: DataFrame, least: DataFrame, cut: int, hubs: bool) -> DataFrame:
    """``edges`` with the value ``m`` of their node ``u`` in ``least``; a node that has none there is its own.

    Nodes with more than ``cut`` edges, where there may be any, are so few that they are broadcast;
    what is left to the shuffled join has at most ``cut`` edges a node.
    """
    own = F.coalesce("m", "u").alias("m")
    if not hubs:
        return edges.join(least.hint("merge"), "u", "left").select("u", "v", own)
    many = edges.groupBy("u").agg(F.count("*").alias("degree")).where(F.col("degree") > cut).select("u")
    of_many = edges.join(F.broadcast(many.join(least.hint("merge"), "u", "left").select("u", own)), "u")
    few = edges.join(F.broadcast(many), "u", "left_anti").join(least.hint("merge"), "u", "left")
    return of_many.select("u", "v", "m").unionByName(few.select("u", "v", own))


def _shape(edges: DataFrame) -> Row:
    """Of edges (u, v): how many, the most of one u and of one v, and whether (1) or not (0) a node is both."""
    up = F.struct(F.col("u").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below"))
    down = F.struct(F.col("v").alias("node"), F.lit(0).alias("above"), F.lit(1).alias("below"))
    ends = edges.select(F.explode(F.array(up, down)).alias("end")).groupBy(F.col("end.node").alias("node"))
    nodes = ends.agg(F.sum("end.above").alias("above"), F.sum("end.below").alias("below"))
    both = F.max(F.least("above", "below", F.lit(1)))
    return nodes.agg(F.sum("above").alias("edges"), F.max("above").alias("above"), F.max("below").alias("below"), both.alias("both")).first()


def components(edges: DataFrame, scratch: Scratch, name: str = "graph", most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component, for every node of ``edges`` (low, high).

    Alternates two steps until only stars are left: every node hands its larger neighbours to its
    smallest one, then its smaller neighbours too. The number of rounds is logarithmic in the length
    of paths; each is stored and replaces the one before. Loops are taken as they come; an empty
    table has an empty result.

    Every round is planned by the driver, so rounds are few and their plans small: stars are known
    without another round, and hubs get a join of their own only where a node has so many edges.
    """
    found = edges.select(F.greatest("low", "high").alias("u"), F.least("low", "high").alias("v"))
    first = scratch.put(found.distinct(), f"{name}-0")
    current, loops = first.where("u <> v"), None
    for step in range(1, most_rounds + 1):
        shape = _shape(current)
        if step == 1 and first.count() > (shape.edges or 0):
            loops = first.where("u = v")
        if not shape.edges or (shape.above == 1 and not shape.both):
            ends = current.unionAll(current.select("v", "v"))
            ends = ends if loops is None else ends.unionAll(loops)
            return ends.toDF("node", "root").groupBy("node").agg(F.min("root").alias("root"))
        cut = max(1000, 2 * shape.edges // _HUBS)
        down = current.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = current.groupBy("u").agg(F.min("v").alias("m"))
        large = _with_least(down, least, cut, shape.below > cut).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.put(large.distinct(), f"{name}-large-{step}")
        fewer = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = _with_least(large, fewer, cut, shape.above > cut)  # no node has more smaller neighbours than before
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
        after = scratch.put(moved.select(F.inline(ends)).where("u <> v").distinct(), f"{name}-{step}")
        if step > 1 or loops is None:
            scratch.drop(f"{name}-{step - 1}")
        scratch.drop(f"{name}-large-{step}")
        current = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
