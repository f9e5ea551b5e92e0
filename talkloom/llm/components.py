"""Connected components by alternating large-star and small-star steps, one stored round after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from talkloom.operators.lookup import lookup
from talkloom.session import materialise


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang each node's larger (or, for small, smaller) neighbours on its smallest neighbour."""
    if small:
        seen = edges
    else:
        seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    hung = lookup(seen, least, "u", "inner")
    if small:
        # u and its smaller neighbours all go to the smallest.
        moved = hung.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
            least.select("u", F.col("least").alias("v")))
    else:
        moved = hung.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.where("u <> v").distinct()


def _only_stars(pairs: DataFrame) -> bool:
    """Whether every node hangs on one other node, which itself hangs on none."""
    ends = pairs.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))).alias("e")).select("e.*")
    of_node = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return of_node.where("hangs > 1 OR hangs + holds > 1").isEmpty()


def components(edges: DataFrame, left: str, right: str, name: str = "components") -> DataFrame:
    """node, component: the smallest node that each node of ``edges`` is connected with.

    Edges have no direction. Nodes linked only with themselves, and null ends, are left
    out. Each round is written to the shared folder; a large hub's edges are reduced to
    its smallest neighbour before they are shuffled, and joined with room for skew. It ends
    when only stars are left, each around its smallest node.
    """
    a, b = F.col(left), F.col(right)
    pairs = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    pairs = materialise(pairs, f"{name}_edges")
    if pairs.isEmpty():
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        large = materialise(_star(pairs, small=False), f"{name}_large")
        pairs = materialise(_star(large, small=True), f"{name}_small")
        if _only_stars(pairs):
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
