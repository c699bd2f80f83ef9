"""Connected components by alternating large-star and small-star steps.

Every round rewires edges towards the smallest neighbour with grouped
minima and joins only; no group is gathered, and a hub's edges are spread
by the skew-aware join. Rounds are written to the shared folder, so lineage
stays short and a lost executor costs one round at most. The number of
rounds grows with the logarithm of the graph's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for all nodes that have an edge; ``edges`` is
    ``(a, b)``. A component is named by its smallest node; self-loops and
    repeated edges are allowed."""
    now = staged(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
                 .filter("low < high").distinct())
    while not _stars(now):
        both = now.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(
            now.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
        large = (both.join(least, F.col("u") == F.col("_u")).filter("v > u")
                 .select(F.least("u", "_m").alias("low"), F.col("v").alias("high")))
        least = large.groupBy(F.col("high").alias("_u")).agg(F.min("low").alias("_m"))
        small = large.join(least, F.col("high") == F.col("_u"))
        now = staged(small.select(F.col("_m").alias("low"), F.col("low").alias("high"))
                     .unionByName(least.select(F.col("_m").alias("low"), F.col("_u").alias("high")))
                     .filter("low < high").distinct())
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
        now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every edge leads from the smallest node of a component: no
    node is an upper end twice, or an upper end and a lower one."""
    ends = edges.select(F.col("high").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("low").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()
