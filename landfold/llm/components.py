"""Connected components over an edge table: alternating large-star and small-star rounds, all of it distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, sweep

MAX_ROUNDS = 60


def _lowest(pairs: DataFrame) -> DataFrame:
    """Each u with the smallest node among its v and itself; partial sums keep a hot u to a row per task."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _settled(e: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u itself."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges(a long, b long) to (node, root): root is the smallest node reachable. Null ends and loops are ignored;
    nodes without an edge don't occur. No neighbour list is ever gathered: hot nodes meet in joins that AQE may split.
    """
    e = narrow(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct())
    for _ in range(MAX_ROUNDS):
        if _settled(e):
            sweep(e.sparkSession)
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # cut between the stars: what both sides of a join are made of would else be worked out for each of them
        large = narrow(e.select(F.col("v").alias("u"), F.col("u").alias("v")).join(_lowest(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = _lowest(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = narrow(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
