"""Connected components as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advigil.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); the root is the least node.

    Large-star and small-star steps alternate until the edges no longer change. Each step
    joins the least neighbour of a node to its edges, so a hub with any number of edges is
    an aggregate and a join, never a list. Null nodes and loops are ignored; no edges give
    no rows.
    """
    given = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = stored(given.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _settled(now):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(lowest, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .union(lowest.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = stored(small, "edges")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one smaller node, and that one to none."""
    above = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    roots = edges.select(F.col("v").alias("u")).distinct().withColumn("root", F.lit(True))
    return above.join(roots, "u", "left").where("n > 1 OR root").isEmpty()
