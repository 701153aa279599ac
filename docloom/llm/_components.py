"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.storage import stage, unstage


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star pass: nodes hang on the smallest node that they or their neighbours know.

    ``edges`` has a > b. Both passes need only each node's smallest neighbour, a sum that combines before the shuffle.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least.select(F.col("a").alias("u"), "m"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    hung = large.unionByName(own).where(F.col("a") > F.col("b")).distinct()
    low = hung.groupBy("a").agg(F.min("b").alias("m"))
    small = hung.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return small.where(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (columns a, b): component is the smallest node reached.

    Repeated, reversed and self edges do no harm. Each pass is written to the shared folder; passes end when one changes
    nothing, after some log2 of the longest path.
    """
    new = stage(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    n, going = new.count(), True
    while n and going:
        now, before = new, n
        new = stage(_stars(now), "stars")
        n = new.count()
        # both are sets of edges, so equal numbers and nothing new mean equal sets
        going = n != before or bool(new.join(now, ["a", "b"], "left_anti").head(1))
        unstage(now)
    return new.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
