"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the least node it knows."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).withColumnRenamed("a", "v")
    return both.where("b > a").join(least, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "v")
    ties = down.join(least, F.col("a") == F.col("v")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return ties.union(least.select(F.col("v").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a, b), root being the least node of its component.

    Loops are ignored and edges may repeat; an empty table gives no rows. Every round is written to the shared
    folder, and the number of rounds grows with the logarithm of the longest path.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if mark == seen or not mark[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
        stars = _large_star(edges).where("a <> b").distinct()
        edges = written(_small_star(stars).where("a <> b").distinct(), "edges")
