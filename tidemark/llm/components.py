"""Connected components by alternating large-star and small-star steps, each a shuffle-bounded DataFrame step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _salted(edges: DataFrame, mins: DataFrame, salts: int) -> DataFrame:
    """edges join mins on x; a hub's many edges are dealt over `salts` tasks, its one row of mins goes to each."""
    left = edges.withColumn("salt", F.pmod(F.xxhash64("y"), F.lit(salts)).cast("int"))
    right = mins.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, ["x", "salt"]).select("x", "y", "m")


def _stars(edges: DataFrame) -> bool:
    if not edges.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return edges.select("y").distinct().join(edges.select(F.col("x").alias("y")), "y", "left_semi").isEmpty()


def components(edges: DataFrame, salts: int = 16) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node reachable.

    Self-loops and nulls are ignored, repeated edges count once. Each round is written to the shared folder. It ends when
    all components are stars: every node has one parent, and no parent has one. Only two answers of that reach the driver.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct()
    now = materialize(now, "components")
    while not _stars(now):
        # large star: every larger neighbour of x goes to the least of x and its neighbours
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        mins = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = _salted(now.select(F.col("y").alias("x"), F.col("x").alias("y")), mins, salts).select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        # small star: x and its smaller neighbours go to the least of them
        mins = large.groupBy("x").agg(F.min("y").alias("m"))
        small = _salted(large, mins, salts)
        small = small.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(mins.select("x", F.col("m").alias("y"))).distinct()
        last, now = now, materialize(small, "components")
        release(last)
    return now.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(now.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())
