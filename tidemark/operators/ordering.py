"""Positions, samples and splits of tables of any size: no task sorts or numbers all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_for
from ..storage import materialize

EARLIER = (Window.unboundedPreceding, -1)


def mark(key, seed: int) -> Column:
    """A digest that puts keys into an order of their own for each seed."""
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def numbered(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """df and each row's place from 0 in an order that tells all rows apart. Rows are dealt by ranges and written once, so
    that ranges stay as they are; a range is numbered in a task of its own, from the sum of those before it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(n, *order).withColumn("range_", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("range_").agg(F.count("*").alias("rows_"))  # a row a range
    starts = sizes.select("range_", F.coalesce(F.sum("rows_").over(Window.orderBy("range_").rowsBetween(*EARLIER)), F.lit(0)).alias("start_"))
    within = F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    return dealt.join(F.broadcast(starts), "range_").withColumn(name, F.col("start_") + within - 1).drop("range_", "start_")


def shuffled(df: DataFrame, key: str, seed: int, name: str = "position") -> DataFrame:
    """df in a seeded random order; key tells rows apart."""
    return numbered(df.withColumn("mark_", mark(key, seed)), "mark_", key, name=name).drop("mark_")


def sampled(df: DataFrame, key: str, rate: float, seed: int) -> DataFrame:
    """The count_for(rows, rate) rows that come first in the seeded order of their keys, which tell rows apart; rows without
    a key don't count. Digests are counted by their first four digits, so at most 65,536 counts tell which rows are in;
    only those of the one bucket that is cut are sorted."""
    marked = df.where(F.col(key).isNotNull()).withColumn("mark_", mark(key, seed)).withColumn("bucket_", F.substring("mark_", 1, 4))
    sizes = marked.groupBy("bucket_").agg(F.count("*").alias("size_"))
    sizes = sizes.withColumns({"start_": F.coalesce(F.sum("size_").over(Window.orderBy("bucket_").rowsBetween(*EARLIER)), F.lit(0)), "total_": F.sum("size_").over(Window.partitionBy())})
    edges = sizes.select("bucket_", "size_", (count_for("total_", rate) - F.col("start_")).alias("room_")).where("room_ > 0")
    met = marked.join(F.broadcast(edges), "bucket_")
    cut = met.where("room_ < size_").withColumn("nth_", F.row_number().over(Window.partitionBy("bucket_").orderBy("mark_", key))).where("nth_ <= room_")
    return met.where("room_ >= size_").select(*df.columns).unionByName(cut.select(*df.columns))


def split(df: DataFrame, fraction: float, *order) -> DataFrame:
    """df and prefix: whether a row is one of the first count_for(rows, fraction) in the order."""
    placed = numbered(df, *order, name="place_")
    total = placed.agg(F.count("*").alias("total_"))  # one row
    return placed.join(F.broadcast(total), F.lit(True)).withColumn("prefix", F.col("place_") < count_for("total_", fraction)).drop("place_", "total_")


def aligned(left: DataFrame, right: DataFrame, by_left: list, by_right: list) -> DataFrame:
    """position, left, right: rows of two tables that stand at the same place of their orders; null where one has ended."""
    a, b = (numbered(df, *by).select("position", F.struct(*df.columns).alias(n)) for df, by, n in ((left, by_left, "left"), (right, by_right, "right")))
    return a.join(b, "position", "full_outer")
