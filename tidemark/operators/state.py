"""Latest states and their comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What wins among rows of one entity with one event time.
TIES = {
    "first_arrival": lambda: F.struct("event_ts", -F.col("arrival_seq")),
    "event_id": lambda: F.struct("event_ts", F.col("event_id").cast("string")),
    "last_arrival": lambda: F.struct("event_ts", "arrival_seq"),
}


def latest(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The row of each key that is largest by `order`, folded in the tasks that read it."""
    return df.groupBy(F.col(key).alias("key_")).agg(F.max_by(F.struct(*df.columns), order).alias("r_")).select("r_.*")


def latest_event_time(df: DataFrame, key: str = "entity_id", tie: str = "first_arrival") -> DataFrame:
    return latest(df, key, TIES[tie]())


def last_arrival(df: DataFrame, key: str = "entity_id", seq: str = "arrival_seq") -> DataFrame:
    return latest(df, key, F.col(seq))


def latest_version(df: DataFrame, key: str = "key") -> DataFrame:
    """key, version, value, deleted; tombstones stay."""
    return latest(df.select("key", "version", "value", "deleted"), key, F.struct("version", "value", "deleted"))


def diff(actual: DataFrame, expected: DataFrame, runs: Sequence[str] = ()) -> DataFrame:
    """key, reason for every key whose (version, value, deleted) differ."""
    a, e = (x.select(*runs, "key", F.struct("version", "value", "deleted").alias(n)) for x, n in ((actual, "a"), (expected, "e")))
    both = a.join(e, [*runs, "key"], "full_outer").where(~F.col("a").eqNullSafe(F.col("e")))
    reason = (
        F.when(F.col("a").isNull(), "missing key")
        .when(F.col("e").isNull(), "unexpected key")
        .when(F.col("a.version") < F.col("e.version"), "stale version")
        .when(F.col("a.version") > F.col("e.version"), "unexpected newer version")
        .otherwise("payload/tombstone mismatch")
    )
    return both.select(*runs, "key", reason.alias("reason"))


def contradictions(changes: DataFrame) -> DataFrame:
    """kind, name: ids and versions whose least and greatest payloads differ. An expected state that has any is none; this
    check shares nothing with those that replays make of their input."""
    apart = lambda *c: F.min(F.struct(*c)) != F.max(F.struct(*c))
    ids = changes.groupBy("event_id").agg(apart("key", "version", "value", "deleted").alias("apart")).select(F.lit("event_id").alias("kind"), F.col("event_id").cast("string").alias("name"), "apart")
    versions = changes.groupBy("key", "version").agg(apart("value", "deleted").alias("apart")).select(F.lit("version").alias("kind"), F.concat_ws("/", "key", "version").alias("name"), "apart")
    return ids.unionByName(versions).where("apart").drop("apart")


def order_breaks(df: DataFrame, key: str = "entity_id") -> DataFrame:
    """key, deliveries, out_of_order: how often an entity's event time goes back."""
    back = F.col("event_ts") < F.lag("event_ts").over(Window.partitionBy(key).orderBy("arrival_seq"))
    return df.select(key, back.alias("back_")).groupBy(key).agg(F.count("*").alias("deliveries"), F.count_if("back_").alias("out_of_order"))
