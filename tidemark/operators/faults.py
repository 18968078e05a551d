"""Faults put into an event stream by deterministic rules.

Events: event_id, entity_id, business_key, event_ts, value, fault_tags, is_recovery_replay, arrival_seq. A rule is a
column that tells which events are hit; each fault keeps its place in the order conflict, late, null, duplicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Arrival numbers of faults lie this far after all others.
LATE, COPY, CONFLICT = 10**12, 2 * 10**12, 10**11


def chosen(df: DataFrame, ids: DataFrame, key: str = "event_id") -> DataFrame:
    """df and chosen: whether a row's key is among ids, which may be many."""
    return df.join(ids.select(key, F.lit(True).alias("chosen")), key, "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def tagged(name: str) -> Column:
    return F.array_sort(F.array_union("fault_tags", F.array(F.lit(name))))


def duplicate(df: DataFrame, rule: Column) -> DataFrame:
    """Copies come from one reading of df."""
    both = df.withColumn("copy_", F.explode(F.when(rule, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    made = {"fault_tags": F.when(F.col("copy_") == 1, tagged("duplicate")).otherwise(F.col("fault_tags")), "arrival_seq": F.col("arrival_seq") + F.col("copy_") * F.lit(COPY)}
    return both.withColumns(made).drop("copy_")


def null_key(df: DataFrame, rule: Column) -> DataFrame:
    hit = df.withColumn("hit_", F.coalesce(rule, F.lit(False)))
    return hit.withColumns({"business_key": F.when(~F.col("hit_"), F.col("business_key")), "fault_tags": F.when(F.col("hit_"), tagged("null_key")).otherwise(F.col("fault_tags"))}).drop("hit_")


def late(df: DataFrame, rule: Column) -> DataFrame:
    """Event times stay; arrival goes to the end."""
    hit = df.withColumn("hit_", F.coalesce(rule, F.lit(False)))
    return hit.withColumns({"arrival_seq": F.when(F.col("hit_"), F.col("arrival_seq") + LATE).otherwise(F.col("arrival_seq")), "fault_tags": F.when(F.col("hit_"), tagged("late")).otherwise(F.col("fault_tags"))}).drop("hit_")


def conflict(df: DataFrame, latest_state: DataFrame, rule: Column) -> DataFrame:
    """For each entity that the rule hits, an event a microsecond before its latest with another value and a new id."""
    made = latest_state.where(rule).withColumn("event_id", -F.col("entity_id") - 1).withColumn("event_ts", F.col("event_ts") - F.expr("INTERVAL '0.000001' SECOND")).withColumn("value", -F.col("entity_id") - 1)
    made = made.withColumn("arrival_seq", F.col("entity_id") + CONFLICT).withColumn("fault_tags", tagged("conflict"))
    return df.unionByName(made.select(*df.columns))
