"""Suites 1 to 3 (and the smoke run): what each control finds in each stream, for all cells in one job.

Every stream is folded once by event, entity and order; the scenarios read their outcome from those facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.controls import backfill_window, dedup_count, invalid_keys
from ..sources import generators
from ..sources.generators import CHECKPOINTS, SEEDS, SIZES

# Fixed values.
RATES = {1: (0.01,), 2: (0.001, 0.01, 0.05, 0.10), 3: (0.001, 0.01, 0.05, 0.10)}
STALE_AFTER_SECONDS = 3600
CELL = ["suite", "dataset_size", "seed", "rate"]
STREAM = [*CELL, "stream"]


def grid(suite: int, sizes=SIZES, seeds=None, rates=None) -> list[tuple]:
    return [(suite, "suite", "none", n, seed, float(r), 0.0, 0.0, 0.0, 0.0) for n in sizes for seed in seeds or SEEDS[suite] for r in rates or RATES[suite]]


def facts(streams: DataFrame) -> DataFrame:
    """One row a stream: counts that decide every scenario."""
    seen = streams.groupBy(*STREAM, "n").agg(F.count("*").alias("times"), F.min_by("void", "arrival_seq").alias("first_void"), F.count_if("void").alias("voids"), F.max("injected").alias("injected"))
    size, n = F.col("dataset_size"), F.col("n")
    within = lambda low, high: F.sum(F.when((n >= low) & (n < high), F.col("times")).otherwise(0))
    counted = seen.groupBy(*STREAM).agg(
        F.max("injected").alias("injected"), F.sum("times").alias("rows"), F.count("*").alias("kept"), F.sum("voids").alias("voids"), F.count_if("first_void").alias("kept_voids"),
        within(F.lit(0), F.greatest(F.lit(1), F.floor(size / 2))).alias("first_half"), within(F.floor(size / 4), F.floor(size * 3 / 4)).alias("middle"),
    )
    by_time, by_seq = (Window.partitionBy(*STREAM).orderBy(c) for c in ("event_ts", "arrival_seq"))
    placed = streams.where("stream in ('late', 'base')").withColumn("back", F.col("event_ts") < F.lag("event_ts").over(by_seq)).withColumn("sorted_at", F.row_number().over(by_time) - 1)
    order = placed.groupBy(*STREAM).agg((F.count_if("back") == 0).alias("in_order"), (F.count_if(F.col("sorted_at") != F.col("n")) == 0).alias("sorts_back"))
    ends = streams.where("stream in ('base', 'shuffled')").groupBy(*CELL, "entity").agg(
        F.max_by("n", F.when(F.col("stream") == "base", F.struct("event_ts", "arrival_seq"))).alias("want"),
        F.max_by("n", F.when(F.col("stream") == "shuffled", F.col("arrival_seq"))).alias("last"),
        F.max_by("n", F.when(F.col("stream") == "shuffled", F.struct("event_ts", "arrival_seq"))).alias("newest"),
    )
    states = ends.groupBy(*CELL).agg((F.count_if(~F.col("last").eqNullSafe(F.col("want"))) == 0).alias("last_right"), (F.count_if(~F.col("newest").eqNullSafe(F.col("want"))) == 0).alias("newest_right"))
    return counted.join(order, STREAM, "left").join(states, CELL, "left")


def outcomes(suite: int) -> list[tuple]:
    """(scenario, strategy, checkpoint, stream, injected, detected, correct) as columns over facts."""
    c, none, never = F.col, F.lit(0).cast("long"), F.lit(False)
    size, put = c("dataset_size"), c("injected")
    dropped = c("rows") - c("kept")
    whole = (c("kept") == size) & (dropped == put)
    if suite == 3:
        entities = [
            ("mixed_faults", "dedup_then_validate", None, "mixed", put, dropped + c("kept_voids"), (c("kept") == size) & (dropped * 2 == put)),
            ("late_arrival", "arrival_order", None, "late", put, none, c("in_order")),
            ("late_arrival", "event_time_order", None, "late", put, put, c("sorts_back")),
            ("conflicting_updates", "arrival_last_write", None, "shuffled", size, none, c("last_right")),
            ("conflicting_updates", "event_time_latest_write", None, "shuffled", size, size, c("newest_right")),
        ]
        for part in CHECKPOINTS:
            entities += [("checkpoint_recovery", "append_replay", part, f"replay-{part}", put, put, c("rows") == size), ("checkpoint_recovery", "idempotent_replay", part, f"replay-{part}", put, dropped, whole)]
        return entities
    found = ("null_business_key", c("voids"), c("voids") == put)
    if suite == 2:
        inside = (size - c("middle"), size - c("middle"), c("middle") == F.floor(size * 3 / 4) - F.floor(size / 4))
        return [
            *(("duplicate_replay", s, None, "duplicated", put, dropped, whole) for s in ("sort_group_comparator", "set_control")),
            *((found[0], s, None, "nulled", put, *found[1:]) for s in ("explicit_loop_comparator", "kit_control")),
            ("partial_recovery", "append_replay_comparator", None, "replay-0.6", put, put, c("rows") == size), ("partial_recovery", "idempotent_replay_control", None, "replay-0.6", put, dropped, whole),
            *(("bounded_recovery", s, None, "base", *inside) for s in ("predicate_comparator", "kit_control")),
        ]
    outside = size - c("first_half")
    age = F.lit(7200)  # two hours after the last event
    return [
        ("duplicate_replay", "baseline", None, "duplicated", put, none, never), ("duplicate_replay", "controlled", None, "duplicated", put, dropped, whole),
        (found[0], "baseline", None, "nulled", put, none, never), (found[0], "controlled", None, "nulled", put, *found[1:]),
        ("bounded_backfill", "baseline", None, "base", outside, none, c("rows") == c("first_half")), ("bounded_backfill", "controlled", None, "base", outside, outside, c("first_half") == F.greatest(F.lit(1), F.floor(size / 2))),
        ("stale_data", "baseline", None, "base", F.lit(1), none, never), ("stale_data", "controlled", None, "base", F.lit(1), (age > STALE_AFTER_SECONDS).cast("long"), age > STALE_AFTER_SECONDS),
    ]


def observe(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """One row for each cell, scenario and strategy."""
    known = facts(generators.generate_streams(spark, rows))

    def cell(scenario: str, strategy: str, checkpoint: float | None, stream: str, put: Column, found: Column, right: Column) -> Column:
        fields = F.struct(F.lit(scenario).alias("scenario"), F.lit(strategy).alias("strategy"), F.lit(checkpoint).cast("double").alias("checkpoint"), put.cast("long").alias("faults_injected"), found.cast("long").alias("faults_detected"), F.coalesce(right, F.lit(False)).cast("int").alias("correct"))
        return F.when(F.col("stream") == stream, fields)

    each = F.explode(F.array_compact(F.array(*(cell(*o) for o in outcomes(rows[0][0]))))).alias("o")
    return known.select(*CELL, each).select(*CELL, "o.*")


def summary(observations: DataFrame) -> DataFrame:
    """Over seeds: runs, the detection rate (null where nothing was put in) and the rate of correct runs."""
    put, found = F.sum("faults_injected"), F.sum("faults_detected")
    return observations.groupBy("scenario", "strategy", "dataset_size", "rate", "checkpoint").agg(F.count("*").alias("runs"), F.round(F.try_divide(found, put), 6).alias("detection_rate"), F.round(F.avg("correct"), 6).alias("correct_run_rate"))


def smoke(spark: SparkSession) -> dict:
    """Three events through three controls."""
    from datetime import datetime, timezone

    rows = [(1, "e1", "c1", "2026-01-01T00:00:00Z"), (2, "e2", None, "2026-01-01T01:00:00Z"), (3, "e1", "c1", "2026-01-01T02:00:00Z")]
    events = spark.createDataFrame(rows, "seq long, event_id string, customer_id string, at string").withColumn("event_ts", F.to_timestamp("at"))
    counted = dedup_count(events, "event_id").first()
    day = [datetime(2026, 1, d, tzinfo=timezone.utc) for d in (1, 2)]
    return {"input_rows": counted.input_rows, "unique_rows": counted.kept_rows, "duplicate_events_detected": counted.duplicates, "null_business_keys_detected": invalid_keys(events, "customer_id", "seq").count(), "bounded_window_rows": backfill_window(events, "event_ts", *day).count()}
