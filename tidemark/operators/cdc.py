"""Change-data replay in closed form: what each delivery does follows from windows over the deliveries before it.

Deliveries have q (their order), event_id, key, version, value, deleted. Restoring a checkpoint gives the state of a
prefix, so a restarted delivery decides as it did at its place in one uninterrupted run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATEGIES = ("arrival", "id_only", "version")
DECISIONS, PHASES = ("applied", "duplicate", "stale", "conflict"), ("attempt", "restart", "redelivery")
PAYLOAD = ["key", "version", "value", "deleted"]


def invalid_events(events: DataFrame) -> DataFrame:
    """q, error: the first rule each malformed event breaks."""
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    error = F.when(empty("event_id"), "event_id must be a nonempty string").when(empty("key"), "key must be a nonempty string")
    error = error.when(F.col("version").isNull() | (F.col("version") < 1), "version must be a positive integer").when(F.col("value").isNull(), "value must be a string").when(F.col("deleted").isNull(), "deleted must be a boolean")
    return events.select("q", error.alias("error")).where("error is not null")


def conflicting_ids(events: DataFrame, runs: Sequence[str] = ()) -> DataFrame:
    """event_id, payloads: ids that stand for more than one payload. Runs are columns that keep streams apart."""
    return events.groupBy(*runs, "event_id", *PAYLOAD).agg(F.lit(1).alias("one")).groupBy(*runs, "event_id").agg(F.count("*").alias("payloads")).where("payloads > 1")


def conflicting_versions(events: DataFrame, runs: Sequence[str] = ()) -> DataFrame:
    """key, version, payloads: versions of a key with more than one value."""
    return events.groupBy(*runs, "key", "version", "value", "deleted").agg(F.lit(1).alias("one")).groupBy(*runs, "key", "version").agg(F.count("*").alias("payloads")).where("payloads > 1")


def validate(events: DataFrame) -> None:
    """Raises ValueError for the first event that breaks a rule, or for an id or a version that stands for two payloads."""
    first = invalid_events(events).agg(F.min("q").alias("q"), F.min_by("error", "q").alias("error")).first()
    if first.q is not None:
        raise ValueError(f"event {first.q}: {first.error}")
    for found, names in ((conflicting_ids(events), ["event_id"]), (conflicting_versions(events), ["key", "version"])):
        for row in found.orderBy(*names).limit(1).collect():
            raise ValueError(", ".join(f"{n} {row[n]}" for n in names) + " stands for different payloads")


def redelivered(events: DataFrame, total: int | Column, backwards: bool = True) -> DataFrame:
    """The deliveries 0..total-1 and all of them again."""
    again = F.lit(2) * F.lit(total) - 1 - F.col("q") if backwards else F.col("q") + total
    return events.unionByName(events.withColumn("q", again))


def regressions(rows: DataFrame, runs: Sequence[str] = ()) -> DataFrame:
    """rows with regressed: an applied row below the version applied before it to its key."""
    before = Window.partitionBy(*runs, "key").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.last(F.when(F.col("decision") == "applied", F.col("version")), ignorenulls=True).over(before)
    return rows.withColumn("regressed", (F.col("decision") == "applied") & F.coalesce(prior > F.col("version"), F.lit(False)))


def decisions(deliveries: DataFrame, strategy: str, runs: Sequence[str] = ()) -> DataFrame:
    """deliveries with decision (applied, duplicate, stale, conflict) and regressed. What comes after the first conflict
    of a run isn't delivered."""
    if strategy not in STRATEGIES:
        raise ValueError("invalid strategy")
    by_id = Window.partitionBy(*runs, "event_id").orderBy("q")
    before = Window.partitionBy(*runs, "key").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    rows = deliveries
    decision = F.lit("applied")
    if strategy != "arrival":
        rows = rows.withColumn("nth_", F.row_number().over(by_id)).withColumn("first_", F.first(F.struct(*PAYLOAD)).over(by_id))
        if strategy == "version":
            same = F.first(F.struct("value", "deleted")).over(Window.partitionBy(*runs, "key", "version").orderBy("q"))
            rows = rows.withColumn("top_", F.max("version").over(before)).withColumn("same_", same)
            decision = F.when((F.col("version") == F.col("top_")) & (F.struct("value", "deleted") != F.col("same_")), "conflict").when(F.col("version") < F.col("top_"), "stale").otherwise("applied")
        decision = F.when((F.col("nth_") > 1) & (F.struct(*PAYLOAD) != F.col("first_")), "conflict").when(F.col("nth_") > 1, "duplicate").otherwise(decision)
    rows = regressions(rows.withColumn("decision", decision).drop("nth_", "first_", "top_", "same_"), runs)
    if strategy == "arrival":
        return rows
    if runs:
        stops = rows.where("decision = 'conflict'").groupBy(*runs).agg(F.min("q").alias("stop_"))
        return rows.join(stops, list(runs), "left").where(F.coalesce(F.col("q") <= F.col("stop_"), F.lit(True))).drop("stop_")
    stop = rows.where("decision = 'conflict'").agg(F.min("q").alias("stop_"))  # one row
    return rows.join(F.broadcast(stop), F.coalesce(F.col("q") <= F.col("stop_"), F.lit(True))).drop("stop_")


def phased(decided: DataFrame, total: int | Column, checkpoint: int | Column, interruption: int | Column, runs: Sequence[str] = (), validated: bool = False) -> DataFrame:
    """A row for each time a delivery is made: attempt, restart or redelivery. Validated deliveries hold no conflict, so
    no attempt can end early."""
    if isinstance(total, int) and not 0 <= checkpoint <= interruption <= total:
        raise ValueError("require 0 <= checkpoint <= interruption <= event count")
    q = F.col("q")
    phases = F.array_compact(F.array(F.when(q < interruption, F.lit("attempt")), F.when((q >= checkpoint) & (q < total), F.lit("restart")), F.when(q >= total, F.lit("redelivery"))))
    rows = decided.withColumn("phase", F.explode(phases))
    if validated:
        return rows
    stop = decided.where((F.col("decision") == "conflict") & (q < interruption)).groupBy(*runs).agg(F.count("*").alias("halted_"))
    if runs:
        return rows.join(stop, list(runs), "left").where("halted_ is null or phase = 'attempt'").drop("halted_")
    rows = rows.join(F.broadcast(stop), F.lit(True))
    return rows.where("halted_ = 0 or phase = 'attempt'").drop("halted_")


def counters(phased_rows: DataFrame, runs: Sequence[str] = ()) -> DataFrame:
    return phased_rows.groupBy(*runs, "phase", "decision").agg(F.count("*").alias("deliveries"))


def counters_wide(phased_rows: DataFrame) -> DataFrame:
    """A row for each phase with a count for each decision, zeros where there is none."""
    counts = phased_rows.groupBy("phase").agg(*(F.count_if(F.col("decision") == d).alias(d) for d in DECISIONS))
    phases = phased_rows.sparkSession.createDataFrame([(p,) for p in PHASES], "phase string")
    return phases.join(counts, "phase", "left").fillna(0)


def recovery_counters(phased_rows: DataFrame, checkpoint: int | Column, interruption: int | Column) -> DataFrame:
    """Attempts lost by the restart, how many of them it made again, and the deliveries of the restart and after it."""
    phase, q = F.col("phase"), F.col("q")
    return phased_rows.agg(
        F.count_if((phase == "attempt") & (q >= checkpoint)).alias("lost_attempts"), F.count_if((phase == "restart") & (q < interruption)).alias("replayed_lost_attempts"),
        F.count_if(phase == "restart").alias("restart_deliveries"), F.count_if(phase == "redelivery").alias("redelivery_deliveries"),
    )


def ledger_coverage(decided: DataFrame) -> DataFrame:
    """Ids that a full ledger remembers at the end, and all that were delivered."""
    kept = F.col("decision").isin("applied", "stale")
    return decided.agg(F.count_distinct(F.when(kept, F.col("event_id"))).alias("known_ids"), F.count_distinct("event_id").alias("delivered_ids"))


def violations(phased_rows: DataFrame, checkpoint: int | Column, runs: Sequence[str] = ()) -> DataFrame:
    return phased_rows.groupBy(*runs).agg(*violation_counts(checkpoint))


def violation_counts(checkpoint: int | Column) -> list[Column]:
    bad, attempt = F.col("regressed"), F.col("phase") == "attempt"
    return [F.count_if(bad & attempt).alias("attempted"), F.count_if(bad & attempt & (F.col("q") < checkpoint)).alias("committed_prefix"), F.count_if(bad & ~attempt).alias("recovered")]


def final_state(decided: DataFrame, runs: Sequence[str] = ()) -> DataFrame:
    return decided.where("decision = 'applied'").groupBy(*runs, "key").agg(F.max_by(F.struct(*PAYLOAD[1:]), "q").alias("r_")).select(*runs, "key", "r_.*")
