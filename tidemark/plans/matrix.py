"""Suites 4 and 5: every cell of a matrix and all four compositions in one job.

The compositions differ only in which of three states an entity ends with and in whether replayed events count again,
so each stream is folded once by entity and once by event, and the compositions branch on one row a cell at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import generators
from ..sources.generators import CELL_KEY, SEEDS, SIZES
from ..storage import materialize
from .compositions import COMPOSITIONS, SIGNATURE

# Fixed values.
INTENSITIES = (0.01, 0.05, 0.10)
CONTROL_FAULTS = ("duplicate", "null_key", "late", "conflict", "recovery")
CONTROL_INTENSITY = 0.05
CHECKPOINT, REPLAY = 0.50, 0.50
NAMES = {"S1": "S1_minimal", "S2": "S2_temporal", "S3": "S3_recovery", "S4": "S4_full"}
RATES = ["state_correctness_rate", "duplicate_leakage_rate", "invalid_key_leakage_rate", "stale_state_rate", "recovery_completeness_rate", "false_rejection_rate"]
ONCE = ["suite", "dataset_size", "seed"]


def grid(suite: int, sizes=SIZES, seeds=None, intensities=INTENSITIES, controls=CONTROL_FAULTS) -> list[tuple]:
    """Cells of the principal matrix and of the single-fault controls."""
    out = []
    for n in sizes:
        for seed in seeds or SEEDS[suite]:
            out += [(suite, "principal", "compound", n, seed, float(x), *[float(x)] * 4) for x in intensities]
            out += [(suite, "single_fault_control", f, n, seed, REPLAY if f == "recovery" else CONTROL_INTENSITY, *(CONTROL_INTENSITY if f == g else 0.0 for g in CONTROL_FAULTS[:4])) for f in controls]
    return out


def recovers():
    return F.col("fault").isin("compound", "recovery")


def selected(total, rate):
    return F.when(total > 0, F.least(total, F.greatest(F.lit(1), F.bround(total * F.lit(rate)).cast("long")))).otherwise(0)


def place(seq, side: int, nth):
    return F.struct(F.coalesce(seq, F.lit(0)).cast("long").alias("seq"), F.lit(side).alias("side"), nth.cast("long").alias("nth"))


def oracle(spark: SparkSession, rows: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """Expected ids and final states, from streams without faults."""
    once = {(r[0], r[3], r[4]): r for r in rows}
    clean = generators.generate(spark, list(once.values()), faulted=False).select(*ONCE, "event_id", "entity_id", "business_key", "event_ts", "value", "arrival_seq")
    order = F.struct("event_ts", -F.col("arrival_seq"))
    return clean.select(*ONCE, "event_id"), clean.groupBy(*ONCE, "entity_id").agg(F.max_by(F.struct(*SIGNATURE), order).alias("expected"))


def accepted_rows(stream: DataFrame) -> DataFrame:
    """Suite 5: rows with a key, first of their id, and replays of committed ones (seq between the two sides)."""
    first = stream.where("business_key is not null").groupBy(*CELL_KEY, "event_id").agg(F.min_by(F.struct("arrival_seq", "total", "entity_id", "business_key", "event_ts", "value"), "arrival_seq").alias("r")).select(*CELL_KEY, "event_id", "r.*")
    cut = F.least(F.col("total"), F.greatest(F.lit(1), F.bround(F.col("total") * CHECKPOINT).cast("long")))
    committed = recovers() & (F.col("arrival_seq") < cut)
    by_id = Window.partitionBy(*CELL_KEY, "committed")
    ranked = first.withColumn("committed", committed).withColumn("nth", F.row_number().over(by_id.orderBy("event_id"))).withColumn("all", F.count("*").over(by_id))
    again = F.col("committed") & (F.col("nth") <= selected(F.col("all"), REPLAY))
    # replays come right after the checkpoint, in order of their ids
    return ranked.withColumn("again", again).withColumn("again_at", F.when(again, place(cut, 0, F.col("nth")))).withColumn("at", place(F.col("arrival_seq"), 1, F.lit(0)))


def observe_recovery(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Suite 5: one row for each cell and composition."""
    stream = generators.generate(spark, rows)
    accepted = accepted_rows(stream)
    ids, expected = oracle(spark, rows)
    # cells of one key have the same oracle; the list of cells is as long as the matrix
    listed = F.broadcast(spark.createDataFrame([r[:6] for r in rows], generators.KEYED))
    states = accepted.groupBy(*CELL_KEY, "entity_id").agg(
        F.max_by(F.struct(*SIGNATURE), F.struct("event_ts", -F.col("arrival_seq"))).alias("by_time"),
        F.max_by(F.struct(*SIGNATURE), "at").alias("by_arrival"),
        F.max_by(F.struct(*SIGNATURE), F.greatest("at", "again_at")).alias("by_arrival_again"),
    )
    met = expected.join(listed, ONCE).join(states, [*CELL_KEY, "entity_id"], "left")
    hits = met.groupBy(*CELL_KEY).agg(F.count("*").alias("oracle_entities"), *(F.count_if(F.col(c).isNotNull() & F.col(c).eqNullSafe(F.col("expected"))).alias(c) for c in ("by_time", "by_arrival", "by_arrival_again")))
    found = ids.join(listed, ONCE).join(accepted.select(*CELL_KEY, "event_id", "again"), [*CELL_KEY, "event_id"], "left")
    kept = found.groupBy(*CELL_KEY).agg(F.count("*").alias("recovery_denominator"), F.count("again").alias("recovered_expected_count"), F.count_if("again").alias("again_expected"))
    taken = accepted.groupBy(*CELL_KEY).agg(F.count("*").alias("accepted_"), F.count_if("again").alias("already_committed_replay_count"))
    has = lambda t: F.count_if(F.array_contains("fault_tags", t))
    put = stream.groupBy(*CELL_KEY).agg(has("duplicate").alias("duplicate"), F.count_distinct(F.when(F.array_contains("fault_tags", "null_key"), F.col("event_id"))).alias("null_key"), F.count_distinct(F.when(F.array_contains("fault_tags", "late"), F.col("event_id"))).alias("late"), F.count_distinct(F.when(F.array_contains("fault_tags", "conflict"), F.col("event_id"))).alias("conflict"), F.count("business_key").alias("keyed_"), F.count_if(F.col("business_key").isNull()).alias("voids_"))
    one = hits.join(kept, CELL_KEY).join(taken, CELL_KEY).join(put, CELL_KEY)
    return scored(branched(one))


def branched(one: DataFrame) -> DataFrame:
    """A row for each composition."""
    specs = F.explode(F.array(*(F.struct(F.lit(NAMES[k]).alias("strategy"), F.lit(s.temporal).alias("temporal"), F.lit(s.idempotent).alias("idempotent")) for k, s in COMPOSITIONS.items())))
    return one.select("*", specs.alias("spec")).select(*one.columns, "spec.*")


def rate(top: str, bottom: str):
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def scored(rows: DataFrame) -> DataFrame:
    c, zero = F.col, F.lit(0).cast("long")
    again = F.when(c("idempotent"), zero).otherwise(c("already_committed_replay_count"))
    matching = F.when(c("temporal"), c("by_time")).when(c("idempotent"), c("by_arrival")).otherwise(c("by_arrival_again"))
    suppressed = c("already_committed_replay_count") - again
    facts = rows.select(
        *CELL_KEY, "strategy", "oracle_entities", matching.alias("entities_matching_oracle"), (c("oracle_entities") - matching).alias("stale_state_count"),
        F.when(c("idempotent"), zero).otherwise(c("again_expected")).alias("duplicate_leakage_count"), (c("duplicate") + c("already_committed_replay_count")).alias("duplicate_denominator"),
        zero.alias("invalid_key_leakage_count"), c("null_key").alias("invalid_key_denominator"), "recovered_expected_count", "recovery_denominator", (c("recovery_denominator") - c("recovered_expected_count")).alias("false_rejection_count"),
        "already_committed_replay_count", again.alias("recovery_replays_reprocessed"), suppressed.alias("recovery_replays_suppressed"),
        c("duplicate").alias("duplicate_faults_injected"), (c("keyed_") - c("accepted_")).alias("duplicate_faults_recognized"), (c("keyed_") - c("accepted_")).alias("duplicate_faults_contained"),
        c("null_key").alias("null_key_faults_injected"), c("voids_").alias("null_key_faults_recognized"), c("voids_").alias("null_key_faults_contained"),
        c("late").alias("late_faults_injected"), zero.alias("late_faults_recognized"), zero.alias("late_faults_contained"),
        c("conflict").alias("conflict_faults_injected"), zero.alias("conflict_faults_recognized"), zero.alias("conflict_faults_contained"),
        c("already_committed_replay_count").alias("recovery_faults_injected"), c("already_committed_replay_count").alias("recovery_faults_recognized"), suppressed.alias("recovery_faults_contained"),
    )
    tops = dict(zip(RATES, [("entities_matching_oracle", "oracle_entities"), ("duplicate_leakage_count", "duplicate_denominator"), ("invalid_key_leakage_count", "invalid_key_denominator"), ("stale_state_count", "oracle_entities"), ("recovered_expected_count", "recovery_denominator"), ("false_rejection_count", "recovery_denominator")]))
    return facts.withColumns({**{k: rate(*v) for k, v in tops.items()}, "recovery_duplicate_effect_rate": rate("recovery_replays_reprocessed", "already_committed_replay_count")})


def observe_prefix(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Suite 4: a prefix of the stream is replayed ahead of it; ids are judged before keys."""
    stream = generators.generate(spark, rows).drop("suite").withColumn("suite", F.lit(4))
    cut = F.greatest(F.lit(1), F.floor(F.col("total") * CHECKPOINT))
    replays = stream.where(recovers() & (F.col("arrival_seq") < F.greatest(F.lit(1), F.floor(cut * REPLAY)))).withColumn("replay", F.lit(True)).withColumn("arrival_seq", F.col("arrival_seq") - F.col("total"))
    work = stream.withColumn("replay", F.lit(False)).unionByName(replays)
    # a composition without idempotent recovery takes every replayed copy, whatever it has seen
    first = Window.partitionBy(*CELL_KEY, "event_id").orderBy("arrival_seq")
    seen = work.withColumn("fresh", F.row_number().over(first) == 1).withColumn("always", F.col("fresh") | F.col("replay"))
    # written once: each fold of it is a job of its own, and the driver never plans them all together
    seen = materialize(seen, "suite-4-seen")
    put = seen.groupBy(*CELL_KEY).agg(
        F.count_if(F.array_contains("fault_tags", "duplicate") & ~F.col("replay")).alias("duplicate"),
        *(F.count_distinct(F.when(F.array_contains("fault_tags", t), F.col("event_id"))).alias(t) for t in ("null_key", "late", "conflict")),
        *(F.count_if(F.array_contains("fault_tags", t)).alias(f"{t}_rows") for t in ("late", "conflict")),
        F.count_if("replay").alias("replays"), F.count_if(~F.col("fresh")).alias("dropped_fresh"), F.count_if(~F.col("always")).alias("dropped_always"), F.count_if(F.col("replay") & ~F.col("fresh")).alias("replay_dropped"),
        F.count_if(F.col("fresh") & F.col("business_key").isNull()).alias("void_fresh"), F.count_if(F.col("always") & F.col("business_key").isNull()).alias("void_always"),
    )
    ids, expected = oracle(spark, rows)
    listed = F.broadcast(spark.createDataFrame([r[:6] for r in rows], generators.KEYED))
    valid = seen.where("business_key is not null and always")
    pair = F.struct("event_id", "value")
    order = F.struct("event_ts", "event_id", -F.col("arrival_seq"))
    only = lambda o: F.when(F.col("fresh"), o)
    states = valid.groupBy(*CELL_KEY, "entity_id").agg(F.max_by(pair, order).alias("time_always"), F.max_by(pair, only(order)).alias("time_fresh"), F.max_by(pair, "arrival_seq").alias("seq_always"), F.max_by(pair, only(F.col("arrival_seq"))).alias("seq_fresh"))
    want = F.struct(F.col("expected.event_id"), F.col("expected.value"))
    met = expected.join(listed, ONCE).join(states, [*CELL_KEY, "entity_id"], "left").withColumn("want", want)
    ends = ("time_always", "time_fresh", "seq_always", "seq_fresh")
    hits = met.groupBy(*CELL_KEY).agg(F.count("*").alias("oracle_entities"), *(F.count_if(F.col(e) == F.col("want")).alias(e) for e in ends), *(F.count_if(F.col(e) != F.col("want")).alias(f"{e}_stale") for e in ends))
    times = valid.groupBy(*CELL_KEY, "event_id").agg(F.count("*").alias("n_always"), F.count_if("fresh").alias("n_fresh"))
    found = ids.join(listed, ONCE).join(times, [*CELL_KEY, "event_id"], "left").groupBy(*CELL_KEY).agg(F.count("*").alias("recovery_denominator"), *(x for k in ("always", "fresh") for x in (F.count_if(F.col(f"n_{k}") > 0).alias(f"recovered_{k}"), F.coalesce(F.sum(F.greatest(F.col(f"n_{k}") - 1, F.lit(0))), F.lit(0)).alias(f"leaked_{k}"))))
    hits, found, put = (materialize(x, f"suite-4-{name}") for name, x in (("hits", hits), ("found", found), ("put", put)))
    one = branched(hits.join(found, CELL_KEY).join(put, CELL_KEY))
    c = F.col
    by = lambda name: F.when(c("idempotent"), c(f"{name}_fresh")).otherwise(c(f"{name}_always"))
    end = lambda tail: F.when(c("temporal"), F.when(c("idempotent"), c(f"time_fresh{tail}")).otherwise(c(f"time_always{tail}"))).otherwise(F.when(c("idempotent"), c(f"seq_fresh{tail}")).otherwise(c(f"seq_always{tail}")))
    least = lambda a, b: F.least(c(a), b)
    detected = least("duplicate", by("dropped")) + least("null_key", by("void")) + least("replays", F.when(c("idempotent"), c("replay_dropped")).otherwise(0))
    detected += F.when(c("temporal"), least("late", c("late_rows")) + least("conflict", c("conflict_rows"))).otherwise(0)
    facts = one.select(
        *CELL_KEY, "strategy", *(c(t).alias(f"realized_{t}") for t in ("duplicate", "null_key", "late", "conflict")), c("replays").alias("realized_recovery_replay"), "oracle_entities", end("").alias("entities_matching_oracle"),
        by("leaked").alias("duplicate_leakage_count"), F.lit(0).cast("long").alias("invalid_key_leakage_count"), c("null_key").alias("invalid_key_denominator"), end("_stale").alias("stale_state_count"), by("recovered").alias("recovered_expected_count"), "recovery_denominator",
        (c("recovery_denominator") - by("recovered")).alias("false_rejection_count"), (c("duplicate") + c("null_key") + c("late") + c("conflict") + c("replays")).alias("faults_injected"), detected.alias("faults_detected"),
    )
    tops = {"state_correctness_rate": ("entities_matching_oracle", "oracle_entities"), "duplicate_leakage_rate": ("duplicate_leakage_count", "recovery_denominator"), "invalid_key_leakage_rate": ("invalid_key_leakage_count", "invalid_key_denominator"), "stale_state_rate": ("stale_state_count", "oracle_entities"), "recovery_completeness_rate": ("recovered_expected_count", "recovery_denominator"), "false_rejection_rate": ("false_rejection_count", "recovery_denominator"), "fault_detection_recall": ("faults_detected", "faults_injected")}
    return facts.withColumns({k: F.round(rate(*v), 9) for k, v in tops.items()})


def summary(observations: DataFrame) -> DataFrame:
    """Means and medians over the seeds of each configuration."""
    rates = [c for c in observations.columns if c.endswith("_rate") or c == "fault_detection_recall"]
    stats = [x for c in rates for x in (F.avg(c).alias(f"{c}_mean"), F.median(c).alias(f"{c}_median"))]
    return observations.groupBy("kind", "fault", "dataset_size", "intensity", "strategy").agg(F.count("*").alias("observations"), *stats)


def broken(observations: DataFrame, cells: int) -> DataFrame:
    """What makes a run invalid: a row for each wrong count, repeated cell or rate outside 0 to 1."""
    rates = [c for c in observations.columns if c.endswith("_rate")]
    outside = F.lit(False)
    for r in rates:
        outside = outside | ~F.col(r).between(0, 1)
    seen = observations.agg(F.count("*").alias("rows"), F.count_distinct(*CELL_KEY, "strategy").alias("cells"), F.count_if(F.coalesce(outside, F.lit(True))).alias("outside"))
    rules = F.array(F.when(F.col("rows") != 4 * cells, F.lit("row count")), F.when(F.col("cells") != F.col("rows"), F.lit("repeated cell")), F.when(F.col("outside") > 0, F.lit("rate outside 0 to 1")))
    return seen.select(F.explode(F.array_compact(rules)).alias("rule"), "rows", "cells", "outside")
