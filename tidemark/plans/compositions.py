"""Control compositions S1 to S4 over a faulted stream, with recovery at a checkpoint, and their scores.

All compositions drop events without a business key and repeated ids. S2 and S4 resolve states by event time, the
others by arrival; S3 and S4 suppress replays of committed events, the others process them again.

With a checkpoint a run has two stages. The first accepts the events before it and commits their ids. After it the
source sends committed events again, marked as replays, and then the rest: a replay of a committed id is dropped (S3, S4)
or processed again without a look at the ids seen; everything else is checked against the committed ids and deduplicated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.faults import tagged
from ..operators.state import TIES, last_arrival, latest_event_time
from ..storage import materialize


@dataclass(frozen=True)
class Composition:
    temporal: bool
    idempotent: bool


COMPOSITIONS = {"S1": Composition(False, False), "S2": Composition(True, False), "S3": Composition(False, True), "S4": Composition(True, True)}
SIGNATURE = ["event_id", "business_key", "event_ts", "value"]
#: Arrival numbers of replays and of what follows them lie this far after those before the checkpoint.
STEP = 10**14


def accepted(rows: DataFrame) -> DataFrame:
    """The first event of each id among those with a business key; rows of an id are folded in the tasks that read them."""
    rest = [c for c in rows.columns if c != "event_id"]
    first = rows.where("business_key is not null").groupBy("event_id").agg(F.min_by(F.struct(*rest), "arrival_seq").alias("r_"))
    return first.select("event_id", "r_.*").select(*rows.columns)


def staged(faulted: DataFrame, before: Column) -> DataFrame:
    """For each id its first event with a business key before the checkpoint (`early`) and after it (`late`), and how many
    of its deliveries are tagged as duplicates and as without a key. One pass and one shuffle."""
    rest = [c for c in faulted.columns if c != "event_id"]
    keyed = F.col("business_key").isNotNull()
    first = lambda stage: F.min_by(F.when(keyed & stage, F.struct(*rest)), F.when(keyed & stage, F.col("arrival_seq")))
    tags = lambda tag: F.count_if(F.array_contains("fault_tags", tag))
    return faulted.groupBy("event_id").agg(first(before).alias("early"), first(~before).alias("late"), tags("duplicate").alias("duplicates"), tags("null_key").alias("nulls"))


def replays_of(committed: DataFrame, replayed: Column) -> DataFrame:
    """Committed events that the source sends again after the checkpoint."""
    again = committed.where(replayed).withColumns({"is_recovery_replay": F.lit(True), "fault_tags": tagged("recovery_replay")})
    return again.withColumn("arrival_seq", F.col("arrival_seq") + STEP)


def suppressed(replays: DataFrame, committed: DataFrame) -> DataFrame:
    """Replays less those whose id is committed."""
    return replays.join(committed.select("event_id"), "event_id", "left_anti").select(*replays.columns)


def restarted(replays: DataFrame, rest: DataFrame, committed: DataFrame, idempotent: bool) -> DataFrame:
    """What is processed after the checkpoint, of the replays and the rest of the stream."""
    ids = committed.select("event_id")
    fresh = accepted(suppressed(replays, committed).unionByName(rest)).join(ids, "event_id", "left_anti").select(*rest.columns)
    return fresh if idempotent else fresh.unionByName(replays.join(ids, "event_id", "left_semi").select(*rest.columns))


@dataclass(frozen=True)
class Run:
    processed: DataFrame
    committed: DataFrame
    replays: DataFrame
    facts: DataFrame


def run(faulted: DataFrame, name: str, before: Column, replayed: Column) -> Run:
    """The events that the composition processes, in their order, those committed at the checkpoint (`before` tells which
    events precede it), and the replays (of the committed events that `replayed` takes)."""
    facts = materialize(staged(faulted, before), "staged")
    stage = lambda c: facts.where(f"{c} is not null").select("event_id", f"{c}.*").select(*faulted.columns)
    committed = stage("early")
    replays = replays_of(committed, replayed)
    rest = stage("late").withColumn("arrival_seq", F.col("arrival_seq") + 2 * STEP)
    return Run(committed.unionByName(restarted(replays, rest, committed, COMPOSITIONS[name].idempotent)), committed, replays, facts)


def state(valid: DataFrame, name: str) -> DataFrame:
    return latest_event_time(valid) if COMPOSITIONS[name].temporal else last_arrival(valid)


def metrics(found: Run, canonical: DataFrame, name: str) -> DataFrame:
    """One row of counts and rates of a run against the oracle, which knows only the canonical events.

    Canonical events, processed events and replays of committed events meet in one shuffle by id, and what that leaves in
    one by entity. An event is its id and its entity.
    """
    c, total = F.col, lambda x: F.coalesce(F.sum(x), F.lit(0))
    at = TIES["first_arrival"]()
    order = at if COMPOSITIONS[name].temporal else F.struct("arrival_seq")
    part = lambda df, kind: df.select(*SIGNATURE, "entity_id", "arrival_seq", "is_recovery_replay", F.lit(kind).alias("part"))
    sent = found.replays.join(found.committed.select("event_id"), "event_id", "left_semi")
    met = part(canonical, "canonical").unionByName(part(found.processed, "ours")).unionByName(part(sent, "sent"))
    ours, own = c("part") == "ours", c("part") == "canonical"
    latest = lambda which, by: F.max(F.when(which, F.struct(by.alias("by"), F.struct(*SIGNATURE).alias("row"))))
    ids = met.groupBy("event_id", "entity_id").agg(
        latest(ours, order).alias("got"), latest(own, at).alias("want"), F.count_if(ours).alias("n"), F.count_if(own).alias("expected"), F.count_if(ours & c("business_key").isNull()).alias("leaks"),
        F.count_if(ours & c("is_recovery_replay")).alias("again"), F.count_if(c("part") == "sent").alias("sent"),
    )
    expected, flag = c("expected") > 0, lambda x: F.sum(x.cast("long"))
    entities = ids.groupBy("entity_id").agg(
        F.max("got").alias("got"), F.max("want").alias("want"), flag(expected).alias("asked"), flag(expected & (c("n") > 0)).alias("found"), flag(expected & (c("n") == 0)).alias("lost"),
        F.sum(F.when(expected, F.greatest(c("n") - 1, F.lit(0))).otherwise(0)).alias("extra"), F.sum("leaks").alias("leaks"), F.sum("sent").alias("sent"), F.sum(F.when(c("sent") > 0, c("again")).otherwise(0)).alias("again"),
    )
    one = entities.agg(
        F.count("want").alias("oracle_entities"), F.count_if(c("want").isNotNull() & c("got.row").eqNullSafe(c("want.row"))).alias("entities_matching_oracle"),
        total("asked").alias("recovery_denominator"), total("found").alias("recovered_expected_count"), total("lost").alias("false_rejection_count"),
        total("extra").alias("duplicate_leakage_count"), total("leaks").alias("invalid_key_leakage_count"), total("sent").alias("replays_"), total("again").alias("again_"),
    )
    faults = found.facts.agg(total("duplicates").alias("duplicates_"), total("nulls").alias("nulls_"))
    one = one.join(F.broadcast(faults), F.lit(True))  # one row each
    rate = lambda a, b: F.round(a / F.greatest(b, F.lit(1)), 9)
    return one.select(
        F.lit(name).alias("strategy"), "oracle_entities", "entities_matching_oracle", (c("oracle_entities") - c("entities_matching_oracle")).alias("stale_state_count"),
        "duplicate_leakage_count", "invalid_key_leakage_count", "recovered_expected_count", "recovery_denominator", "false_rejection_count", c("replays_").alias("already_committed_replay_count"),
        c("again_").alias("recovery_replays_reprocessed"), (c("replays_") - c("again_")).alias("recovery_replays_suppressed"),
        rate(c("entities_matching_oracle"), c("oracle_entities")).alias("state_correctness_rate"), rate(c("duplicate_leakage_count"), c("duplicates_") + c("replays_")).alias("duplicate_leakage_rate"),
        rate(c("invalid_key_leakage_count"), c("nulls_")).alias("invalid_key_leakage_rate"), rate(c("recovered_expected_count"), c("recovery_denominator")).alias("recovery_completeness_rate"),
        rate(c("false_rejection_count"), c("recovery_denominator")).alias("false_rejection_rate"), rate(c("again_"), c("replays_")).alias("recovery_duplicate_effect_rate"),
    )
