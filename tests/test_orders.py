"""Positions, samples, splits, ISO-8601 forms and rules of change events against plain Python."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import instant, isoformat
from tidemark.operators import cdc, faults, ordering, state


def marks(keys, seed):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))


def test_positions(spark):
    df = spark.range(0, 997).select((F.col("id") * 7 % 997).alias("k"))
    placed = {r.k: r.position for r in ordering.numbered(df, F.col("k").desc()).collect()}
    assert placed == {k: 996 - k for k in range(997)}
    order = [r.k for r in ordering.shuffled(df, "k", 3).orderBy("position").collect()]
    assert order == marks(range(997), 3)
    assert ordering.numbered(df.where("false"), "k").count() == 0


@pytest.mark.parametrize("rate", [0.0001, 0.05, 0.5, 1.0, 2.0])
def test_sample_is_the_head_of_the_shuffle(spark, rate):
    df = spark.range(500).select(F.when(F.col("id") != 499, F.col("id")).alias("k"))  # one row without a key
    n = min(499, max(1, round(499 * rate)))
    assert sorted(r.k for r in ordering.sampled(df, "k", rate, 5).collect()) == sorted(marks(range(499), 5)[:n])


def test_split_and_alignment(spark):
    df = spark.range(10).select("id")
    assert [r.id for r in ordering.split(df, 0.25, "id").where("prefix").orderBy("id").collect()] == [0, 1]  # halves go to the even neighbour
    assert ordering.split(df, 0.01, "id").where("prefix").count() == 1 and ordering.split(df.where("false"), 0.5, "id").count() == 0
    met = {r.position: (r.left and r.left.id, r.right and r.right.id) for r in ordering.aligned(df, df.where("id < 3"), [F.col("id").desc()], ["id"]).collect()}
    assert met == {n: (9 - n, n if n < 3 else None) for n in range(10)}


def test_chosen_rows(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "event_id long")
    assert {r.event_id: r.chosen for r in faults.chosen(df, df.where("event_id = 2")).collect()} == {1: False, 2: True, None: False}


def test_instants(spark):
    texts = [d + s + t + z for d in ("2024-02-29", "20240229") for s in "T " for t in ("07", "07:08", "0708", "07:08:09", "070809", "07:08:09.5", "070809,123456789", "07:08:09.000000") for z in ("Z", "+00:00", "-0530", "+14", "")]
    texts += ["2024-02-30T00:00Z", "2024-0229T00:00Z", "2024-02-29T7:08Z", "2024-02-29", "x", "", None, "2024-02-29T24:01Z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.unix_micros(instant("t")).alias("us"), isoformat("t").alias("iso")).collect()
    for r in rows:
        try:
            want = datetime.fromisoformat(r.t.replace("Z", "+00:00"))
            want = want if want.tzinfo else None
        except (ValueError, AttributeError):
            want = None
        if want is None:
            assert r.us is None and r.iso is None, r.t
        else:
            assert r.us == round(want.timestamp() * 1e6) and r.iso == want.isoformat(), r.t


EVENTS = "q long, event_id string, key string, version long, value string, deleted boolean"


def test_rules_of_change_events(spark):
    good = [(0, "a", "k", 1, "x", False), (1, "b", "k", 2, "y", True), (2, "a", "k", 1, "x", False)]
    make = lambda *rows: spark.createDataFrame([*good, *rows], EVENTS)
    cdc.validate(make())
    assert state.contradictions(make()).count() == 0
    for row, said in (((3, "", "k", 1, "x", False), "event 3: event_id"), ((3, "c", None, 1, "x", False), "event 3: key"), ((3, "c", "k", 0, "x", False), "event 3: version"), ((3, "c", "k", 3, None, False), "event 3: value"), ((3, "c", "k", 3, "x", None), "event 3: deleted"), ((3, "a", "other", 1, "x", False), "event_id a stands"), ((3, "c", "k", 2, "z", True), "key k, version 2 stands")):
        with pytest.raises(ValueError, match=said):
            cdc.validate(make(row))
    found = {(r.kind, r.name) for r in state.contradictions(make((3, "a", "other", 1, "x", False), (4, "c", "k", 2, "z", True))).collect()}
    assert found == {("event_id", "a"), ("version", "k/2")}


def test_counters_of_phases(spark):
    rows = spark.createDataFrame([(q, f"e{q}", "k", q + 1, "v", False) for q in range(6)], EVENTS)
    phased = cdc.phased(cdc.decisions(cdc.redelivered(rows, 6), "version"), 6, 2, 4)
    wide = {r.phase: (r.applied, r.duplicate, r.stale, r.conflict) for r in cdc.counters_wide(phased).collect()}
    assert wide == {"attempt": (4, 0, 0, 0), "restart": (4, 0, 0, 0), "redelivery": (0, 6, 0, 0)}
    assert tuple(cdc.recovery_counters(phased, 2, 4).first()) == (2, 2, 4, 6)
    assert {r.phase: r.applied for r in cdc.counters_wide(phased.where("false")).collect()} == dict.fromkeys(cdc.PHASES, 0)
