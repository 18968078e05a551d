import itertools
import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions.text import count_for, stripped
from tidemark.operators import cdc, checks, controls, ledger, state
from tidemark.sources import strict_csv

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


def cells(rows):
    return sorted(str(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == names
    assert cells(map(tuple, df.select(*names).collect())) == cells(want.select(*(f'"{n}"' for n in names)).fetchall())


def frame(spark, rows, spec):
    return spark.createDataFrame(rows, spec)


def test_duplicate_keys(spark):
    df = frame(spark, [("a", "true"), ("a", "true"), ("", "false")], "id string, is_current string")
    r = checks.duplicate_keys(df, ["id"]).first()
    assert (r.passed, r.duplicate_groups, r.duplicate_rows, r.excess_rows, r.null_key_rows_excluded, r.invalid_key_rows, r.selected_rows) == (False, 1, 2, 1, 1, 1, 3)
    r = checks.duplicate_current(df, ["id"], "is_current").first()
    assert (r.selected_rows, r.null_key_rows_excluded, r.invalid_key_rows) == (2, 0, 1)
    two = frame(spark, [("x", "1"), ("x", "2"), ("x", "1"), ("", "1")], "a string, b string")
    r = checks.duplicate_keys(two, ["a", "b"]).first()
    assert (r.duplicate_groups, r.duplicate_rows, r.excess_rows, r.null_key_rows_excluded) == (1, 2, 1, 1)
    blank = frame(spark, [("x", "1"), (" ", "2")], "id string, n string")
    assert checks.duplicate_keys(blank, ["id"]).first().passed and not checks.duplicate_keys(blank, ["id"], strict=True).first().passed
    assert not checks.duplicate_keys(df.where("false"), ["id"]).first().passed
    with pytest.raises(checks.CheckError):
        checks.duplicate_keys(df, [])
    with pytest.raises(checks.CheckError):
        checks.duplicate_keys(df, ["id", "id"])


def test_current_flags(spark):
    for flags, ok in ((["true", "false"], True), (["true", "1"], False)):
        assert checks.duplicate_current(frame(spark, [("a", f, i) for i, f in enumerate(flags)], "a string, c string, n long"), ["a"], "c", row_no="n").first().passed == ok
    with pytest.raises(checks.CheckError, match="data row 2"):
        checks.duplicate_current(frame(spark, [("a", "true", 1), ("a", "yes", 2)], "a string, c string, n long"), ["a"], "c", row_no="n")


def test_null_keys(spark):
    df = frame(spark, [("  ", i) for i in range(1, 31)], "id string, n long")
    assert checks.null_keys(df, ["id"]).first().invalid_rows == 30
    assert [r[0] for r in checks.null_key_sample(df, ["id"], "n").collect()] == list(range(1, 21))


def test_freshness(spark):
    df = frame(spark, [("2026-01-01T01:00:00+01:00", 1)], "ts string, n long")
    for now, ok in (("2026-01-01 01:00:00", True), ("2026-01-01 01:00:01", False), ("2025-12-31 23:59:59", False)):
        assert checks.freshness(df, "ts", 3600, F.lit(now).cast("timestamp"), "n").first().passed == ok
    for bad in ("", "garbage", "2026-01-01", "2026-13-01T00:00:00Z", "2026-01-01T00:00:00"):
        with pytest.raises(checks.CheckError, match="data row 1"):
            checks.freshness(frame(spark, [(bad, 1)], "ts string, n long"), "ts", 1, F.lit("2026-01-01").cast("timestamp"), "n")
    for limit in (-1, float("nan"), float("inf"), None):
        with pytest.raises(checks.CheckError):
            checks.freshness(df, "ts", limit, F.lit("2026-01-01").cast("timestamp"))


def test_controls(spark):
    df = frame(spark, [("a", 1), ("b", 2), ("a", 3), (None, 4), (None, 5), ("", 6), ("", 7)], "id string, n long")
    assert sorted(r.n for r in controls.dedup_first(df, "id", "n").collect()) == [1, 2, 4, 5, 6]
    assert tuple(controls.dedup_count(df, "id").first()) == (7, 5, 2)
    assert sorted(r[0] for r in controls.invalid_keys(df, "id", "n").collect()) == [4, 5, 6, 7]
    start = datetime(2026, 1, 1, tzinfo=timezone.utc)
    end = start + timedelta(hours=1)
    times = frame(spark, [(start,), (end - timedelta(seconds=1),), (end,)], "ts timestamp")
    assert controls.backfill_window(times, "ts", start, end).count() == 2
    for a, b in ((start, start), (datetime(2026, 1, 1), datetime(2026, 1, 2))):
        with pytest.raises(ValueError):
            controls.backfill_window(times, "ts", a, b)
    with pytest.raises(ValueError):
        controls.audit_record("p", "r", "DONE", 1)
    window = controls.backfill_window(spark.read.parquet(f"{SF}/events.parquet"), "ts", datetime(2024, 1, 2), datetime(2024, 1, 5))
    assert "GreaterThanOrEqual(ts" in window._jdf.queryExecution().executedPlan().toString()


EVENTS = "q long, event_id string, key string, version long, value string, deleted boolean"


def test_orders_don_t_matter_to_versions(spark):
    base = [("a", "x", 1, "first", False), ("c", "x", 3, "again", False), ("b", "x", 2, "gone", True)]
    for order in itertools.permutations(base):
        df = frame(spark, [(i, *e) for i, e in enumerate(order)], EVENTS)
        assert tuple(cdc.final_state(cdc.decisions(df, "version")).first()) == ("x", 3, "again", False)


def test_bounded_and_closed_form_agree(spark):
    import random

    for seed in range(4):
        r = random.Random(seed)
        rows = [(q, f"e{r.randrange(14)}", f"k{r.randrange(3)}", r.randint(1, 4), "v", False) for q in range(24)]
        first = {}
        rows = [(q, e, *first.setdefault(e, (k, v, x, d)))[:6] for q, e, k, v, x, d in rows]
        df = frame(spark, rows, EVENTS)
        for strategy in cdc.STRATEGIES:
            runs = df.withColumns({"run_id": F.lit("1"), "strategy": F.lit(strategy), "capacity": F.lit(None).cast("long")})
            want = {x.q: x.decision for x in ledger.replay_bounded(runs).collect()}
            assert {x.q: x.decision for x in cdc.decisions(df, strategy).collect()} == want


def test_phases_and_violations(spark):
    df = frame(spark, [(0, "a", "x", 4, "n", False), (1, "b", "x", 3, "o", True)], EVENTS)
    rows = cdc.phased(cdc.decisions(df, "arrival"), 2, 1, 2)
    assert tuple(cdc.violations(rows, 1).first()) == (1, 0, 1)
    with pytest.raises(ValueError):
        cdc.phased(rows, 2, 3, 2)
    oracle = frame(spark, [("x", 4, "n", False), ("y", 1, "m", False)], "key string, version long, value string, deleted boolean")
    assert {tuple(r) for r in state.diff(cdc.final_state(cdc.decisions(df, "arrival")), oracle).collect()} == {("x", "stale version"), ("y", "missing key")}


def test_invalid_events(spark):
    bad = [(0, "", "k", 1, "v", False), (1, "a", None, 1, "v", False), (2, "b", "k", 0, "v", False), (3, "c", "k", 1, None, False), (4, "d", "k", 1, "v", None), (5, "e", "k", 1, "v", True)]
    assert sorted(r.q for r in cdc.invalid_events(frame(spark, bad, EVENTS)).collect()) == [0, 1, 2, 3, 4]


def test_ledger_probe(spark):
    got = {r.run_id: r for r in catalog.QUERIES["ledger_fifo_probe"](spark, SF).collect()}
    detects = lambda order: {c for c in ("0", "4", "16", "all") if got[f"version/{c}/{order}"].conflicts}
    assert len(got) == 24 and detects("conflict_first") == {"all"} and detects("exact_then_conflict") == {"4", "16", "all"}


def test_strict_csv(spark, tmp_path):
    strict_csv.register(spark)
    read = lambda text, **o: (tmp_path / "x.csv").write_bytes(text.encode()) and spark.read.format("strict_csv").options(**o).load(str(tmp_path / "x.csv"))
    assert [tuple(r) for r in read('﻿id,t\na,"1,2"\n\n,x\n', required="id").collect()] == [("a", "1,2", 1), ("", "x", 2)]
    assert read("id,t\n").count() == 0
    for bad in ("id,id\na,b\n", "id,t\na\n", "id,t\na,b,c\n", 'id,t\n"a,b\n', ",t\na,b\n", "id\na\n"):
        with pytest.raises(Exception):
            read(bad, required="t").collect()


def test_functions(spark):
    assert spark.createDataFrame([("\x1c\t a b　\n",)], "s string").select(stripped(F.col("s"))).first()[0] == "a b"
    got = spark.range(1).select(count_for(F.lit(5), 0.5), count_for(F.lit(7), 0.5), count_for(F.lit(3), 0.01), count_for(F.lit(3), 0), count_for(F.lit(0), 0.5)).first()
    assert tuple(got) == (2, 4, 1, 0, 0)


def test_replays_of_committed_events(spark):
    """The check of committed ids drops replays of those only; without it they are processed again; other replays go the ordinary way."""
    from tidemark.plans import compositions

    spec = "event_id long, entity_id long, business_key string, event_ts timestamp, value long, arrival_seq long, fault_tags array<string>, is_recovery_replay boolean"
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    event = lambda i, seq, key="k", replay=False: (i, i % 2, key, at, i, seq, [], replay)
    committed = spark.createDataFrame([event(1, 1), event(2, 2)], spec)
    replays = spark.createDataFrame([event(1, 10, replay=True), event(2, 11, replay=True), event(3, 12, replay=True), event(3, 13, replay=True), event(4, 14, None, True)], spec)
    rest = spark.createDataFrame([event(2, 20), event(3, 21), event(5, 22), event(5, 23), event(6, 24, None)], spec)
    taken = lambda idempotent: sorted((r.event_id, r.arrival_seq) for r in compositions.restarted(replays, rest, committed, idempotent).collect())
    assert taken(True) == [(3, 12), (5, 22)]
    assert taken(False) == [(1, 10), (2, 11), (3, 12), (5, 22)]
    assert sorted(r.event_id for r in compositions.suppressed(replays, committed).collect()) == [3, 3, 4]


def test_compositions_of_an_empty_stream(spark, tmp_path):
    from tidemark import catalog

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("false").write.parquet(f"{tmp_path}/events.parquet")
    for name in ("pipeline_S1_state", "cdc_phase_counters", "recovery_replay_suppress"):
        assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 0
    row = catalog.QUERIES["pipeline_S4_metrics"](spark, str(tmp_path)).first()
    assert row.oracle_entities == row.already_committed_replay_count == 0 and row.state_correctness_rate == 0
