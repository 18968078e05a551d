"""Experiments, artifacts, command line and server."""

import json
import random
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from tidemark import artifacts, cli, server
from tidemark.plans import lab, matrix, suites
from tidemark.sources import generators


def test_generated_streams_repeat_and_hold_their_faults():
    a, b = (generators.compound(5, 400, 7, 0.05, 0.05, 0.05, 0.05) for _ in range(2))
    assert a.equals(b)
    tags = a.fault_tags.map(lambda t: ",".join(t))
    assert tags.str.contains("duplicate").sum() == generators.count_for(401, 0.05) == len(a) - 401
    assert a[tags.str.contains("late")].event_id.nunique() == 20 and a[a.business_key.isna()].event_id.nunique() == 20
    assert list(a[tags == "conflict"].value)[0] == -1
    assert generators.count_for(50, 0.05) == 2 and generators.count_for(5, 0.01) == 1 and generators.count_for(5, 0) == 0


def played(rows, temporal, idempotent):
    """Sequential model of suite 5 over a stream with recovery."""
    cut = min(len(rows), max(1, round(len(rows) / 2)))
    seen, valid = set(), []

    def take(r):
        if r["business_key"] is not None and r["event_id"] not in seen:
            seen.add(r["event_id"])
            valid.append(r)

    for r in rows[:cut]:
        take(r)
    by_id = {r["event_id"]: r for r in valid}
    again = [by_id[i] for i in sorted(by_id)[: generators.count_for(len(by_id), 0.5)]]
    if not idempotent:
        valid += again
    for r in rows[cut:]:
        take(r)
    state = {}
    for r in valid:
        old = state.get(r["entity_id"])
        if not temporal or old is None or r["event_ts"] > old["event_ts"]:
            state[r["entity_id"]] = r
    return state, valid, again


def test_suite_5_matches_a_sequential_model(spark):
    grid = matrix.grid(5, sizes=(300,), seeds=(3, 4), intensities=(0.1,), controls=("late", "recovery"))
    got = {(r.seed, r.fault, r.strategy): r for r in matrix.observe_recovery(spark, grid).collect()}
    assert len(got) == 4 * len(grid)
    for cell in grid:
        seed, fault = cell[4], cell[2]
        if fault == "late":
            continue
        rows = generators.compound(5, 300, seed, *cell[6:]).to_dict("records")
        clean = generators.compound(5, 300, seed, 0, 0, 0, 0).to_dict("records")
        want = {r["entity_id"]: r["event_id"] for r in clean}
        for name, spec in matrix.COMPOSITIONS.items():
            state, valid, again = played(rows, spec.temporal, spec.idempotent)
            r = got[seed, fault, matrix.NAMES[name]]
            right = sum(e in state and state[e]["event_id"] == i and state[e]["business_key"] is not None for e, i in want.items())
            assert r.entities_matching_oracle == right
            assert r.already_committed_replay_count == len(again)
            assert r.recovery_replays_reprocessed == (0 if spec.idempotent else len(again))
            assert r.recovered_expected_count == len({v["event_id"] for v in valid} & {c["event_id"] for c in clean})
    assert got[3, "late", "S2_temporal"].state_correctness_rate == 1 and got[3, "late", "S1_minimal"].state_correctness_rate < 1
    assert got[3, "recovery", "S1_minimal"].recovery_duplicate_effect_rate == 1 and got[3, "recovery", "S4_full"].recovery_duplicate_effect_rate == 0
    frame = spark.createDataFrame(list(got.values()))
    assert matrix.broken(frame, len(grid)).isEmpty() and matrix.broken(frame, len(grid) + 1).count() == 1


def test_suite_4_replays_ahead_of_the_stream(spark):
    grid = matrix.grid(4, sizes=(300,), seeds=(3,), intensities=(0.05,), controls=("duplicate", "recovery"))
    got = {(r.fault, r.strategy): r for r in matrix.observe_prefix(spark, grid).collect()}
    assert got["duplicate", "S1_minimal"].fault_detection_recall == 1
    assert got["recovery", "S1_minimal"].duplicate_leakage_count == 0  # replayed ahead, it can't be told apart
    assert got["compound", "S4_full"].false_rejection_count == 15
    assert got["compound", "S4_full"].state_correctness_rate >= got["compound", "S1_minimal"].state_correctness_rate


@pytest.mark.parametrize("suite,wrong", [(1, {"baseline"}), (2, {"append_replay_comparator"}), (3, {"arrival_order", "arrival_last_write", "append_replay"})])
def test_suites_controls_hold_and_comparators_fail(spark, suite, wrong):
    seen = suites.observe(spark, suites.grid(suite, sizes=(200,), seeds=(5, 6), rates=(0.05,))).collect()
    assert len(seen) == 2 * len(suites.outcomes(suite))
    for r in seen:
        assert r.correct == (r.strategy not in wrong), r


def test_smoke(spark):
    assert suites.smoke(spark) == {"input_rows": 3, "unique_rows": 2, "duplicate_events_detected": 1, "null_business_keys_detected": 1, "bounded_window_rows": 3}


def test_lab_matrix(spark):
    seen = lab.observe(spark, [(8, s, n) for s in (7, 17) for n in lab.SCENARIOS[:-1]])
    got = {r.strategy: r for r in lab.by_strategy(seen).collect()}
    assert {k: (r.correct, r.incorrect, r.rejected) for k, r in got.items()} == {"arrival": (8, 4, 4), "id_only": (10, 2, 4), "version": (12, 0, 4)}
    assert got["version"].recovered_violation_sum == 0 < got["id_only"].recovered_violation_sum < got["arrival"].recovered_violation_sum


def test_expiry_probe(spark):
    got = {(r.strategy, r.capacity, r.probe_order): r for r in lab.expiry_probe(spark, (7,)).collect()}
    assert len(got) == 24
    known, lost = got["version", None, "exact_then_conflict"], got["id_only", 4, "exact_then_conflict"]
    assert known.duplicate_recognized and known.conflict_detected and known.ledger_peak == 64
    assert not lost.duplicate_recognized and not lost.exact_replay_state_unchanged and lost.ledger_peak == 4


def test_evaluate(spark):
    r = lab.evaluate(spark, "stale_update", "arrival", checkpoint=1, interruption=3)
    assert r["state_correct"] is False and {w["reason"] for w in r["wrong_keys"]} == {"stale version"}
    assert r["lost_attempts"] == 2 and r["counters"]["attempt"]["applied"] == 3 and r["violations"]["recovered"] == 3
    assert [t["discarded_on_restore"] for t in r["trace"]][:3] == [False, True, True]
    assert json.dumps(r, allow_nan=False)
    r = lab.evaluate(spark, "post_recovery_redelivery", "version", checkpoint=2, interruption=5)
    assert r["state_correct"] and r["redelivery_state_unchanged"] and r["counters"]["redelivery"]["duplicate"] == 12
    r = lab.evaluate(spark, "conflicting_id", "version")
    assert r["input_rejected"] and not r["completed"] and r["state"] == {}
    r = lab.evaluate(spark, "conflicting_id", "version", validation="online", interruption=7)
    assert not r["completed"] and r["counters"]["attempt"]["conflict"] == 1 and r["restart_deliveries"] == r["lost_attempts"] == 0
    for bad in ({"keys": 0}, {"name": "none"}, {"ordering": "none"}, {"capacity": -1}, {"checkpoint": 3, "interruption": 1}, {"strategy": "none"}):
        with pytest.raises(ValueError):
            lab.evaluate(spark, **bad)


def test_workloads_are_permutations_with_faults():
    for name in lab.WORKLOADS:
        out, clean = lab.workload(name, 8, 7), lab.base(name, 8)
        assert len(out) >= len(clean) and set(clean) <= set(out)
    assert lab.placed("ordered", 3, 7, "reverse") == lab.placed("ordered", 3, 7)[::-1]
    assert sorted(lab.placed("stale_update", 4, 7)) == sorted(lab.base("stale_update", 4))


def test_demo(spark):
    for seed in random.Random(1).sample(range(100), 2):
        r = lab.demonstrate(spark, seed, 9, 4)["result"]
        assert r["passed"] and r["recovery"]["uncommitted_events_lost"] == 5 and sum(r["recovery_counts"].values()) == 12 + 16


def test_artifacts(spark, tmp_path):
    rows = [{"a": 1, "nested": {"y": None, "x": [1]}, "runtime_ms": 2.5}, {"a": None, "b": True}]
    make = lambda name, ms: artifacts.record(str(tmp_path / name), lambda: {"principal": [{**rows[0], "runtime_ms": ms}, rows[1]], "bounded": [{"c": 1}]}, seeds=[7])
    one, two = make("one", 1.0), make("two", 9.0)
    assert artifacts.compare(one, two, settings=["seeds"])["counts"] == {"principal": 2, "bounded": 1}
    with pytest.raises(FileExistsError):
        make("one", 1.0)
    (two / "principal.csv").write_text("changed")
    with pytest.raises(ValueError, match="hash mismatch: principal.csv"):
        artifacts.verify(two)
    with pytest.raises(ValueError, match="no observations"):
        artifacts.record(str(tmp_path / "none"), lambda: {"principal": []})
    assert "no observations" in (tmp_path / "none" / "failure.json").read_text()
    path = artifacts.summarize(str(tmp_path / "s"), "run", rows, [{"scenario": "x", "runs": 2}])
    done = json.loads(path.read_text())
    assert done["raw_sha256"] == artifacts.file_digest(tmp_path / "s" / "run.csv") and "| x | 2 |" in artifacts.markdown(done, ["scenario", "runs"])
    (tmp_path / "m.json").write_text(json.dumps({"files": {"s/run.csv": done["raw_sha256"]}}))
    assert artifacts.preserved(tmp_path, tmp_path / "m.json")["files_checked"] == 1
    ragged = artifacts.union_ragged(spark.range(1), spark.range(1).select(F.array("id").alias("b")))
    artifacts.write_table(ragged, str(tmp_path / "t"))
    assert ragged.columns == ["b", "id"] and spark.read.csv(str(tmp_path / "t"), header=True).count() == 2


def run(capsys, spark, *arguments):
    code = cli.main(list(map(str, arguments)), spark)
    return code, json.loads(capsys.readouterr().out)


def test_command_line(spark, capsys, tmp_path):
    code, out = run(capsys, spark, "duplicate-keys", "--synthetic", "--keys", "id")
    assert code == 1 and out["status"] == "fail" and out["result"]["duplicate_groups"] == 1 and out["result"]["excess_rows"] == 1
    code, out = run(capsys, spark, "null-keys", "--synthetic", "--keys", "id")
    assert code == 1 and out["result"]["sample_row_numbers"] == [3]
    code, out = run(capsys, spark, "freshness", "--synthetic", "--timestamp-column", "event_ts", "--max-age-seconds", 3600, "--now", "2026-01-01T03:00:00Z")
    assert code == 0 and out["result"]["age_seconds"] == 3600 and out["result"]["latest_timestamp"] == "2026-01-01T02:00:00+00:00"
    code, out = run(capsys, spark, "duplicate-current", "--synthetic", "--keys", "id", "--current-column", "is_current", "--strict")
    assert code == 1 and out["result"]["strict"]
    data, config = tmp_path / "d.csv", tmp_path / "c.json"
    data.write_text("﻿id,v\na,1\n\nb,2\n", encoding="utf-8")
    config.write_text(json.dumps({"csv": str(data), "keys": ["v"], "strict": True}))
    assert run(capsys, spark, "duplicate-keys", "--config", config)[0] == 0
    code, out = run(capsys, spark, "duplicate-keys", "--config", config, "--keys", "id", "--no-strict")
    assert code == 0 and out["result"]["strict"] is False
    data.write_text("id,v\na\n")
    code, out = run(capsys, spark, "null-keys", "--csv", data, "--keys", "id")
    assert code == 2 and out["error"] == "data row 1: field count differs from header"
    for bad in (["null-keys", "--keys", "id"], ["null-keys", "--synthetic", "--keys", "no"], ["null-keys", "--synthetic", "--keys", "id", "id"], ["freshness", "--synthetic", "--timestamp-column", "event_ts", "--max-age-seconds", "nan"], ["null-keys", "--csv", tmp_path / "none.csv", "--keys", "id"], ["unknown"], ["freshness", "--synthetic", "--timestamp-column", "event_ts", "--max-age-seconds", 1, "--now", "2026-01-01"]):
        code, out = run(capsys, spark, *bad)
        assert code == 2 and out["status"] == "error" and out["error"], bad
    for content in ([], {"other": 1}, {"synthetic": True, "strict": None, "keys": ["id"]}, {"synthetic": 1, "keys": ["id"]}, {"synthetic": True, "keys": "id"}, {"synthetic": True, "csv": "x", "keys": ["id"]}, {"csv": "", "keys": ["id"]}):
        config.write_text(json.dumps(content))
        code, out = run(capsys, spark, "duplicate-keys", "--config", config)
        assert code == 2 and out["error"], content
    config.write_text(json.dumps({"csv": str(data), "keys": ["id"]}))
    assert run(capsys, spark, "duplicate-keys", "--config", config, "--synthetic")[0] == 1
    assert run(capsys, spark, "cdc-demo", "--seed", 3)[0] == 0
    assert run(capsys, spark, "cdc-demo", "--checkpoint-after", 9)[0] == 2


def test_server(spark):
    with server.bound(spark, 0) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        root = f"http://127.0.0.1:{s.server_port}"

        def ask(path, body=None):
            try:
                with urllib.request.urlopen(root + path, body) as r:
                    return r.status, r.read().decode()
            except urllib.error.HTTPError as e:
                return e.code, e.read().decode()

        assert ask("/")[0] == 200 and "ledger_expiry" in ask("/api/scenarios")[1] and ask("/none")[0] == 404
        code, text = ask("/api/replay", json.dumps({"name": "stale_update", "strategy": "version"}).encode())
        assert code == 200 and json.loads(text)["state_correct"]
        for body in (b"[]", b"{", b'{"keys": 99}', b'{"other": 1}', b" " * 20000):
            assert ask("/api/replay", body)[0] == 400
        assert ask("/none", b"{}")[0] == 404
        s.shutdown()


def test_suite_queries_take_the_default_grid(monkeypatch):
    from tidemark import catalog
    from tidemark.sources.generators import SIZES

    seen = {}
    monkeypatch.setattr(suites, "summary", lambda cells: cells)
    monkeypatch.setattr(matrix, "summary", lambda cells: cells)
    for module, name in ((suites, "observe"), (matrix, "observe_prefix"), (matrix, "observe_recovery")):
        monkeypatch.setattr(module, name, lambda spark, cells: cells)
    for n in range(1, 6):
        seen[n] = catalog.QUERIES[f"suite_{n}_summary"](None, "")
    assert all({cell[3] for cell in cells} == set(SIZES) for cells in seen.values())
    assert all(cells == (suites if n < 4 else matrix).grid(n) for n, cells in seen.items())


def test_suite_4_is_generated_once(spark):
    """The last plan reads stored folds; before, it held the generators of all streams, several times over."""
    seen = matrix.observe_prefix(spark, matrix.grid(4, sizes=(100,), seeds=(1301,), intensities=(0.05,), controls=("late",)))
    assert "MapInPandas" not in seen._jdf.queryExecution().toString()
    assert seen.count() == 8
