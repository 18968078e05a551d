"""Replay with a ledger of bounded capacity: first in, first out, so each run is played in order.

Runs are independent groups; a run's deliveries must fit one task, as its ledger must.
"""

from __future__ import annotations

import json
from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame

PLAYED = "run_id string, q long, decision string, ledger_size long, ledger_peak long"


def play(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("q")
    strategy, capacity = rows["strategy"].iloc[0], rows["capacity"].iloc[0]
    room = None if pd.isna(capacity) else int(capacity)
    ledger: OrderedDict = OrderedDict()
    state: dict = {}
    peak, out = 0, []
    for r in rows.itertuples():
        payload = (r.key, r.version, r.value, r.deleted)
        current = state.get(r.key)
        known = ledger.get(r.event_id) if strategy != "arrival" else None
        if known is not None:
            decision = "duplicate" if known == payload else "conflict"
        elif strategy == "version" and current and r.version == current[1] and payload != current:
            decision = "conflict"
        elif strategy == "version" and current and r.version < current[1]:
            decision = "stale"
        else:
            decision = "applied"
            state[r.key] = payload
        if decision in ("applied", "stale") and strategy != "arrival" and room != 0:
            ledger[r.event_id] = payload
            if room is not None and len(ledger) > room:
                ledger.popitem(last=False)
            peak = max(peak, len(ledger))
        out.append((r.run_id, r.q, decision, len(ledger), peak))
        if decision == "conflict":
            break
    return pd.DataFrame(out, columns=["run_id", "q", "decision", "ledger_size", "ledger_peak"])


TRACED = f"{PLAYED}, before string, after string, state string"


def play_traced(rows: pd.DataFrame) -> pd.DataFrame:
    """play with the key's state before and after each delivery and all states after it, as JSON."""
    played = play(rows).merge(rows[["q", "key", "version", "value", "deleted"]], on="q")
    state: dict = {}
    steps = []
    for r in played.itertuples():
        before = state.get(r.key)
        if r.decision == "applied":
            state[r.key] = {"version": int(r.version), "value": r.value, "deleted": bool(r.deleted)}
        steps.append([json.dumps(x, sort_keys=True) for x in (before, state.get(r.key), state)])
    played[["before", "after", "state"]] = steps
    return played[["run_id", "q", "decision", "ledger_size", "ledger_peak", "before", "after", "state"]]


def replay_traced(deliveries: DataFrame) -> DataFrame:
    """replay_bounded with a full trace; the trace grows with deliveries times keys, so it is for small runs."""
    return deliveries.groupBy("run_id").applyInPandas(play_traced, TRACED)


def replay_bounded(deliveries: DataFrame) -> DataFrame:
    """deliveries: run_id, strategy, capacity (null: no bound), q, event_id, key, version, value, deleted."""
    return deliveries.groupBy("run_id").applyInPandas(play, PLAYED)
