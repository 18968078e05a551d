"""Seeded event streams.

A cell (suite, dataset_size, seed, rates) is made by Python's generator in one task, so its rows depend on its seed
alone; cells spread over tasks. Sizes of a cell are those of an experiment; faults on tables of any size are in
operators.faults, which needs no generator. `hashed_events` is the form for large inputs.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import mark

# Sizes, seeds and rates of the suites, and where their event times begin.
SIZES = (1000, 10000, 100000)
SEEDS = {1: (101, 202, 303, 404, 505), 2: (1103, 2207, 3301, 4409, 5501), 3: (1301, 2609, 3911, 5209, 6521), 4: (1301, 2609, 3911, 5209, 6521), 5: (1301, 2609, 3911, 5209, 6521)}
BEGIN = {1: "2026-01-01", 2: "2026-02-01", 3: "2026-03-01", 4: "2026-04-01", 5: "2026-04-01"}
CHECKPOINTS = (0.25, 0.50, 0.75)

CELL = "suite int, kind string, fault string, dataset_size long, seed long, intensity double, duplicate double, null_key double, late double, conflict double"
CELL_KEY = ["suite", "kind", "fault", "dataset_size", "seed", "intensity"]
EVENT = "arrival_seq long, total long, event_id string, entity_id string, business_key string, event_ts timestamp, value long, fault_tags array<string>"
KEYED = "suite int, kind string, fault string, dataset_size long, seed long, intensity double"


def count_for(total: int, rate: float) -> int:
    """How many of total a rate selects; halves go to the even neighbour, and a positive rate selects one at least."""
    return min(total, max(1, round(total * rate))) if total > 0 and rate > 0 else 0


def instants(suite: int, seconds) -> np.ndarray:
    start = int(datetime.fromisoformat(BEGIN[suite]).replace(tzinfo=timezone.utc).timestamp())
    return (start + np.asarray(seconds, dtype="int64")) * 1_000_000


def canonical(suite: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Entity number and value of each event of a cell before faults."""
    rng = random.Random(seed)
    if suite == 5:
        return np.arange(n) % max(10, n // 20), np.array([rng.randint(1, 1_000_000) for _ in range(n)])
    groups = {1: max(1, n // 4), 2: max(1, n // 3)}.get(suite, max(10, n // 20))
    return np.array([rng.randrange(groups) for _ in range(n)]), np.arange(n)


def compound(suite: int, n: int, seed: int, duplicate: float, null_key: float, late: float, conflict: float) -> pd.DataFrame:
    """A cell of suites 4 and 5 with its faults. Events are numbers: below n canonical, from n on conflicts."""
    entity, value = canonical(suite, n, seed)
    rng = random.Random(seed + 404)
    prefix = "entity-" if suite == 5 else "c"

    def pick(total: int, k: int) -> list[int]:
        return list(range(total)) if suite == 5 and k >= total else rng.sample(range(total), min(k, total)) if k else []

    newest = np.full(entity.max() + 1, -1)
    newest[entity] = np.arange(n)  # the last assignment to an entity stays
    present = sorted((f"{prefix}{e}" for e in np.flatnonzero(newest >= 0)))
    names = [present[i] for i in pick(len(present), count_for(len(present) if suite == 5 else n, conflict))]
    sources = newest[[int(x.removeprefix(prefix)) for x in names]].astype(int) if names else np.array([], dtype=int)

    is_late = np.zeros(n + len(names), dtype=bool)
    is_late[pick(n, count_for(n, late))] = True
    numbers = np.arange(n + len(names))
    order = np.concatenate([numbers[~is_late], numbers[is_late]])
    no_key = np.zeros(len(numbers), dtype=bool)
    own = order[order < n]
    no_key[own[pick(n, count_for(n, null_key))]] = True
    copies = order[pick(len(order), count_for(len(order) if suite == 5 else n, duplicate))]

    def each(own_value, made) -> np.ndarray:
        return np.array([own_value(i) for i in range(n)] + [made(j, x) for j, x in enumerate(names)], dtype=object)

    ids = each(lambda i: f"e{i}", lambda j, x: f"conflict-{x}-{j}" if suite == 5 else f"conflict-{seed}-{j}-e{sources[j]}")
    keys = each(lambda i: f"k{i}", lambda j, x: f"conflict-key-{x}-{j}" if suite == 5 else f"conflict-k-{seed}-{j}")
    keys[no_key] = None
    entities = each(lambda i: f"{prefix}{entity[i]}", lambda j, x: x)
    times = np.concatenate([instants(suite, np.arange(n)), instants(suite, sources) - 1])
    values = np.concatenate([value, -1 - np.arange(len(names))])
    rows = np.concatenate([order, copies]).astype(int)
    copied = np.arange(len(rows)) >= len(order)
    tags = [[t for t, on in (("conflict", r >= n), ("duplicate", c), ("late", is_late[r]), ("null_key", no_key[r])) if on] for r, c in zip(rows, copied)]
    return pd.DataFrame({"arrival_seq": np.arange(len(rows)), "total": len(rows), "event_id": ids[rows], "entity_id": entities[rows], "business_key": keys[rows], "event_ts": pd.to_datetime(times[rows], unit="us", utc=True), "value": values[rows], "fault_tags": tags})


def streams(suite: int, n: int, seed: int, rate: float) -> Iterator[tuple[str, int, list[int], set[int]]]:
    """The inputs of suites 1 to 3: name, faults put in, event numbers by arrival, and positions without a key."""
    k = max(1, int(n * rate) if suite == 1 else round(n * rate))
    yield "base", 0, list(range(n)), set()
    if suite == 3:
        rng = random.Random(seed + 71)
        mixed = [*range(n), *rng.sample(range(n), min(k, n))]
        void = set(rng.sample(range(len(mixed)), min(k, len(mixed))))
        places = list(range(len(mixed)))
        rng.shuffle(places)
        yield "mixed", 2 * k, [mixed[p] for p in places], {at for at, p in enumerate(places) if p in void}
        moved = sorted(rng.sample(range(1, n), min(k, n - 1)))
        yield "late", k, _last(n, moved), set()
        shuffled = list(range(n))
        rng.shuffle(shuffled)
        yield "shuffled", n, shuffled, set()
        for part in CHECKPOINTS:
            cut = max(1, int(n * part))
            yield f"replay-{part}", cut, [*range(cut), *range(n)], set()
        return
    rng = random.Random(seed + (1 if suite == 1 else 17))
    picked = rng.sample(range(n), min(k, n))
    doubled = [*range(n), *picked]
    rng.shuffle(doubled)
    yield "duplicated", k if suite == 1 else len(picked), doubled, set()
    rng = random.Random(seed + (2 if suite == 1 else 29))
    void = set(rng.sample(range(n), min(k, n)))
    yield "nulled", k if suite == 1 else len(void), list(range(n)), void
    if suite == 2:
        cut = max(1, int(n * 0.6))
        yield "replay-0.6", cut, [*range(cut), *range(n)], set()


def _last(n: int, moved: list[int]) -> list[int]:
    stays = np.ones(n, dtype=bool)
    stays[moved] = False
    return [*np.flatnonzero(stays).tolist(), *moved]


def cells(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Cells of a matrix, one a partition where there are few."""
    return spark.createDataFrame(rows, CELL).repartition(min(len(rows), 64))


def generate(spark: SparkSession, rows: list[tuple], faulted: bool = True) -> DataFrame:
    """The streams of suites 4 and 5, keyed by their cell."""

    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for c in part.itertuples():
                rates = (c.duplicate, c.null_key, c.late, c.conflict) if faulted else (0, 0, 0, 0)
                out = compound(int(c.suite), int(c.dataset_size), int(c.seed), *rates)
                for at, name in enumerate(CELL_KEY):
                    out.insert(at, name, getattr(c, name))
                yield out

    return cells(spark, rows).mapInPandas(make, f"{KEYED}, {EVENT}")


def generate_streams(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The streams of suites 1 to 3: cell, stream, injected, arrival_seq, n (event number), entity, void, event_ts."""

    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for c in part.itertuples():
                suite, size = int(c.suite), int(c.dataset_size)
                entity, _ = canonical(suite, size, int(c.seed))
                for name, injected, order, void in streams(suite, size, int(c.seed), c.intensity):
                    n = np.array(order)
                    hit = np.zeros(len(n), dtype=bool)
                    hit[list(void)] = True
                    yield pd.DataFrame({"suite": suite, "dataset_size": size, "seed": c.seed, "rate": c.intensity, "stream": name, "injected": injected, "arrival_seq": np.arange(len(n)), "n": n, "entity": entity[n], "void": hit, "event_ts": pd.to_datetime(instants(suite, n), unit="us", utc=True)})

    return cells(spark, rows).mapInPandas(make, "suite int, dataset_size long, seed long, rate double, stream string, injected long, arrival_seq long, n long, entity long, void boolean, event_ts timestamp")


def hashed_events(spark: SparkSession, n: int, seed: int, suite: int = 5) -> DataFrame:
    """Events of any number, with values by digest in place of a sequential generator."""
    i, groups = F.col("id"), max(10, n // 20)
    value = F.conv(F.substring(mark(i, seed), 1, 12), 16, 10).cast("long") % 1_000_000 + 1
    return spark.range(n).select(
        i.alias("arrival_seq"), F.concat(F.lit("e"), i).alias("event_id"), F.concat(F.lit("entity-"), i % groups).alias("entity_id"), F.concat(F.lit("k"), i).alias("business_key"),
        F.timestamp_micros(F.lit(int(instants(suite, [0])[0])) + i * 1_000_000).alias("event_ts"), value.alias("value"), F.array().cast("array<string>").alias("fault_tags"), F.lit(False).alias("is_recovery_replay"),
    )


def changes(spark: SparkSession, keys: int, versions: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """Versions of keys, all keys of a version before the next; version 3 is a tombstone."""
    v, k = F.col("version"), F.col("id")
    each = F.explode(F.array(*(F.struct(F.lit(x).cast("long").alias("version"), F.lit(at).cast("long").alias("at")) for at, x in enumerate(versions)))).alias("x")
    rows = spark.range(keys).select("id", each).select("id", "x.*")
    return rows.select((F.col("at") * keys + k).alias("q"), F.concat(F.lit("b"), k, F.lit(":v"), v).alias("event_id"), F.concat(F.lit("k"), k).alias("key"), "version", F.concat(F.lit("value-"), v).alias("value"), (v == 3).alias("deleted"))
