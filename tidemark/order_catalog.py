"""Queries of samples, orders, seeded faults, ledgers and replay reports, and the SQL that says the same."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .catalog import COLUMNS, CONFLICTED_SQL, DELIVERED_SQL, FAULTED_SQL, ONE_FAULT, QUERIES, TOTAL, canonical, changes, conflicted, decided_sql, delivered, faulted, query, read
from .functions.text import digest, instant, isoformat
from .operators import cdc, controls, faults, ordering, state
from .plans import lab, matrix, suites

# -- samples and orders ------------------------------------------------------------------------------------------------


def first_sql(fraction: float, order: str) -> str:
    return f"row_number() OVER (ORDER BY {order}) <= least(count(*) OVER (), greatest(1, round_even(count(*) OVER () * {fraction}::DOUBLE, 0)))"


def picked_sql(rate: float, seed: int, table: str = "events", key: str = "event_id") -> str:
    return f"SELECT {key} FROM {table} QUALIFY {first_sql(rate, f'md5({seed!r} || {chr(39)}:{chr(39)} || {key}), {key}')}"


@query(picked_sql(0.05, 7))
def sample_ids(spark, sf_dir):
    return ordering.sampled(read(spark, sf_dir, "events").select("event_id"), "event_id", 0.05, 7)


ORDERS = {
    "reverse": ("event_id DESC", lambda: [F.col("event_id").desc()]),
    "event_time": ("ts, event_id", lambda: ["ts", "event_id"]),
    "lexicographic": ("event_id::VARCHAR", lambda: [F.col("event_id").cast("string")]),
    "by_key": ("event_type, 'k' || user_id, event_id", lambda: ["event_type", F.concat(F.lit("k"), F.col("user_id")), "event_id"]),
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS ordering, event_id, row_number() OVER (ORDER BY {sql}) - 1 AS position FROM events" for name, (sql, _) in ORDERS.items()))
def delivery_orders(spark, sf_dir):
    out = None
    for name, (_, order) in ORDERS.items():
        one = ordering.numbered(read(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts"), *order()).select(F.lit(name).alias("ordering"), "event_id", "position")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT event_id, row_number() OVER (ORDER BY md5('11:' || event_id), event_id) - 1 AS position FROM events")
def seeded_shuffle(spark, sf_dir):
    return ordering.shuffled(read(spark, sf_dir, "events").select("event_id"), "event_id", 11)


@query(f"{FAULTED_SQL} SELECT event_id, arrival_seq, {first_sql(0.35, 'arrival_seq')} AS prefix FROM f")
def prefix_suffix(spark, sf_dir):
    """The faulted stream, parted at a checkpoint."""
    return ordering.split(faulted(spark, sf_dir).select("event_id", "arrival_seq"), 0.35, "arrival_seq")


@query("""SELECT position, a.event_id AS left_id, b.event_id AS right_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events) a
    FULL JOIN (SELECT event_id, row_number() OVER (ORDER BY event_type, event_id) - 1 AS position FROM events WHERE event_id % 50 <> 7) b USING (position) WHERE a.event_id IS DISTINCT FROM b.event_id""")
def positional_diff(spark, sf_dir):
    """Two tables compared place by place; the second lacks rows."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type")
    met = ordering.aligned(e.select("event_id"), e.where("event_id % 50 <> 7"), ["event_id"], ["event_type", "event_id"])
    return met.select("position", F.col("left.event_id").alias("left_id"), F.col("right.event_id").alias("right_id")).where("not (left_id <=> right_id)")


# -- faults by seed ----------------------------------------------------------------------------------------------------

SEEDED = {"duplicate": lambda df: faults.duplicate(df, F.col("chosen")), "null_key": lambda df: faults.null_key(df, F.col("chosen")), "late": lambda df: faults.late(df, F.col("chosen"))}


def _seeded(fault: str, seed: int) -> None:
    sql = re.sub(r"event_id % \d+ = 0", "event_id IN (SELECT event_id FROM picked)", ONE_FAULT[fault][1])

    @query(f"{FAULTED_SQL}, picked AS ({picked_sql(0.1, seed)}) SELECT * FROM ({sql})", f"fault_sampled_{fault}")
    def run(spark, sf_dir):
        events = canonical(spark, sf_dir)
        ids = ordering.sampled(events.select("event_id"), "event_id", 0.1, seed)
        return SEEDED[fault](faults.chosen(events, ids)).select(*COLUMNS, F.concat_ws("", "fault_tags").alias("tags"))


for _seed, _fault in enumerate(SEEDED, 404):
    _seeded(_fault, _seed)

MIXED_SQL = f"""WITH e AS (SELECT event_id, 'k' || user_id AS business_key FROM events), twice AS ({picked_sql(0.1, 71, 'e')}),
    w AS (SELECT *, event_id || '/0' AS row FROM e UNION ALL SELECT *, event_id || '/1' FROM e WHERE event_id IN (SELECT event_id FROM twice)), void AS ({picked_sql(0.1, 72, 'w', 'row')})"""


@query(f"{MIXED_SQL} SELECT event_id, row, CASE WHEN row NOT IN (SELECT row FROM void) THEN business_key END AS business_key, row_number() OVER (ORDER BY md5('73:' || row), row) - 1 AS position FROM w")
def mixed_shuffled(spark, sf_dir):
    """Copies of some events, keys taken from some rows, copies among them, and all in a random order."""
    e = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("k"), F.col("user_id")).alias("business_key"))
    named = lambda df, n: df.withColumn("row", F.concat(F.col("event_id").cast("string"), F.lit(f"/{n}")))
    rows = named(e, 0).unionByName(named(ordering.sampled(e, "event_id", 0.1, 71), 1))
    hit = faults.chosen(rows, ordering.sampled(rows.select("row"), "row", 0.1, 72), "row")
    return ordering.shuffled(hit.select("event_id", "row", F.when(~F.col("chosen"), F.col("business_key")).alias("business_key")), "row", 73)


@query(f"SELECT count(*) AS input_rows, count(DISTINCT event_id) AS kept_rows, count(*) - count(DISTINCT event_id) AS duplicates FROM (SELECT event_id FROM events QUALIFY {first_sql(0.6, 'event_id')} UNION ALL SELECT event_id FROM events)")
def partial_replay(spark, sf_dir):
    """A prefix of the events, and then all of them, deduplicated."""
    e = read(spark, sf_dir, "events").select("event_id")
    return controls.dedup_count(ordering.split(e, 0.6, "event_id").where("prefix").select("event_id").unionByName(e), "event_id")


# -- rules of change events --------------------------------------------------------------------------------------------

BROKEN = {"event_id": 31, "key": 37, "version": 41, "value": 43, "deleted": 47}


@query(f"""SELECT n AS q, CASE WHEN n % 31 = 0 THEN 'event_id must be a nonempty string' WHEN n % 37 = 0 THEN 'key must be a nonempty string' WHEN n % 41 = 0 THEN 'version must be a positive integer'
    WHEN n % 43 = 0 THEN 'value must be a string' WHEN n % 47 = 0 THEN 'deleted must be a boolean' END AS error FROM (SELECT event_id AS n FROM events) WHERE error IS NOT NULL""")
def cdc_invalid_events(spark, sf_dir):
    """The first rule that each malformed change breaks."""
    hit = lambda c: F.col("n") % BROKEN[c] == 0
    rows = changes(spark, sf_dir).withColumn("q", F.col("n"))
    rows = rows.withColumns({"event_id": F.when(hit("event_id"), "").otherwise(F.col("event_id")), "version": F.when(hit("version"), 0).otherwise(F.col("version")), **{c: F.when(~hit(c), F.col(c)) for c in ("key", "value", "deleted")}})
    return cdc.invalid_events(rows)


@query(f"""WITH {CONFLICTED_SQL} SELECT 'event_id' AS kind, event_id AS name FROM k GROUP BY event_id HAVING count(DISTINCT (key, version, value, deleted)) > 1
    UNION ALL SELECT 'version', key || '/' || version FROM k GROUP BY key, version HAVING count(DISTINCT (value, deleted)) > 1""")
def cdc_contradictions(spark, sf_dir):
    return state.contradictions(conflicted(spark, sf_dir))


PHASED_SQL = f"""WITH {DELIVERED_SQL}, {decided_sql('version')}, m AS (SELECT max(event_id) AS m FROM events),
    p AS (SELECT z.*, unnest(list_filter([CASE WHEN q < m * 3 // 4 THEN 'attempt' END, CASE WHEN q >= m // 2 AND q < {TOTAL} THEN 'restart' END, CASE WHEN q >= {TOTAL} THEN 'redelivery' END], lambda x: x IS NOT NULL)) AS phase, m // 2 AS cp, m * 3 // 4 AS stop FROM z, m)"""


def _versioned(spark, sf_dir):
    m = read(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    return cdc.phased(cdc.decisions(delivered(spark, sf_dir), "version"), TOTAL, m // 2, m * 3 // 4, validated=True), m // 2, m * 3 // 4


@query(f"{PHASED_SQL} SELECT x.phase, {', '.join(f'count(*) FILTER (decision = {chr(39)}{d}{chr(39)}) AS {d}' for d in cdc.DECISIONS)} FROM (VALUES ('attempt'), ('restart'), ('redelivery')) x(phase) LEFT JOIN p ON p.phase = x.phase GROUP BY 1")
def cdc_counters_wide(spark, sf_dir):
    return cdc.counters_wide(_versioned(spark, sf_dir)[0])


@query(f"{PHASED_SQL} SELECT count(*) FILTER (phase = 'attempt' AND q >= cp) AS lost_attempts, count(*) FILTER (phase = 'restart' AND q < stop) AS replayed_lost_attempts, count(*) FILTER (phase = 'restart') AS restart_deliveries, count(*) FILTER (phase = 'redelivery') AS redelivery_deliveries FROM p")
def cdc_recovery_counters(spark, sf_dir):
    return cdc.recovery_counters(*_versioned(spark, sf_dir))


@query(f"WITH {DELIVERED_SQL}, {decided_sql('version')} SELECT count(DISTINCT event_id) FILTER (decision IN ('applied', 'stale')) AS known_ids, count(DISTINCT event_id) AS delivered_ids FROM z")
def cdc_ledger_coverage(spark, sf_dir):
    return cdc.ledger_coverage(cdc.decisions(delivered(spark, sf_dir), "version"))


# -- text --------------------------------------------------------------------------------------------------------------

#: What event_id % 8 writes: pattern, zone; in SQL the instant in microseconds and its extended form.
FORMS = [
    ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "Z", "epoch_us(ts)", "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00'"),
    ("yyyy-MM-dd HH:mm:ss", "+00:00", "epoch_us(date_trunc('second', ts))", "strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00')"),
    ("yyyyMMdd'T'HHmmss", "+0200", "epoch_us(date_trunc('second', ts)) - 7200000000", "strftime(ts, '%Y-%m-%dT%H:%M:%S+02:00')"),
    ("yyyy-MM-dd'T'HH:mm", "-05:30", "epoch_us(date_trunc('minute', ts)) + 19800000000", "strftime(ts, '%Y-%m-%dT%H:%M:00-05:30')"),
    ("yyyy-MM-dd'T'HH", "+01", "epoch_us(date_trunc('hour', ts)) - 3600000000", "strftime(ts, '%Y-%m-%dT%H:00:00+01:00')"),
    ("yyyy-MM-dd'T'HH:mm:ss", "", "NULL", "NULL"),
    ("yyyy-MM-dd", " noon", "NULL", "NULL"),
    ("yyyyMMdd'T'HHmmss','SSS", "Z", "epoch_us(date_trunc('millisecond', ts))", "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 < 1000 THEN '' ELSE strftime(date_trunc('millisecond', ts), '.%f') END || '+00:00'"),
]


@query("SELECT event_id, CASE event_id % 8 " + " ".join(f"WHEN {n} THEN {sql}" for n, (_, _, sql, _) in enumerate(FORMS)) + " END AS micros, CASE event_id % 8 " + " ".join(f"WHEN {n} THEN {sql}" for n, (_, _, _, sql) in enumerate(FORMS)) + " END AS iso FROM events")
def iso_instants(spark, sf_dir):
    """Instants written in several ISO-8601 forms, some of them without a zone."""
    text = F.lit(None).cast("string")
    for n, (pattern, zone, _, _) in enumerate(FORMS):
        text = F.when(F.col("event_id") % 8 == n, F.concat(F.date_format("ts", pattern), F.lit(zone))).otherwise(text)
    return read(spark, sf_dir, "events").select("event_id", text.alias("at")).select("event_id", F.unix_micros(instant("at")).alias("micros"), isoformat("at").alias("iso"))


@query("""SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS digest FROM events""")
def json_digests(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", digest("user_id", "event_type", "event_id").alias("digest"))


# -- ledgers and reports -----------------------------------------------------------------------------------------------


def ledger_sql(base: str) -> str:
    """r: every delivery of the probe (o: its order, s: policy, c: capacity) with its decision, the ledger and the state after it."""
    known = "CASE WHEN s <> 'arrival' THEN list_filter(ledger, lambda x: starts_with(x, event_id || '='))[1] END"
    current = "CASE WHEN s = 'version' THEN list_filter(state, lambda x: starts_with(x, key || '|'))[1] END"
    return f"""WITH RECURSIVE b AS ({base}),
    w AS (SELECT 'conflict_first' AS o, b.* FROM b UNION ALL SELECT 'exact_then_conflict', b.* FROM b UNION ALL SELECT 'conflict_first', 64, event_id, key, version, 'conflicting', deleted FROM b WHERE q = 0
      UNION ALL SELECT 'exact_then_conflict', 64, event_id, key, version, value, deleted FROM b WHERE q = 0 UNION ALL SELECT 'exact_then_conflict', 65, event_id, key, version, 'conflicting', deleted FROM b WHERE q = 0),
    d AS (SELECT o, q, event_id, key, version, key || '|' || version || '|' || value || '|' || deleted AS payload FROM w),
    r AS (SELECT o, s, c, -1::BIGINT AS q, '' AS decision, []::VARCHAR[] AS ledger, []::VARCHAR[] AS state FROM (VALUES ('conflict_first'), ('exact_then_conflict')) a(o), (VALUES ('arrival'), ('id_only'), ('version')) p(s), (VALUES (0::BIGINT), (4), (16), (NULL)) n(c)
      UNION ALL SELECT o, s, c, q, decision,
        CASE WHEN decision IN ('applied', 'stale') AND s <> 'arrival' AND c IS DISTINCT FROM 0 THEN list_slice(longer, greatest(1, len(longer) - coalesce(c, 1000000) + 1), len(longer)) ELSE ledger END,
        CASE WHEN decision = 'applied' THEN list_append(list_filter(state, lambda x: NOT starts_with(x, key || '|')), payload) ELSE state END
      FROM (SELECT *, list_append(ledger, event_id || '=' || payload) AS longer,
          CASE WHEN known = event_id || '=' || payload THEN 'duplicate' WHEN known IS NOT NULL THEN 'conflict' WHEN version = split_part(current, '|', 2)::BIGINT AND payload <> current THEN 'conflict' WHEN version < split_part(current, '|', 2)::BIGINT THEN 'stale' ELSE 'applied' END AS decision
        FROM (SELECT *, {known} AS known, {current} AS current FROM (SELECT r.o, r.s, r.c, r.ledger, r.state, d.q, d.event_id, d.key, d.version, d.payload FROM r JOIN d ON d.o = r.o AND d.q = r.q + 1 WHERE r.decision <> 'conflict'))))"""


query(f"""{ledger_sql("SELECT i AS q, 'b' || (i // 4) || ':v' || (i % 4 + 1) AS event_id, 'b' || (i // 4) AS key, i % 4 + 1 AS version, 'value-' || i AS value, i % 4 = 2 AS deleted FROM range(64) t(i)")}
    SELECT s || '/' || coalesce(c::VARCHAR, 'all') || '/' || o AS run_id, count(*) FILTER (decision = 'conflict') AS conflicts, count(*) FILTER (decision = 'duplicate' AND q >= 64) AS exact_recognized, max(len(ledger)) AS ledger_peak FROM r WHERE q >= 0 GROUP BY o, s, c""", "ledger_fifo_probe")(QUERIES["ledger_fifo_probe"])

query(f"""{ledger_sql("SELECT v * 16 + k AS q, 'b' || k || ':v' || (v + 1) AS event_id, 'k' || k AS key, v + 1 AS version, 'value-' || (v + 1) AS value, v = 2 AS deleted FROM range(4) a(v), range(16) t(k)")},
    t AS (SELECT o, s, c, max(q = 64 AND decision = 'duplicate') AS again, max(decision = 'conflict') AS found, arg_max(list_sort(state), q) FILTER (q <= 63) AS before, arg_max(list_sort(state), q) FILTER (q <= 64) AS after, arg_max(list_sort(state), q) AS last, max(len(ledger)) AS ledger_peak FROM r WHERE q >= 0 GROUP BY o, s, c)
    SELECT s AS strategy, c AS capacity, seed, o AS probe_order, CASE WHEN o = 'exact_then_conflict' THEN again END AS duplicate_recognized, found AS conflict_detected, CASE WHEN o = 'exact_then_conflict' THEN before = after END AS exact_replay_state_unchanged, last = before AS final_state_unchanged, ledger_peak
    FROM t, (VALUES (7::BIGINT), (17), (29)) x(seed)""", "ledger_expiry_report")(QUERIES["ledger_expiry_report"])

#: Replays of all scenarios: which copies and which shuffle the generator draws changes no count of the report.
LAB_SQL = f"""WITH runs AS (SELECT keys || '/' || seed || '/' || name AS run, keys, name, versions, name IN ('checkpoint_recovery', 'post_recovery_redelivery') AS cut
      FROM (VALUES (8::BIGINT), (64)) a(keys), (VALUES (7), (17), (29)) b(seed), (VALUES ('ordered', [1, 2]), ('duplicate_only', [1, 2]), ('ordered_delete_reinsert', [1, 2, 3, 4]), ('stale_update', [4, 3]), ('checkpoint_recovery', [1, 2, 3, 4]), ('post_recovery_redelivery', [1, 2, 3, 4])) c(name, versions)),
    base AS (SELECT run, name, keys, cut, len(versions) * keys AS n, k, versions[nth + 1] AS v, nth * keys + k AS place FROM (SELECT *, unnest(range(len(versions))) AS nth FROM runs), range(64) t(k) WHERE k < keys),
    s AS (SELECT run, name, cut, k, v, CASE WHEN name = 'duplicate_only' THEN place * 2 ELSE place END AS q, n FROM base UNION ALL SELECT run, name, cut, k, v, place * 2 + 1, n FROM base WHERE name = 'duplicate_only' AND place % 3 = 0
      UNION ALL SELECT run, name, cut, k, v, 2 * n - 1 - place, n FROM base WHERE name = 'post_recovery_redelivery'),
    e AS (SELECT run || '/' || k || ':' || v AS event_id, run || '/' || k AS key, v AS version, 'value-' || v AS value, v = 3 AS deleted, q, run, CASE WHEN name = 'duplicate_only' THEN 1000 ELSE n END AS total, CASE WHEN cut THEN n // 3 ELSE 0 END AS cp, CASE WHEN cut THEN n * 2 // 3 ELSE 0 END AS stop FROM s)"""


def _report_sql(strategy: str) -> str:
    return f"""SELECT '{strategy}' AS strategy, count(*) FILTER (wrong = 0) AS correct, count(*) FILTER (wrong > 0) AS incorrect, 12::BIGINT AS rejected, sum(attempted)::BIGINT AS attempted_violation_sum, sum(committed)::BIGINT AS committed_prefix_violation_sum, sum(recovered)::BIGINT AS recovered_violation_sum FROM (
      {LAB_SQL}, {decided_sql(strategy)},
      last AS (SELECT run, key, version FROM z WHERE decision = 'applied' QUALIFY row_number() OVER (PARTITION BY key ORDER BY q DESC) = 1),
      wrong AS (SELECT run, count(*) FILTER (last.version <> x.v) AS wrong FROM last JOIN (SELECT key, max(version) AS v FROM e GROUP BY 1) x USING (key) GROUP BY 1),
      bad AS (SELECT run, count(*) FILTER (regressed AND q < stop) AS attempted, count(*) FILTER (regressed AND q < cp) AS committed, count(*) FILTER (regressed AND q >= cp AND q < total) + count(*) FILTER (regressed AND q >= total) AS recovered FROM z GROUP BY 1)
      SELECT * FROM wrong JOIN bad USING (run))"""


query(" UNION ALL ".join(map(_report_sql, cdc.STRATEGIES)), "lab_strategy_report")(QUERIES["lab_strategy_report"])


def _observed(spark, sf_dir):
    """Events as if each were a run: outcome, violations and seconds by rule."""
    n = F.col("event_id")
    rejected = n % 7 == 0
    marks = {"strategy": F.col("event_type"), "scenario": F.concat(F.lit("s"), n % 3), "input_rejected": rejected, "state_correct": F.when(~rejected, n % 5 != 0), "attempted": n % 4, "committed_prefix": n % 2, "recovered": n % 3, "seconds": F.col("value")}
    return read(spark, sf_dir, "events").select(*(c.alias(name) for name, c in marks.items()))


OBSERVED_SQL = "(SELECT event_type AS strategy, 's' || event_id % 3 AS scenario, event_id % 7 = 0 AS input_rejected, CASE WHEN event_id % 7 <> 0 THEN event_id % 5 <> 0 END AS state_correct, event_id % 4 AS attempted, event_id % 2 AS committed_prefix, event_id % 3 AS recovered, value AS seconds FROM events)"


@query(f"SELECT strategy, count(*) FILTER (state_correct) AS correct, count(*) FILTER (NOT state_correct) AS incorrect, count(*) FILTER (input_rejected) AS rejected, sum(attempted)::BIGINT AS attempted_violation_sum, sum(committed_prefix)::BIGINT AS committed_prefix_violation_sum, sum(recovered)::BIGINT AS recovered_violation_sum, min(seconds) AS min_seconds, max(seconds) AS max_seconds FROM {OBSERVED_SQL} GROUP BY 1")
def report_by_strategy(spark, sf_dir):
    return lab.by_strategy(_observed(spark, sf_dir))


@query(f"SELECT scenario, strategy, count(*) FILTER (state_correct) AS correct, count(*) FILTER (input_rejected) AS rejected FROM {OBSERVED_SQL} GROUP BY 1, 2")
def report_by_scenario(spark, sf_dir):
    return lab.by_scenario(_observed(spark, sf_dir))


@query("""SELECT event_type AS scenario, CASE WHEN user_id % 2 = 0 THEN 'controlled' ELSE 'baseline' END AS strategy, 1000::BIGINT AS dataset_size, 0.05::DOUBLE AS rate, NULL::DOUBLE AS checkpoint, count(*) AS runs,
    round(CASE WHEN sum(put) > 0 THEN sum(found) / sum(put) END, 6) AS detection_rate, round(avg(found), 6) AS correct_run_rate
    FROM (SELECT *, CASE WHEN event_type <> 'error' AND event_id % 3 = 0 THEN 1 ELSE 0 END AS put, CASE WHEN event_type <> 'error' AND event_id % 6 = 0 THEN 1 ELSE 0 END AS found FROM events) GROUP BY 1, 2""")
def detection_rates(spark, sf_dir):
    """The rate of detected faults; null where none was put in."""
    clean = F.col("event_type") == "error"
    put, found = (F.when(~clean & (F.col("event_id") % n == 0), 1).otherwise(0).cast("long") for n in (3, 6))
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("scenario"), F.when(F.col("user_id") % 2 == 0, "controlled").otherwise("baseline").alias("strategy"), F.lit(1000).cast("long").alias("dataset_size"), F.lit(0.05).alias("rate"), F.lit(None).cast("double").alias("checkpoint"), put.alias("faults_injected"), found.alias("faults_detected"), found.alias("correct"))
    return suites.summary(rows)


@query("""SELECT unnest(list_filter([CASE WHEN n <> 4 THEN 'row count' END, CASE WHEN cells <> n THEN 'repeated cell' END, CASE WHEN outside > 0 THEN 'rate outside 0 to 1' END], lambda x: x IS NOT NULL)) AS rule, n AS rows, cells, outside
    FROM (SELECT count(*) AS n, count(DISTINCT event_id // 2) AS cells, count(*) FILTER (NOT coalesce(value / 200 BETWEEN 0 AND 1, false)) AS outside FROM events)""")
def validity_rules(spark, sf_dir):
    """What makes observations invalid: their count, cells that repeat, and rates out of bounds."""
    cell = {"suite": F.lit(5), "kind": F.lit("k"), "fault": F.lit("f"), "dataset_size": F.lit(1000), "seed": F.floor(F.col("event_id") / 2), "intensity": F.lit(0.1), "strategy": F.lit("S1"), "state_correctness_rate": F.col("value") / 200}
    return matrix.broken(read(spark, sf_dir, "events").select(*(c.alias(n) for n, c in cell.items())), 1)
