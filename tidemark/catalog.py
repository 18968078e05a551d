"""All queries of the engine over the driver's tables, and the SQL that says the same.

Event faults are chosen by remainders of event_id, so that SQL can state the same inputs.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cdc, checks, controls, faults, ledger, state
from .plans import compositions, lab, matrix, suites
from .sources import generators
from .storage import shared_dir
from .streaming import materializer

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# -- data quality ------------------------------------------------------------------------------------------------------

FACTS = """sum(n)::BIGINT AS rows_checked, coalesce(sum(n) FILTER (void), 0)::BIGINT AS invalid_key_rows, coalesce(sum(n) FILTER (taken), 0)::BIGINT AS selected_rows,
    count(*) FILTER (taken AND NOT void AND n > 1) AS duplicate_groups, coalesce(sum(n) FILTER (taken AND NOT void AND n > 1), 0)::BIGINT AS duplicate_rows,
    coalesce(sum(n - 1) FILTER (taken AND NOT void AND n > 1), 0)::BIGINT AS excess_rows, coalesce(sum(n) FILTER (taken AND void), 0)::BIGINT AS null_key_rows_excluded"""


def key_sql(groups: str, strict: bool = False) -> str:
    return f"SELECT duplicate_groups = 0{' AND invalid_key_rows = 0' if strict else ''} AS passed, {strict} AS strict, * FROM (SELECT {FACTS} FROM ({groups}))"


KEYED_SQL = "SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '  ' ELSE ' u' || user_id || event_type END AS k, ts FROM events"


def keyed(spark, sf_dir):
    """Events whose text key is null or blank by rule, with blanks around the others."""
    key = F.when(F.col("event_id") % 17 == 0, None).when(F.col("event_id") % 19 == 0, "  ").otherwise(F.concat(F.lit(" u"), F.col("user_id"), F.col("event_type")))
    return read(spark, sf_dir, "events").select("event_id", key.alias("k"), "ts")


@query(key_sql("SELECT l_orderkey, l_linenumber, true AS taken, l_orderkey IS NULL OR l_linenumber IS NULL AS void, count(*) AS n FROM lineitem GROUP BY ALL"))
def dq_duplicate_keys(spark, sf_dir):
    return checks.duplicate_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dq_duplicate_key_groups(spark, sf_dir):
    return checks.key_groups(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(key_sql(f"SELECT trim(coalesce(k, '')) AS k, true AS taken, trim(coalesce(k, '')) = '' AS void, count(*) AS n FROM ({KEYED_SQL}) GROUP BY ALL", True))
def dq_duplicate_keys_strict(spark, sf_dir):
    return checks.duplicate_keys(keyed(spark, sf_dir), ["k"], strict=True)


@query(f"SELECT count(*) FILTER (trim(coalesce(k, '')) = '') = 0 AS passed, count(*) AS rows_checked, count(*) FILTER (trim(coalesce(k, '')) = '') AS invalid_rows FROM ({KEYED_SQL})")
def dq_null_keys(spark, sf_dir):
    return checks.null_keys(keyed(spark, sf_dir), ["k"])


@query(f"SELECT event_id AS row_number FROM ({KEYED_SQL}) WHERE trim(coalesce(k, '')) = '' ORDER BY 1 LIMIT 20")
def dq_null_key_sample(spark, sf_dir):
    return checks.null_key_sample(keyed(spark, sf_dir), ["k"], "event_id")


NOW = "2030-01-01 00:00:00"


@query(f"SELECT age_seconds BETWEEN 0 AND 1e12 AS passed, rows_checked, latest_timestamp, age_seconds, 1e12::DOUBLE AS max_age_seconds, future_timestamp_count FROM (SELECT count(*) AS rows_checked, max(ts)::TIMESTAMP AS latest_timestamp, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts))) / 1e6 AS age_seconds, count(*) FILTER (ts > TIMESTAMP '{NOW}') AS future_timestamp_count FROM events)")
def dq_freshness(spark, sf_dir):
    return checks.freshness(read(spark, sf_dir, "events"), "ts", 1e12, F.lit(NOW).cast("timestamp"))


@query(key_sql("SELECT o_custkey, o_orderstatus = 'O' AS taken, o_custkey IS NULL AS void, count(*) AS n FROM orders GROUP BY ALL"))
def dq_duplicate_current(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("current", F.when(F.col("o_orderstatus") == "O", " True ").otherwise("0"))
    return checks.duplicate_current(orders, ["o_custkey"], "current", row_no="o_orderkey")


# -- controls ----------------------------------------------------------------------------------------------------------

COPIED_SQL = "SELECT event_id, user_id, ts, event_id AS seq FROM events UNION ALL SELECT event_id, user_id, ts, event_id + 1000000000000 FROM events WHERE event_id % 20 = 0"


def copied(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_id").alias("seq"))
    return e.unionByName(e.where("event_id % 20 = 0").withColumn("seq", F.col("seq") + 10**12))


@query(f"SELECT * FROM ({COPIED_SQL}) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq) = 1")
def ctl_dedup_first(spark, sf_dir):
    return controls.dedup_first(copied(spark, sf_dir), "event_id", "seq")


@query(f"SELECT count(*) AS input_rows, count(DISTINCT event_id) AS kept_rows, count(*) - count(DISTINCT event_id) AS duplicates FROM ({COPIED_SQL})")
def ctl_dedup_count(spark, sf_dir):
    return controls.dedup_count(copied(spark, sf_dir), "event_id")


@query("SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 OR text IS NULL")
def ctl_dedup_text(spark, sf_dir):
    return controls.dedup_first(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


@query(f"SELECT DISTINCT event_id FROM ({COPIED_SQL}) WHERE event_id IS NOT NULL")
def sort_group_dedup(spark, sf_dir):
    return controls.adjacent_dedup(copied(spark, sf_dir), "event_id")


@query("SELECT event_id, ts, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-05'")
def ctl_backfill_window(spark, sf_dir):
    return controls.backfill_window(read(spark, sf_dir, "events").select("event_id", "ts", "user_id"), "ts", datetime(2024, 1, 2), datetime(2024, 1, 5))


@query(f"SELECT event_id AS row_number FROM ({KEYED_SQL}) WHERE k IS NULL OR k = ''")
def ctl_key_validation(spark, sf_dir):
    return controls.invalid_keys(keyed(spark, sf_dir), "k", "event_id")


# -- faults, recovery, compositions ------------------------------------------------------------------------------------

CANONICAL_SQL = "SELECT event_id, user_id AS entity_id, 'k' || user_id AS business_key, ts AS event_ts, event_id * 7 % 1000 AS value, event_id AS arrival_seq, '' AS tags FROM events"
FAULTED_SQL = f"""WITH c AS ({CANONICAL_SQL}),
    last AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_ts DESC, arrival_seq) = 1),
    a AS (SELECT * FROM c UNION ALL SELECT -entity_id - 1, entity_id, business_key, event_ts - INTERVAL 1 MICROSECOND, -entity_id - 1, entity_id + 100000000000, 'conflict' FROM last WHERE entity_id % 5 = 0),
    b AS (SELECT event_id, entity_id, business_key, event_ts, value, CASE WHEN event_id % 13 = 0 AND event_id >= 0 THEN arrival_seq + 1000000000000 ELSE arrival_seq END AS arrival_seq, CASE WHEN event_id % 13 = 0 AND event_id >= 0 THEN tags || 'late' ELSE tags END AS tags FROM a),
    d AS (SELECT event_id, entity_id, CASE WHEN event_id % 17 = 0 AND event_id >= 0 THEN NULL ELSE business_key END AS business_key, event_ts, value, arrival_seq, CASE WHEN event_id % 17 = 0 AND event_id >= 0 THEN tags || 'null_key' ELSE tags END AS tags FROM b),
    f AS (SELECT * FROM d UNION ALL SELECT event_id, entity_id, business_key, event_ts, value, arrival_seq + 2000000000000, tags || 'duplicate' FROM d WHERE event_id % 20 = 0 AND event_id >= 0)"""
BEFORE_SQL = "arrival_seq <= (SELECT max(event_id) // 2 FROM events)"
COLUMNS = ["event_id", "entity_id", "business_key", "event_ts", "value", "arrival_seq"]
own = lambda n: (F.col("event_id") % n == 0) & (F.col("event_id") >= 0)


def canonical(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("entity_id"), F.concat(F.lit("k"), F.col("user_id")).alias("business_key"), F.col("ts").alias("event_ts"), (F.col("event_id") * 7 % 1000).alias("value"), F.col("event_id").alias("arrival_seq"), F.array().cast("array<string>").alias("fault_tags"), F.lit(False).alias("is_recovery_replay"))


def oracle(spark, sf_dir):
    return state.latest_event_time(canonical(spark, sf_dir))


def faulted(spark, sf_dir):
    events = canonical(spark, sf_dir)
    df = faults.conflict(events, state.latest_event_time(events), F.col("entity_id") % 5 == 0)
    return faults.duplicate(faults.null_key(faults.late(df, own(13)), own(17)), own(20))


def before(spark, sf_dir):
    half = (read(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0) // 2
    return F.col("arrival_seq") <= half


replayed = lambda: F.col("event_id") % 3 == 0
ONE_FAULT = {
    "duplicate": (lambda df, o: faults.duplicate(df, own(20)), "SELECT * FROM c UNION ALL SELECT event_id, entity_id, business_key, event_ts, value, arrival_seq + 2000000000000, 'duplicate' FROM c WHERE event_id % 20 = 0"),
    "null_key": (lambda df, o: faults.null_key(df, own(17)), "SELECT event_id, entity_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE business_key END AS business_key, event_ts, value, arrival_seq, CASE WHEN event_id % 17 = 0 THEN 'null_key' ELSE '' END AS tags FROM c"),
    "late": (lambda df, o: faults.late(df, own(13)), "SELECT event_id, entity_id, business_key, event_ts, value, CASE WHEN event_id % 13 = 0 THEN arrival_seq + 1000000000000 ELSE arrival_seq END AS arrival_seq, CASE WHEN event_id % 13 = 0 THEN 'late' ELSE '' END AS tags FROM c"),
    "conflict": (lambda df, o: faults.conflict(df, o, F.col("entity_id") % 5 == 0), "SELECT * FROM a"),
}
for _fault, (_make, _sql) in ONE_FAULT.items():
    query(f"{FAULTED_SQL} SELECT * FROM ({_sql})", f"fault_{_fault}")(lambda spark, sf_dir, make=_make: make(canonical(spark, sf_dir), oracle(spark, sf_dir)).select(*COLUMNS, F.concat_ws("", "fault_tags").alias("tags")))

#: Deliveries of two stages: v0 is committed at the checkpoint, r are its replays, v2 is new after it; ids of replays are looked up.
STAGES_SQL = f"""{FAULTED_SQL}, v0 AS (SELECT * FROM f WHERE {BEFORE_SQL} AND business_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival_seq) = 1),
    r AS (SELECT event_id, entity_id, business_key, event_ts, value, arrival_seq + 100000000000000 AS arrival_seq FROM v0 WHERE event_id % 3 = 0),
    d2 AS (SELECT *, true AS replay FROM r UNION ALL SELECT event_id, entity_id, business_key, event_ts, value, arrival_seq + 200000000000000, false FROM f WHERE NOT ({BEFORE_SQL})),
    k2 AS (SELECT d2.*, EXISTS (SELECT 1 FROM v0 WHERE v0.event_id = d2.event_id) AS known FROM d2 WHERE business_key IS NOT NULL),
    v2 AS (SELECT * FROM k2 WHERE NOT known QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival_seq) = 1)"""
SUPPRESS_SQL = f"{STAGES_SQL}, w AS (SELECT event_id, entity_id, business_key, event_ts, value, arrival_seq, false AS replay FROM v0 UNION ALL SELECT event_id, entity_id, business_key, event_ts, value, arrival_seq, replay FROM v2)"
REPLAY_SQL = f"{STAGES_SQL}, w AS (SELECT event_id, entity_id, business_key, event_ts, value, arrival_seq, false AS replay FROM v0 UNION ALL SELECT event_id, entity_id, business_key, event_ts, value, arrival_seq, replay FROM v2 UNION ALL SELECT event_id, entity_id, business_key, event_ts, value, arrival_seq, replay FROM k2 WHERE replay AND known)"


def _run(spark, sf_dir, name):
    return compositions.run(faulted(spark, sf_dir), name, before(spark, sf_dir), replayed())


@query(f"{SUPPRESS_SQL} SELECT * EXCLUDE (replay) FROM w")
def recovery_replay_suppress(spark, sf_dir):
    return _run(spark, sf_dir, "S4").processed.select(*COLUMNS)


@query(f"{REPLAY_SQL} SELECT * EXCLUDE (replay) FROM w")
def recovery_replay_reprocess(spark, sf_dir):
    return _run(spark, sf_dir, "S2").processed.select(*COLUMNS)


def _metrics_sql(name: str, base: str, order: str) -> str:
    return f"""{base}, s AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY {order}) = 1), o AS (SELECT * FROM last),
    st AS (SELECT count(*) AS oracle_entities, count(*) FILTER (s.entity_id IS NOT NULL AND s.event_id = o.event_id AND s.business_key = o.business_key AND s.event_ts = o.event_ts AND s.value = o.value) AS entities_matching_oracle FROM o LEFT JOIN s USING (entity_id)),
    n AS (SELECT c.event_id, m.n FROM c LEFT JOIN (SELECT event_id, count(*) AS n FROM w GROUP BY 1) m USING (event_id)),
    i AS (SELECT count(*) AS recovery_denominator, count(n) AS recovered_expected_count, count(*) FILTER (n IS NULL) AS false_rejection_count, coalesce(sum(greatest(n - 1, 0)), 0)::BIGINT AS duplicate_leakage_count FROM n),
    x AS (SELECT (SELECT count(*) FROM w WHERE business_key IS NULL) AS invalid_key_leakage_count, (SELECT count(*) FROM k2 WHERE replay AND known) AS replays, (SELECT count(*) FROM w WHERE replay AND event_id IN (SELECT event_id FROM v0)) AS again, (SELECT count(*) FROM f WHERE tags LIKE '%duplicate%') AS dups, (SELECT count(*) FROM f WHERE tags LIKE '%null_key%') AS nulls)
    SELECT '{name}' AS strategy, oracle_entities, entities_matching_oracle, oracle_entities - entities_matching_oracle AS stale_state_count, duplicate_leakage_count, invalid_key_leakage_count, recovered_expected_count, recovery_denominator, false_rejection_count,
      replays AS already_committed_replay_count, again AS recovery_replays_reprocessed, replays - again AS recovery_replays_suppressed,
      round(entities_matching_oracle / greatest(oracle_entities, 1), 9) AS state_correctness_rate, round(duplicate_leakage_count / greatest(dups + replays, 1), 9) AS duplicate_leakage_rate, round(invalid_key_leakage_count / greatest(nulls, 1), 9) AS invalid_key_leakage_rate,
      round(recovered_expected_count / greatest(recovery_denominator, 1), 9) AS recovery_completeness_rate, round(false_rejection_count / greatest(recovery_denominator, 1), 9) AS false_rejection_rate, round(again / greatest(replays, 1), 9) AS recovery_duplicate_effect_rate
    FROM st, i, x"""


for _name, _spec in compositions.COMPOSITIONS.items():
    _base = SUPPRESS_SQL if _spec.idempotent else REPLAY_SQL
    _order = "event_ts DESC, arrival_seq" if _spec.temporal else "arrival_seq DESC"
    query(f"{_base} SELECT * EXCLUDE (replay) FROM w QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY {_order}) = 1", f"pipeline_{_name}_state")(
        lambda spark, sf_dir, name=_name: compositions.state(_run(spark, sf_dir, name).processed, name).select(*COLUMNS)
    )

    def _scored(spark, sf_dir, name=_name):
        return compositions.metrics(_run(spark, sf_dir, name), canonical(spark, sf_dir), name)

    query(_metrics_sql(_name, _base, _order), f"pipeline_{_name}_metrics")(_scored)


@query(f"{SUPPRESS_SQL} SELECT event_id FROM c WHERE event_id NOT IN (SELECT event_id FROM w)")
def metric_false_rejection(spark, sf_dir):
    valid = compositions.accepted(faulted(spark, sf_dir))
    return canonical(spark, sf_dir).select("event_id").join(valid.select("event_id"), "event_id", "left_anti")


@query(f"{REPLAY_SQL} SELECT event_id, count(*) - 1 AS extra FROM w WHERE event_id IN (SELECT event_id FROM c) GROUP BY 1 HAVING count(*) > 1")
def metric_duplicate_leakage(spark, sf_dir):
    valid = _run(spark, sf_dir, "S2").processed
    return valid.join(canonical(spark, sf_dir).select("event_id"), "event_id", "left_semi").groupBy("event_id").agg((F.count("*") - 1).alias("extra")).where("extra > 0")


@query(f"{CANONICAL_SQL.replace('events', 'events')} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1".replace("'' AS tags", "0 AS tags"))
def state_latest_event_time(spark, sf_dir):
    return oracle(spark, sf_dir).select(*COLUMNS, F.lit(0).alias("tags"))


@query(f"{FAULTED_SQL} SELECT event_id, entity_id, business_key, event_ts, value, arrival_seq FROM f QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY arrival_seq DESC) = 1")
def state_last_arrival(spark, sf_dir):
    return state.last_arrival(faulted(spark, sf_dir)).select(*COLUMNS)


@query("SELECT event_type, rate, count(*) AS cells, round(avg(hit), 9) AS mean_hit, round(median(hit), 9) AS median_hit FROM (SELECT event_type, user_id, rate, count(*) FILTER (event_id % rate = 0) / count(*) AS hit FROM events, (VALUES (10), (20), (100)) r(rate) GROUP BY ALL) GROUP BY ALL")
def matrix_summary(spark, sf_dir):
    """Means and medians over the cells of a matrix of parameters."""
    rates = F.explode(F.array(F.lit(10), F.lit(20), F.lit(100)))
    cells = read(spark, sf_dir, "events").select("event_id", "event_type", "user_id", rates.alias("rate")).groupBy("event_type", "user_id", "rate").agg((F.count_if(F.col("event_id") % F.col("rate") == 0) / F.count("*")).alias("hit"))
    return cells.groupBy("event_type", "rate").agg(F.count("*").alias("cells"), F.round(F.avg("hit"), 9).alias("mean_hit"), F.round(F.median("hit"), 9).alias("median_hit"))


# -- change data capture -----------------------------------------------------------------------------------------------

CHANGES_SQL = "SELECT event_id::VARCHAR AS event_id, user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS version, event_type || ':' || event_id AS value, event_type = 'error' AS deleted, event_id AS n FROM events"
DELIVERED_SQL = f"""c AS ({CHANGES_SQL}), u AS (SELECT event_id, key, version, value, deleted, CASE WHEN n % 13 = 0 THEN n + 1000000000 ELSE n END AS arrives FROM c
    UNION ALL SELECT event_id, key, version, value, deleted, n + 2000000000 FROM c WHERE n % 20 = 0
    UNION ALL SELECT 's' || event_id, key, version, value, deleted, n + 3000000000 FROM c WHERE n % 11 = 0),
    e AS (SELECT event_id, key, version, value, deleted, arrives AS q FROM u)"""
CONFLICTED_SQL = f"{DELIVERED_SQL}, k AS (SELECT * FROM e UNION ALL SELECT event_id, key, version, value || '!', deleted, n + 4000000000 FROM c WHERE n % 101 = 0 UNION ALL SELECT 'x' || event_id, key, version, value || '?', deleted, n + 5000000000 FROM c WHERE n % 103 = 0)"


def changes(spark, sf_dir):
    """Versions by event time; a change is a tombstone if the event is an error."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    version = F.row_number().over(Window.partitionBy("user_id").orderBy("ts")).cast("long")
    return e.select(F.col("event_id").cast("string").alias("event_id"), F.col("user_id").alias("key"), version.alias("version"), F.concat("event_type", F.lit(":"), "event_id").alias("value"), (F.col("event_type") == "error").alias("deleted"), F.col("event_id").alias("n"))


def delivered(spark, sf_dir):
    """Changes with some late, some delivered twice, and some sent again under another id."""
    c = changes(spark, sf_dir)
    at = lambda d, k: d.withColumn("q", F.col("n") + k)
    first = c.withColumn("q", F.when(F.col("n") % 13 == 0, F.col("n") + 1_000_000_000).otherwise(F.col("n")))
    again = at(c.where("n % 11 = 0"), 3_000_000_000).withColumn("event_id", F.concat(F.lit("s"), F.col("event_id")))
    return first.unionByName(at(c.where("n % 20 = 0"), 2_000_000_000)).unionByName(again).drop("n")


def conflicted(spark, sf_dir):
    c = changes(spark, sf_dir)
    by_id = c.where("n % 101 = 0").select("event_id", "key", "version", F.concat("value", F.lit("!")).alias("value"), "deleted", (F.col("n") + 4_000_000_000).alias("q"))
    by_version = c.where("n % 103 = 0").select(F.concat(F.lit("x"), "event_id").alias("event_id"), "key", "version", F.concat("value", F.lit("?")).alias("value"), "deleted", (F.col("n") + 5_000_000_000).alias("q"))
    return delivered(spark, sf_dir).unionByName(by_id).unionByName(by_version)


@query(f"WITH {DELIVERED_SQL} SELECT key, version, value, deleted FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC, q) = 1")
def state_latest_version(spark, sf_dir):
    return state.latest_version(delivered(spark, sf_dir))


@query(f"WITH {CONFLICTED_SQL} SELECT event_id, count(*) AS payloads FROM (SELECT DISTINCT event_id, key, version, value, deleted FROM k) GROUP BY 1 HAVING count(*) > 1")
def cdc_conflict_ids(spark, sf_dir):
    return cdc.conflicting_ids(conflicted(spark, sf_dir))


@query(f"WITH {CONFLICTED_SQL} SELECT key, version, count(*) AS payloads FROM (SELECT DISTINCT key, version, value, deleted FROM k) GROUP BY 1, 2 HAVING count(*) > 1")
def cdc_conflict_versions(spark, sf_dir):
    return cdc.conflicting_versions(conflicted(spark, sf_dir))


def decided_sql(strategy: str, source: str = "e") -> str:
    first = "first_value({0}) OVER (PARTITION BY event_id ORDER BY q)"
    other = " OR ".join(f"{c} <> {first.format(c)}" for c in ("key", "version", "value", "deleted"))
    by_key = "OVER (PARTITION BY key ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    same = "first_value({0}) OVER (PARTITION BY key, version ORDER BY q)"
    ids = f"WHEN row_number() OVER (PARTITION BY event_id ORDER BY q) > 1 AND ({other}) THEN 'conflict' WHEN row_number() OVER (PARTITION BY event_id ORDER BY q) > 1 THEN 'duplicate'"
    versions = f"WHEN version = max(version) {by_key} AND (value <> {same.format('value')} OR deleted <> {same.format('deleted')}) THEN 'conflict' WHEN version < max(version) {by_key} THEN 'stale'"
    case = {"arrival": "", "id_only": ids, "version": ids + " " + versions}[strategy]
    decision = f"CASE {case} ELSE 'applied' END" if case else "'applied'"
    return f"""g AS (SELECT *, {decision} AS decision FROM {source}),
    h AS (SELECT *, decision = 'applied' AND coalesce(last_value(CASE WHEN decision = 'applied' THEN version END IGNORE NULLS) {by_key} > version, false) AS regressed FROM g),
    z AS (SELECT * FROM h WHERE q <= coalesce((SELECT min(q) FROM h WHERE decision = 'conflict'), 9000000000000000))"""


for _strategy in cdc.STRATEGIES:
    query(f"WITH {DELIVERED_SQL}, {decided_sql(_strategy)} SELECT q, event_id, key, version, decision, regressed FROM z", f"cdc_replay_decisions_{_strategy}")(
        lambda spark, sf_dir, strategy=_strategy: cdc.decisions(delivered(spark, sf_dir), strategy).select("q", "event_id", "key", "version", "decision", "regressed")
    )


@query(f"WITH {CONFLICTED_SQL}, {decided_sql('version', 'k')} SELECT decision, count(*) AS deliveries, max(q) AS last_q FROM z GROUP BY 1")
def cdc_first_conflict(spark, sf_dir):
    return cdc.decisions(conflicted(spark, sf_dir), "version").groupBy("decision").agg(F.count("*").alias("deliveries"), F.max("q").alias("last_q"))


#: Offsets: half and three quarters of the first deliveries, and where all deliveries end.
TOTAL = 4_000_000_000
PHASES_SQL = f"""WITH {DELIVERED_SQL}, {decided_sql('arrival')}, m AS (SELECT max(event_id) AS m FROM events),
    p AS (SELECT z.*, unnest(list_filter([CASE WHEN q < m * 3 // 4 THEN 'attempt' END, CASE WHEN q >= m // 2 THEN 'restart' END], lambda x: x IS NOT NULL)) AS phase, m // 2 AS cp FROM z, m)"""


def _phased(spark, sf_dir):
    m = read(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    return cdc.phased(cdc.decisions(delivered(spark, sf_dir), "arrival"), TOTAL, m // 2, m * 3 // 4), m // 2


@query(f"{PHASES_SQL} SELECT phase, decision, count(*) AS deliveries FROM p GROUP BY ALL")
def cdc_phase_counters(spark, sf_dir):
    return cdc.counters(_phased(spark, sf_dir)[0])


@query(f"{PHASES_SQL} SELECT count(*) FILTER (regressed AND phase = 'attempt') AS attempted, count(*) FILTER (regressed AND phase = 'attempt' AND q < cp) AS committed_prefix, count(*) FILTER (regressed AND phase <> 'attempt') AS recovered FROM p")
def cdc_violations(spark, sf_dir):
    return cdc.violations(*_phased(spark, sf_dir))


@query(f"""WITH {DELIVERED_SQL}, {decided_sql('arrival')},
    a AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY key ORDER BY q DESC) = 1), x AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC) = 1)
    SELECT coalesce(a.key, x.key) AS key, CASE WHEN a.key IS NULL THEN 'missing key' WHEN x.key IS NULL THEN 'unexpected key' WHEN a.version < x.version THEN 'stale version' WHEN a.version > x.version THEN 'unexpected newer version' ELSE 'payload/tombstone mismatch' END AS reason
    FROM a FULL JOIN x ON a.key = x.key WHERE a.key IS NULL OR x.key IS NULL OR a.version <> x.version OR a.value <> x.value OR a.deleted <> x.deleted""")
def cdc_state_diff(spark, sf_dir):
    return state.diff(cdc.final_state(cdc.decisions(delivered(spark, sf_dir), "arrival")), state.latest_version(changes(spark, sf_dir)))


@query("SELECT true AS unchanged, count(DISTINCT user_id) AS keys FROM events")
def cdc_redelivery_idempotent(spark, sf_dir):
    """Delivering everything again, backwards, leaves the state of the version policy as it is."""
    once = delivered(spark, sf_dir)
    end = (once.agg(F.max("q")).first()[0] or 0) + 1
    one, two = (cdc.final_state(cdc.decisions(d, "version")) for d in (once, cdc.redelivered(once, end)))
    return one.groupBy().agg(F.count("*").alias("keys")).join(F.broadcast(state.diff(two, one).agg((F.count("*") == 0).alias("unchanged"))), F.lit(True)).select("unchanged", "keys")


@query()
def ledger_fifo_probe(spark, sf_dir):
    """Sixteen keys in four versions, then a probe of the first id: exact and changed, or changed at once."""
    base = spark.range(64).select((F.col("id")).alias("q"), F.format_string("b%d:v%d", (F.col("id") / 4).cast("int"), (F.col("id") % 4 + 1).cast("int")).alias("event_id"), F.concat(F.lit("b"), (F.col("id") / 4).cast("int")).alias("key"), (F.col("id") % 4 + 1).alias("version"), F.concat(F.lit("value-"), F.col("id")).alias("value"), (F.col("id") % 4 == 2).alias("deleted"))
    first = base.where("q = 0")
    bad = first.withColumn("value", F.lit("conflicting"))
    orders = {"conflict_first": base.unionByName(bad.withColumn("q", F.lit(64).cast("long"))), "exact_then_conflict": base.unionByName(first.withColumn("q", F.lit(64).cast("long"))).unionByName(bad.withColumn("q", F.lit(65).cast("long")))}
    cells = [df.withColumns({"run_id": F.lit(f"{s}/{'all' if c is None else c}/{o}"), "strategy": F.lit(s), "capacity": F.lit(c).cast("long")}) for o, df in orders.items() for s in cdc.STRATEGIES for c in (0, 4, 16, None)]
    runs = cells[0]
    for more in cells[1:]:
        runs = runs.unionByName(more)
    played = ledger.replay_bounded(runs)
    return played.groupBy("run_id").agg(F.count_if(F.col("decision") == "conflict").alias("conflicts"), F.count_if((F.col("decision") == "duplicate") & (F.col("q") >= 64)).alias("exact_recognized"), F.max("ledger_peak").alias("ledger_peak"))


@query(f"WITH {DELIVERED_SQL} SELECT key, version, value, deleted FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC, q) = 1")
def cdc_stream_restart(spark, sf_dir):
    """The latest state, kept by a stream that stops halfway and starts again from its checkpoint."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = delivered(spark, sf_dir).withColumn("part", (F.col("q") % 2).cast("int")).select("key", "version", "value", "deleted", "part").withColumn("key", F.col("key").cast("long"))
    committed = -1
    for half in (0, 1):
        rows.where(F.col("part") == half).drop("part").write.mode("append").parquet(f"{root}/in")
        stream = materializer.materialize(spark.readStream.schema(materializer.SCHEMA).parquet(f"{root}/in"), f"{root}/state", f"{root}/checkpoint")
        stream.awaitTermination()
        committed = max(committed, materializer.committed(stream))
    return materializer.table(spark, f"{root}/state", committed)


# -- generators and experiments ----------------------------------------------------------------------------------------


@query("SELECT v * 64 + k AS q, 'b' || k || ':v' || (v + 1) AS event_id, 'k' || k AS key, v + 1 AS version, 'value-' || (v + 1) AS value, v = 2 AS deleted FROM range(64) a(k), range(4) b(v)")
def gen_changes(spark, sf_dir):
    return generators.changes(spark, 64)


@query("SELECT 'e' || i AS event_id, 'entity-' || i % 500 AS entity_id, 'k' || i AS business_key, TIMESTAMP '2026-04-01' + INTERVAL 1 SECOND * i AS event_ts, ('0x' || substr(md5('7:' || i), 1, 12))::BIGINT % 1000000 + 1 AS value, i AS arrival_seq FROM range(10000) r(i)")
def gen_hashed_events(spark, sf_dir):
    events = generators.hashed_events(spark, 10_000, 7)
    return events.select("event_id", "entity_id", "business_key", F.col("event_ts").cast("timestamp_ntz").alias("event_ts"), "value", "arrival_seq")


@query("SELECT false AS passed, false AS strict, 3::BIGINT AS rows_checked, 1::BIGINT AS invalid_key_rows, 3::BIGINT AS selected_rows, 1::BIGINT AS duplicate_groups, 2::BIGINT AS duplicate_rows, 1::BIGINT AS excess_rows, 1::BIGINT AS null_key_rows_excluded")
def source_example(spark, sf_dir):
    """The built-in three rows under the duplicate check."""
    from .cli import EXAMPLE, EXAMPLE_COLUMNS

    return checks.duplicate_keys(spark.createDataFrame(EXAMPLE, EXAMPLE_COLUMNS), ["id"])


for _tie, _sql in {"first_arrival": "event_id", "event_id": "event_id::VARCHAR DESC", "last_arrival": "event_id DESC"}.items():
    # event times cut to days tie often
    query(f"SELECT user_id AS entity_id, date_trunc('day', ts)::TIMESTAMP AS event_ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, {_sql}) = 1", f"state_tie_{_tie}")(
        lambda spark, sf_dir, tie=_tie: state.latest_event_time(read(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("event_ts"), "event_id", F.col("event_id").alias("arrival_seq")), tie=tie).select("entity_id", "event_ts", "event_id")
    )


@query(f"{FAULTED_SQL} SELECT entity_id, count(*) AS deliveries, count(*) FILTER (back) AS out_of_order FROM (SELECT entity_id, event_ts < lag(event_ts) OVER (PARTITION BY entity_id ORDER BY arrival_seq) AS back FROM f) GROUP BY 1")
def event_time_order(spark, sf_dir):
    """Deliveries that go back in event time, for each entity."""
    return state.order_breaks(faulted(spark, sf_dir))


@query()
def lab_strategy_report(spark, sf_dir):
    """Right, wrong and rejected runs and the violations of each policy over all scenarios."""
    return lab.by_strategy(lab.observe(spark))


@query()
def ledger_expiry_report(spark, sf_dir):
    return lab.expiry_probe(spark)


for _suite in (1, 2, 3):
    query(name=f"suite_{_suite}_summary")(lambda spark, sf_dir, suite=_suite: suites.summary(suites.observe(spark, suites.grid(suite))))
query(name="suite_4_summary")(lambda spark, sf_dir: matrix.summary(matrix.observe_prefix(spark, matrix.grid(4))))
query(name="suite_5_summary")(lambda spark, sf_dir: matrix.summary(matrix.observe_recovery(spark, matrix.grid(5))))
