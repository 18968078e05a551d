"""Reliability controls."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import no_key


def dedup_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row by `order` of each key; rows whose key is null all stay. Rows of a key meet as one partial
    aggregate a task, so a frequent key doesn't gather in one."""
    named = df.where(F.col(key).isNotNull())
    first = named.groupBy(F.col(key).alias("key_")).agg(F.min_by(F.struct(*df.columns), order).alias("r_")).select("r_.*")
    return first.unionByName(df.where(F.col(key).isNull()))


def dedup_count(df: DataFrame, key: str) -> DataFrame:
    """input, kept and dropped rows of dedup_first."""
    facts = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"), F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n")).otherwise(1)), F.lit(0)).alias("kept_rows"))
    return facts.select("input_rows", "kept_rows", (F.col("input_rows") - F.col("kept_rows")).alias("duplicates"))


def adjacent_dedup(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys by sorting: the comparator of dedup_first. Sorting runs in range partitions."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().sort(key)


def invalid_keys(df: DataFrame, key: str, row_no: str) -> DataFrame:
    return df.where(no_key(key)).select(F.col(row_no).alias("row_number"))


def backfill_window(df: DataFrame, column: str, start: datetime, end: datetime) -> DataFrame:
    """Rows with start <= column < end; the bounds reach the scan."""
    if start >= end:
        raise ValueError("start must be before end")
    if (start.tzinfo is None) != (end.tzinfo is None):
        raise ValueError("both bounds need a zone, or neither")
    kind = dict(df.dtypes)[column]
    if kind == "timestamp" and start.tzinfo is None:
        raise ValueError("bounds need a zone")
    low, high = (F.lit(x.isoformat(sep=" ")).cast(kind) for x in (start, end))
    return df.where((F.col(column) >= low) & (F.col(column) < high))


def audit_record(pipeline: str, run_id: str, status: str, processed: int, duplicates: int = 0) -> dict:
    if status not in ("SUCCEEDED", "FAILED"):
        raise ValueError("status must be SUCCEEDED or FAILED")
    return {"pipeline": pipeline, "run_id": run_id, "status": status, "processed": processed, "duplicates": duplicates}
