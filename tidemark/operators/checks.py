"""Data-quality checks: each is one row of facts from one aggregation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import flag, instant, no_key, stripped


class CheckError(ValueError):
    """The parameters or the data don't allow the check."""


def normalized(df: DataFrame, keys: list[str]) -> list[Column]:
    """Key columns; text is stripped, a null becomes an empty key."""
    if not keys or len(set(keys)) != len(keys):
        raise CheckError("provide one or more distinct keys")
    text = dict(df.dtypes)
    return [(F.coalesce(stripped(F.col(k)), F.lit("")) if text[k] == "string" else F.col(k)).alias(k) for k in keys]


def any_missing(keys: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [no_key(k) for k in keys])


def key_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: rows of each key that occurs more than once; keys with a missing part don't count."""
    return df.select(*normalized(df, keys)).where(~any_missing(keys)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_keys(df: DataFrame, keys: list[str], strict: bool = False, selected: Column | None = None) -> DataFrame:
    """Duplicate keys among the rows that `selected` takes (all by default). Rows are counted by key before they are
    shuffled, so a frequent key costs one row a task."""
    take = F.lit(True) if selected is None else F.coalesce(selected, F.lit(False))
    rows = df.select(*normalized(df, keys), take.alias("taken_"))
    sizes = rows.groupBy(*keys, "taken_").agg(F.count("*").alias("n_")).withColumn("void_", any_missing(keys))
    taken, void, n = F.col("taken_"), F.col("void_"), F.col("n_")
    double = taken & ~void & (n > 1)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    facts = sizes.agg(
        total(F.lit(True)).alias("rows_checked"),
        total(void).alias("invalid_key_rows"),
        total(taken).alias("selected_rows"),
        F.count_if(double).alias("duplicate_groups"),
        total(double).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(double, n - 1)), F.lit(0)).alias("excess_rows"),
        total(taken & void).alias("null_key_rows_excluded"),
    )
    passed = (F.col("rows_checked") > 0) & (F.col("duplicate_groups") == 0)
    if strict:
        passed &= F.col("invalid_key_rows") == 0
    return facts.select(passed.alias("passed"), F.lit(strict).alias("strict"), *facts.columns)


def duplicate_current(df: DataFrame, keys: list[str], current: str, strict: bool = False, row_no: str | None = None) -> DataFrame:
    """Duplicate keys among current rows. With row_no, the first row whose flag can't be read is an error."""
    if row_no:
        bad = df.where(flag(current).isNull()).agg(F.min(row_no)).first()[0]
        if bad is not None:
            raise CheckError(f"data row {bad}: current flag must be true, false, 1, or 0")
    return duplicate_keys(df, keys, strict, flag(current))


def null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    facts = df.select(*normalized(df, keys)).agg(F.count("*").alias("rows_checked"), F.count_if(any_missing(keys)).alias("invalid_rows"))
    return facts.select(((F.col("rows_checked") > 0) & (F.col("invalid_rows") == 0)).alias("passed"), "rows_checked", "invalid_rows")


def null_key_sample(df: DataFrame, keys: list[str], row_no: str, most: int = 20) -> DataFrame:
    """The first rows with a missing key: a top-k, never a full sort."""
    return df.select(F.col(row_no).alias("row_number"), *[c.alias(f"k{i}") for i, c in enumerate(normalized(df, keys))]).where(any_missing([f"k{i}" for i in range(len(keys))])).select("row_number").orderBy("row_number").limit(most)


def freshness(df: DataFrame, column: str, max_age_seconds: float, now: Column, row_no: str | None = None) -> DataFrame:
    """Age of the latest instant; passes from 0 to max_age_seconds. Text columns must hold zoned ISO-8601 instants."""
    if max_age_seconds is None or not math.isfinite(max_age_seconds) or max_age_seconds < 0:
        raise CheckError("max_age_seconds must be a finite nonnegative number")
    time = F.col(column)
    if dict(df.dtypes)[column] == "string":
        time = instant(column)
        if row_no:
            bad = df.where(time.isNull()).agg(F.min(row_no)).first()[0]
            if bad is not None:
                raise CheckError(f"data row {bad}: timestamps must be ISO 8601 with a timezone")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    facts = df.agg(F.count("*").alias("rows_checked"), F.max(time).alias("latest_timestamp"), F.count_if(micros(time) > micros(now)).alias("future_timestamp_count"))
    age = (micros(now) - micros(F.col("latest_timestamp"))) / 1e6
    return facts.select(F.coalesce(age.between(0, max_age_seconds), F.lit(False)).alias("passed"), "rows_checked", "latest_timestamp", age.alias("age_seconds"), F.lit(float(max_age_seconds)).alias("max_age_seconds"), "future_timestamp_count")
