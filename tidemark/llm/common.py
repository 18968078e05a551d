"""Shared helpers: inputs, durable intermediate tables, Arrow batches."""

from __future__ import annotations

import ctypes

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, release, settled, shared_dir  # noqa: F401


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id BIGINT, text STRING); a null text counts as empty. Other columns are dropped, whatever their names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def dealt_join(rows: DataFrame, few: DataFrame, key: str, by, how: str = "inner", salts: int = 16) -> DataFrame:
    """rows join few on key; few has one row a key. A key that very many rows share is dealt over `salts` tasks by the
    column `by`."""
    by = F.xxhash64(by) if isinstance(by, str) else by
    left = rows.withColumn("join_salt_", F.pmod(by, F.lit(salts)).cast("int"))
    right = few.withColumn("join_salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "join_salt_"], how).drop("join_salt_")


def skewed_join(rows: DataFrame, few: DataFrame, key: str, by: str, salts: int = 64) -> DataFrame:
    """rows join few on key; few has one row a key. Only keys that over 1,000 and over a 10,000th of the rows share are
    dealt over `salts` tasks; they are fewer than 10,000, so their names are broadcast."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = rows.count()
    hot = materialize(counts.where(F.col("n") > max(1000, total // 10_000)).select(key, F.lit(True).alias("join_hot_")), "hot-keys")
    if hot.isEmpty():
        return rows.join(few, key)
    on = F.coalesce("join_hot_", F.lit(False))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("join_salt_", F.when(on, F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(0).cast("int")).drop("join_hot_")
    each = F.explode(F.when(on, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    right = few.join(F.broadcast(hot), key, "left").withColumn("join_salt_", each).drop("join_hot_")
    return left.join(right, [key, "join_salt_"]).drop("join_salt_")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def slices(batches, rows: int = 512, column: str = "text", most: int = 8 << 20):
    """Cut Arrow batches so that no piece holds more than `rows` rows or, beyond one row, `most` bytes of `column`."""
    for b in batches:
        sizes = pc.binary_length(b.column(column)).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (i - start >= rows or held + (n or 0) > most):
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < len(sizes):
            yield b.slice(start)
    give_back()
