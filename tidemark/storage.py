"""Intermediate tables in the folder that all executors share: they cut lineage and outlive lost executors.

A table's shuffle files are deleted as soon as it is written, instead of when the driver happens to collect its garbage;
the tables that only served to make another one are deleted by `settled`.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: What settled() has to delete.
_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)
#: While a table is written: no shuffle file outlives it, and no batch for Python is large.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local session without the setting gets a folder that ends with the process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, WRITING):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if (made := _MADE.get()) is not None:
        made.append(out)
    return out


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make gives, materialized; tables that were materialized to make it are deleted."""
    token = _MADE.set(made := [])
    try:
        out = materialize(make(), name)
    finally:
        _MADE.reset(token)
    release(*made[:-1])
    if (outer := _MADE.get()) is not None:
        outer.append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
