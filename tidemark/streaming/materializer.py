"""A versioned state table kept up by a stream.

Each micro-batch folds its changes into the last committed table and writes the next one, named by the batch. A batch
that runs again after a restart writes the same table again, so a checkpoint and its table always agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import latest_version

SCHEMA = "key long, version long, value string, deleted boolean"


def table(spark: SparkSession, path: str, batch: int) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{path}/batch={batch}") if batch >= 0 else spark.createDataFrame([], SCHEMA)


def materialize(changes: DataFrame, path: str, checkpoint: str):
    """Start the stream over what is available now; returns the streaming query."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        merged = table(spark, path, number - 1).unionByName(batch.select("key", "version", "value", "deleted"))
        latest_version(merged).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(query) -> int:
    """Number of the last batch."""
    return query.lastProgress["batchId"] if query.lastProgress else -1
