"""Sessions with the settings the plans are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[*]", partitions: int = 8, **more: str) -> SparkSession:
    """A session; partitions should make a shuffled partition about 100 MB at the size at hand."""
    builder = SparkSession.builder.master(master).appName("tidemark").config(map={**SETTINGS, "spark.sql.shuffle.partitions": str(partitions), **more})
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
