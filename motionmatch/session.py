"""Session settings the jobs are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits hot keys of joins that no aggregate on the same key follows.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Local merge lets a hot session key shrink before its shuffle.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Wide vectors: a batch of 512 rows x 22,080 floats is 45 MB.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    # A reader's 4,096 such rows with their levels are over 1 GB a task.
    "spark.sql.parquet.columnarReaderBatchSize": "256",
    # Folders of very many files are listed by so many tasks, not by one a folder.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "96",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session made elsewhere; all can change at run time."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "motionmatch", master: str | None = None,
                  **overrides: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
