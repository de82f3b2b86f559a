"""The shared folder for checkpoints and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: the cluster's ``spark.checkpoint.dir``.

    A folder of our own is made only in local mode with the setting absent; on a
    cluster a machine-local folder would lose its files with the machine.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="motionmatch-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(rows: DataFrame, name: str, reader: SparkSession | None = None) -> DataFrame:
    """The rows written once and read back, for costly rows that are read more than once.

    ``reader`` is another session to read them in: that of a running stream plans without adaptive execution.
    """
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return (reader or rows.sparkSession).read.schema(rows.schema).parquet(path)
