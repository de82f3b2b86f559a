"""Writers with a fixed column order."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionmatch.operators.manifest import manifest_order
from motionmatch.schemas import MANIFEST_COLUMNS, RESULT_COLUMNS
from motionmatch.sources.files import move, remove


# Text goes out and comes back as it is.
CSV = {"header": True, "emptyValue": "", "ignoreLeadingWhiteSpace": False,
       "ignoreTrailingWhiteSpace": False}
# Tasks put their own files in place; by default the driver moves all of them one after another. For scratch
# folders of very many files: one that a failed job leaves is not read.
MANY_FILES = ("mapreduce.fileoutputcommitter.algorithm.version", "2")


def write_manifest(rows: DataFrame, path: str) -> int:
    """Write the manifest in its order; returns the row count of what was written."""
    ordered = rows.select(*MANIFEST_COLUMNS).orderBy(*manifest_order())
    ordered.write.mode("overwrite").options(**CSV).csv(path)
    return rows.sparkSession.read.option("header", True).csv(path).count()


def write_result_csv(results: DataFrame, path: str) -> None:
    """Result rows sorted by sample and repeat; booleans lower case, null blank."""
    rows = results.withColumn("score", F.coalesce("score", F.lit(0)))
    rows.select(*RESULT_COLUMNS).orderBy("sample_id", "repeat_index").write.mode(
        "overwrite").options(**CSV).csv(path)


def write_small(report: DataFrame, path: str, kind: str = "json") -> None:
    """A report of bounded size as one file, in the order given."""
    text = CSV if kind == "csv" else {}
    report.coalesce(1).write.mode("overwrite").options(**text).format(kind).save(path)


def write_calibration(spark: SparkSession, folder: str, metadata: dict, comparison: DataFrame, predictions: DataFrame) -> None:
    """Metadata, metrics, comparison and predictions of a calibration, all or none of them.

    Everything is written beside its place first; the folder is renamed last. Reports are ordered by their
    keys, so a rerun writes the same rows in the same files; an older report of that name is replaced.
    """
    folder = folder.rstrip("/")
    stage = f"{folder}.stage"
    remove(spark, stage)
    rows = comparison.orderBy("decider", "split")
    write_small(rows, f"{stage}/comparison")
    write_small(rows.where("decider = 'calibrated'").drop("decider"), f"{stage}/metrics")
    text = json.dumps(metadata, sort_keys=True, allow_nan=False)
    write_small(spark.createDataFrame([(text,)], "value string"), f"{stage}/metadata", "text")
    predictions.orderBy("split", "sample_id").write.parquet(f"{stage}/predictions")
    move(spark, stage, folder)


def append_attempts(spark: SparkSession, rows: DataFrame, path: str,
                    key: str = "attempt_id") -> None:
    """Append attempts the table does not hold yet; a stored attempt never changes."""
    fresh = rows.dropDuplicates([key])
    try:
        stored = spark.read.schema(fresh.schema).parquet(path).select(key)
        fresh = fresh.join(stored, key, "left_anti")
    except Exception as error:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(error):
            raise
    fresh.write.mode("append").parquet(path)
