"""Running a stream over what has arrived, and reading what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motionmatch.sources.files import is_folder
from motionmatch.sources.scratch import scratch_path


def read_files(spark: SparkSession, folder: str, pattern: str, schema, *,
               files_per_trigger: int | None = None) -> DataFrame:
    """File stream over Parquet files of ``folder`` that match ``pattern``; where that names a folder, over the files in it.

    The filter goes by the names of files: it would pass over all the parts of a table that is a folder.
    """
    table = f"{folder.rstrip('/')}/{pattern}"
    whole = not set(pattern) & set("*?[{") and is_folder(spark, table)
    reader = spark.readStream.schema(schema)
    if not whole:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(table if whole else folder)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available into a written table and read it back."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    query = (stream.writeStream.format("parquet").option("checkpointLocation", state)
             .outputMode("append").trigger(availableNow=True).start(out))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
