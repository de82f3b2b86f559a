"""Strict reads with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionmatch.operators.keypoint_rules import typed_keypoints
from motionmatch.schemas import CALIBRATION_COLUMNS, KEYPOINT_COLUMNS, MANIFEST_COLUMNS

CORRUPT = "_corrupt"


def strict_csv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Text columns of CSV files whose header must be exactly ``columns``.

    Rows with too few or too many fields keep their line in ``_corrupt``, whichever
    columns are read: with pruning the parser would not count the fields. A wrong
    header fails the read.
    """
    schema = ", ".join(f"`{c}` STRING" for c in (*columns, CORRUPT))
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            .option("columnPruning", False)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .option("nullValue", "\u0000").option("emptyValue", "").csv(paths))


def numbered(rows: DataFrame, first: int = 2) -> DataFrame:
    """Add ``row_number``: the place of a row in its file, from ``first``.

    Rows are counted per split of a file, and the counts before each split added up; there is
    one small row per split.
    """
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"),
                         F.col("_metadata.file_block_start").alias("_split"),
                         F.monotonically_increasing_id().alias("_at"))
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = placed.groupBy("_file", "_split").agg(F.count("*").alias("_n"), F.min("_at").alias("_least")).select(
        "_file", "_split", "_least", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(splits, ["_file", "_split"]).withColumn(
        "row_number", F.col("_at") - F.col("_least") + F.col("_before") + first).drop(
        "_file", "_split", "_at", "_least", "_before")


def plain_path(column: Column) -> Column:
    """Local file URIs as plain paths; other schemes stay."""
    return F.regexp_replace(F.url_decode(column), "^file:/+", "/")


def scan_keypoints(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Typed keypoints (sequence_id, frame, landmark, x, y, z, _corrupt, row_number).

    One file is one sequence. Apply ``keypoint_issues`` before use.
    """
    raw = strict_csv(spark, paths, KEYPOINT_COLUMNS)
    return typed_keypoints(raw.select(
        plain_path(F.col("_metadata.file_path")).alias("sequence_id"), "*",
        F.monotonically_increasing_id().alias("row_number")))


def empty_files(listing: DataFrame, points: DataFrame) -> DataFrame:
    """Listed keypoint files (path) without a single row."""
    return listing.join(points.select(F.col("sequence_id").alias("path")).distinct(),
                        "path", "left_anti")


def scan_manifest(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame]:
    """(rows with row_number, issues of the file itself).

    Rows are None when the file is missing or its columns are wrong. Row numbers
    start at 2 and follow file order within one file.
    """
    def issue(code: str, message: str) -> DataFrame:
        return spark.createDataFrame([(code, None, None, message)],
                                     "code string, row_number long, column string, message string")

    try:
        header = spark.read.text(path).first()
    except AnalysisException as error:
        return None, issue("manifest_missing", str(error).splitlines()[0])
    found = (header["value"].lstrip("﻿") if header else "").split(",")
    if tuple(found) != MANIFEST_COLUMNS:
        return None, issue("columns", f"expected {list(MANIFEST_COLUMNS)}, found {found}")
    rows = numbered(strict_csv(spark, path, MANIFEST_COLUMNS))
    empty = rows.agg(F.count("*").alias("n")).where("n = 0").select(
        F.lit("empty").alias("code"), F.lit(None).cast("long").alias("row_number"),
        F.lit(None).cast("string").alias("column"),
        F.lit("manifest contains no sample rows").alias("message"))
    # A CSV read may not look at the corrupt column alone.
    broken = rows.where(f"{CORRUPT} is not null and coalesce(length(sample_id), 0) >= 0").select(
        F.lit("manifest_read").alias("code"), "row_number",
        F.lit(None).cast("string").alias("column"),
        F.concat(F.lit("malformed row of sample "), F.coalesce("sample_id", F.lit(""))).alias("message"))
    return rows.drop(CORRUPT), empty.unionByName(broken)


def scan_results(spark: SparkSession, path: str) -> DataFrame:
    """Calibration input as text: the required columns, whatever else the file holds."""
    header = spark.read.text(path).first()
    columns = (header["value"].lstrip("﻿") if header else "").split(",")
    missing = [c for c in CALIBRATION_COLUMNS if c not in columns]
    if missing or len(set(columns)) != len(columns):
        raise ValueError(f"missing or repeated columns: {missing or columns}")
    # A filter is evaluated whichever columns are asked for; it must look at one beside the line.
    sound = F.when(F.col(CORRUPT).isNotNull() & (F.coalesce(F.length("sample_id"), F.lit(0)) >= 0), F.raise_error(
        F.concat(F.lit("malformed row: "), F.col(CORRUPT))).cast("boolean")).otherwise(True)
    rows = numbered(strict_csv(spark, path, columns).where(sound))
    return rows.select("row_number", *CALIBRATION_COLUMNS)


LIBRARY_SCHEMA = ("ref_id LONG, word STRING, slug STRING, path STRING, lecture STRING, "
                  "topic STRING, sentence STRING, embedding ARRAY<FLOAT>")


def scan_library(spark: SparkSession, path: str) -> DataFrame:
    """Reference library; pushed filters and pruned columns reach the Parquet scan."""
    return spark.read.schema(LIBRARY_SCHEMA).parquet(path)


def list_media(spark: SparkSession, root: str, extensions: Sequence[str]) -> DataFrame:
    """(path, rel_path, word, length, modified) of files below ``root``, recursively.

    File contents are never read. The word is the first folder. A missing root is
    an empty listing.
    """
    try:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
                 .select("path", "length", "modificationTime"))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        files = spark.createDataFrame([], "path string, length long, modificationTime timestamp")
    path = plain_path(F.col("path"))
    base = root.removeprefix("file://").rstrip("/") + "/"
    below = F.substring(path, len(base) + 1, 1 << 30)
    wanted = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(
        *[e.lower().lstrip(".") for e in extensions])
    return files.where(wanted).select(
        path.alias("path"), below.alias("rel_path"),
        F.get(F.split(below, "/"), F.lit(0)).alias("word"), "length",
        F.col("modificationTime").alias("modified"))


# A file above this is streamed through the hash; one value in memory holds at most 2 GB.
WHOLE_BYTES = 256 << 20
CHUNK_BYTES = 8 << 20


def streamed_digest(path: str, chunk_bytes: int = CHUNK_BYTES) -> str:
    """Digest of a file of any length, a chunk in memory at a time."""
    import hashlib

    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    digest = hashlib.sha256()
    with store.open_input_stream(place) as source:
        while chunk := source.read(chunk_bytes):
            digest.update(chunk)
    return digest.hexdigest()


def file_digests(spark: SparkSession, root: str, *, whole_bytes: int = WHOLE_BYTES,
                 chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(path, actual_digest) of every file below ``root``, read once where it lies.

    Files of up to ``whole_bytes`` come through Spark's own reader, longer ones are streamed.
    Spark lists no empty files: they show as missing in a comparison with expected digests.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = plain_path(F.col("path")).alias("path")
    small = files.where(F.col("length") <= whole_bytes).select(path, F.sha2("content", 256).alias("actual_digest"))

    def digests(batches):
        for batch in batches:
            given = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([streamed_digest(p, chunk_bytes) for p in given], pa.string())],
                ["path", "actual_digest"])

    # One row a file: a task takes few of them, whatever their number in a folder.
    large = files.where(F.col("length") > whole_bytes).select(F.col("path").alias("given"), path).repartition(
        max(1, spark.sparkContext.defaultParallelism), "path")
    return small.unionByName(large.mapInArrow(digests, "path string, actual_digest string"))
