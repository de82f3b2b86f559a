"""What should exist, what does, and whether it is intact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionmatch.functions.text import stripped


def select_words(vocab: DataFrame, requested: DataFrame, *, word: str = "word",
                 position: str = "position", target: str = "target_word") -> DataFrame:
    """Requested vocabulary words, once each, with the position first asked at."""
    asked = requested.groupBy(F.upper(stripped(F.col(word))).alias(target)).agg(
        F.min(position).alias("position"))
    return asked.join(vocab, target)


def unsupported_words(vocab: DataFrame, requested: DataFrame, *, word: str = "word",
                      target: str = "target_word") -> DataFrame:
    asked = requested.select(F.upper(stripped(F.col(word))).alias(target)).distinct()
    return asked.join(vocab.select(target), target, "left_anti")


def expected_grid(words: DataFrame, **axes: Sequence[str]) -> DataFrame:
    """Every word with every value of each named axis (short literal lists)."""
    grid = words
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid


def coverage(grid: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid cells with their file count and status present or missing."""
    counts = observed.groupBy(*keys).agg(F.count("*").alias("files"))
    files = F.coalesce("files", F.lit(0).cast("long"))
    return grid.join(counts, list(keys), "left").withColumn("files", files).withColumn(
        "status", F.when(F.col("files") > 0, F.lit("present")).otherwise(F.lit("missing")))


def digest_of(content: Column) -> Column:
    return F.sha2(content, 256)


def digest_status(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Per expected file: ok, mismatch, missing, no_digest or malformed.

    ``expected``: key, expected_digest (text of a checksum line). ``actual``: key,
    actual_digest.
    """
    text = F.lower(F.get(F.split(stripped("expected_digest"), r"\s+"), F.lit(0)))
    joined = expected.withColumn("_want", text).join(
        actual.withColumn("_there", F.lit(True)), key, "left")
    status = (F.when(F.col("_there").isNull(), F.lit("missing"))
              .when(F.col("expected_digest").isNull(), F.lit("no_digest"))
              .when(~F.col("_want").rlike("^[0-9a-f]{64}$"), F.lit("malformed"))
              .when(F.col("_want") != F.col("actual_digest"), F.lit("mismatch"))
              .otherwise(F.lit("ok")))
    return joined.withColumn("digest_status", status).drop("_want", "_there")


def inventory_status(archive_present: Column, archive_ok: Column, extracted_present: Column,
                     recorded: Column, members: Column, found: Column) -> Column:
    """missing, damaged or skipped (complete), as a preparation plan would report.

    ``recorded`` is the member list noted at extraction, ``members`` the archive's,
    ``found`` the files seen below the target.
    """
    complete = F.coalesce(recorded == members, F.lit(False)) & (
        F.size(F.array_except(members, F.coalesce(found, F.array().cast("array<string>")))) == 0)
    return (F.when(~archive_present, F.lit("missing"))
            .when(~archive_ok, F.lit("damaged"))
            .when(extracted_present & complete, F.lit("skipped"))
            .when(extracted_present, F.lit("damaged"))
            .otherwise(F.lit("missing")))


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def with_fallback(rows: DataFrame, chain: Sequence[tuple[DataFrame, str, str]], default: str,
                  name: str) -> DataFrame:
    """First value found along ``chain`` of (small table, key, value), else default."""
    tried = []
    for i, (table, key, value) in enumerate(chain):
        side = table.select(F.col(key).alias(key), F.col(value).alias(f"_try{i}"))
        rows = rows.join(side, key, "left")
        tried.append(F.col(f"_try{i}"))
    return rows.withColumn(name, F.coalesce(*tried, F.lit(default))).drop(
        *[f"_try{i}" for i in range(len(chain))])


def explode_catalogue(lectures: DataFrame) -> DataFrame:
    """One row per lecture word: (lecture_no, title, position, gloss)."""
    return lectures.select("lecture_no", "title",
                           F.posexplode("words").alias("position", "gloss"))
