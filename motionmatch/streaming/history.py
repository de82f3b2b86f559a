"""Stored attempts, later feedback, and the recent list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionmatch.operators.search import LoadedLibrary
from motionmatch.operators.sequence import visible
from motionmatch.plans.match import Prepared, match_recordings
from motionmatch.schemas import LANDMARKS, MEASUREMENTS
from motionmatch.sources.scratch import settled
from motionmatch.sources.sinks import append_attempts
from motionmatch.streaming.buckets import Buckets

MODEL_VERSION = "manual-baseline-v1"


def last_feedback(feedback: DataFrame, key: str = "attempt_id", value: str = "useful",
                  order: str = "event_id") -> DataFrame:
    """The last word on each attempt."""
    return feedback.groupBy(key).agg(F.max_by(value, order).alias(value))


def apply_feedback(attempts: DataFrame, feedback: DataFrame, key: str = "attempt_id",
                   value: str = "useful", order: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """(attempts with ``feedback_useful``, feedback on unknown attempts).

    New feedback overwrites old; attempts without new feedback keep what they had.
    """
    latest = last_feedback(feedback, key, value, order).withColumnRenamed(value, "_useful")
    old = F.col("feedback_useful") if "feedback_useful" in attempts.columns else F.lit(None)
    updated = attempts.join(latest, key, "left").withColumn(
        "feedback_useful", F.coalesce("_useful", old.cast("boolean"))).drop("_useful")
    unknown = feedback.join(attempts.select(key), key, "left_anti")
    return updated, unknown


def merged_feedback(old: DataFrame, feedback: DataFrame, key: str = "attempt_id", value: str = "useful",
                    order: str = "event_id") -> DataFrame:
    """Stored attempts with feedback that is not older than the one they have (``feedback_order``)."""
    new = feedback.select(key, F.col(value).alias("_useful"), F.col(order).alias("_order"))
    later = F.col("_order").isNotNull() & (F.col("feedback_order").isNull() | (F.col("_order") >= F.col("feedback_order")))
    return old.join(new, key, "left").withColumns({
        "feedback_useful": F.when(later, F.coalesce("_useful", "feedback_useful")).otherwise(F.col("feedback_useful")),
        "feedback_order": F.when(later, F.col("_order")).otherwise(F.col("feedback_order"))}).drop("_useful", "_order")


def on_feedback(table: Buckets, rejects: str, key: str = "attempt_id", value: str = "useful", order: str = "event_id",
                stream: str = "feedback") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: upsert the last word on each attempt; feedback on unknown attempts goes to
    ``rejects``, a folder a micro-batch.

    Only buckets that hold such attempts are read and written again. A replayed micro-batch changes nothing,
    and one that comes late does not undo newer feedback.
    """
    def run(batch: DataFrame, number: int) -> None:
        given = batch.select(key, value, order)
        latest = given.groupBy(key).agg(F.max_by(F.struct(value, order), order).alias("last")).select(key, "last.*")
        done, unknown = table.change(latest, lambda old, new: merged_feedback(old, new, key, value, order), stream=stream, batch=number)
        if not done.replayed:
            given.join(unknown.select(key), key, "left_semi").write.mode("overwrite").parquet(f"{rejects.rstrip('/')}/batch={number}")

    return run


def recent(attempts: DataFrame, limit: int = 20, created: str = "created_at",
           key: str = "attempt_id") -> DataFrame:
    """Newest attempts; a top-k, never a full sort."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return attempts.orderBy(F.col(created).desc(), F.col(key)).limit(limit)


def finished_recordings(frames: DataFrame, reader: SparkSession | None = None) -> tuple[DataFrame, DataFrame]:
    """(keypoints, recordings) of the kept frames of finished attempts (kind ``frame``), for session ``reader``.

    ``landmarks`` holds a frame flattened to x, y, z per landmark. A frame with
    nothing visible still counts towards the length of its recording. The frames are computed once: visible points
    with the target of their attempt are written, and both results read these.
    """
    axes = ("x", "y", "z")
    triples = F.transform(F.sequence(F.lit(0), F.lit(LANDMARKS - 1)), lambda i: F.struct(
        i.alias("landmark"), *[F.get("landmarks", 3 * i + j).alias(axis) for j, axis in enumerate(axes)]))
    blank = F.array(F.struct(F.lit(0).alias("landmark"), *[F.lit(0.0).alias(a) for a in axes]))
    rows = frames.where("kind = 'frame'").select(
        F.col("attempt_id").alias("sequence_id"), F.col("position").alias("frame"), "target", triples.alias("points"))
    seen = F.filter("points", lambda p: visible(p["x"], p["y"]))
    # A frame with missing numbers and nothing visible is no frame.
    kept = F.when(F.size(seen) > 0, seen).when(~F.exists("points", lambda p: visible(p["x"], p["y"])), blank)
    points = settled(rows.select("sequence_id", "frame", "target", F.explode(kept).alias("p")).select(
        "sequence_id", "frame", "target", "p.*"), "finished", reader)
    recordings = points.select("sequence_id", F.col("sequence_id").alias("recording_id"),
                               F.col("target").alias("target_word")).distinct()
    return points.drop("target"), recordings


def attempt_records(results: DataFrame) -> DataFrame:
    """Matched results as history rows."""
    return results.select(
        F.col("recording_id").alias("attempt_id"), "target_word", "decision", "score",
        "quality_valid", "diagnostics", "nearest_confusion",
        F.lit(MODEL_VERSION).alias("model_version"), *MEASUREMENTS, "target_similarity",
        "best_other_similarity", "similarity_margin", F.current_timestamp().alias("created_at"))


def on_finished(library: DataFrame, vocab: DataFrame, table: str | Buckets,
                **options) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: score what finished, store each attempt once.

    The library is read and checked once, before the stream starts. What a micro-batch finished is matched in the library's
    session: plans of the stream's own are not adaptive, and their many exchanges keep their full number of partitions.
    """
    spark = library.sparkSession
    library = LoadedLibrary(library, options.get("precision", "double"))

    def run(batch: DataFrame, number: int) -> None:
        points, recordings = finished_recordings(batch, spark)
        if points.isEmpty():
            return
        prepared = Prepared(points)
        try:
            # One bad attempt must not end the stream.
            results = match_recordings(prepared, recordings, library, vocab, **{"strict": False, **options})
            if isinstance(table, Buckets):
                table.append_once(attempt_records(results), stream="finished", batch=number)
            else:
                append_attempts(spark, attempt_records(results), table)
        finally:
            prepared.release()

    return run
