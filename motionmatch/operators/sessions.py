"""Batch twins of the attempt stream, over frame event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionmatch.operators.facts import with_facts
from motionmatch.operators.ordered import OrderedRows
from motionmatch.operators.sizing import SPREAD_BYTES

FRAMES_KEPT = 48
IDLE_SECONDS = 120
THIN_MILLIS = 300
RECORD_MILLIS = 4000


def sessions(events: DataFrame, key: str = "attempt_id", ts: str = "ts", event: str = "event_id", *,
             idle_seconds: float = IDLE_SECONDS,
             spread_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Events with ``session_no`` (0-based per key); a longer gap opens a new one.

    A gap of exactly the limit stays in the session. Event time at full precision.
    """
    rows = OrderedRows(events, [key], [ts, event], spread_bytes=spread_bytes)
    rows.previous("_before", ts)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_before").cast("timestamp"))
    opens = F.when(gap > int(idle_seconds * 1_000_000), F.lit(1).cast("long")).otherwise(
        F.lit(0).cast("long"))
    rows.frame = rows.frame.withColumn("_opens", opens)
    rows.running(session_no=F.col("_opens"))
    return rows.done().drop("_before", "_opens")


def session_summary(events: DataFrame, key: str = "attempt_id", ts: str = "ts",
                    event: str = "event_id", **options) -> DataFrame:
    """(key, session_no, started, ended, frames)."""
    return sessions(events, key, ts, event, **options).groupBy(key, "session_no").agg(
        F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("frames"))


def last_frames(events: DataFrame, key: str = "attempt_id", ts: str = "ts", event: str = "event_id",
                keep: int = FRAMES_KEPT) -> DataFrame:
    """The newest ``keep`` frames of each key.

    The rank filter becomes a group limit, applied before the shuffle as well, so a
    key sends at most ``keep`` rows per map task.
    """
    newest = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(event).desc())
    return events.withColumn("_rn", F.row_number().over(newest)).where(
        F.col("_rn") <= keep).drop("_rn")


def admission_reason(target_known: Column, payload: Column) -> Column:
    """Why a frame is refused, or null. JPEG data starts with FF D8."""
    return (F.when(~target_known, F.lit("unknown_target"))
            .when(payload.isNull() | ~F.substring(F.hex(payload), 1, 4).eqNullSafe("FFD8"),
                  F.lit("invalid_image")))


def _marked(events: DataFrame, key: str, ts: str, event: str, target: str, final: str) -> DataFrame:
    """Events with their attempt's ``first_target`` and ``end`` (null while open).

    The first target owns the key; its first final frame ends the attempt. Both are
    combining aggregates, one row per key, joined back.
    """
    order = F.struct(F.col(ts), F.col(event))
    first = events.groupBy(key).agg(F.min_by(target, order).alias("first_target"))
    ends = events.where(F.col(final)).groupBy(key, target).agg(F.min(order).alias("end"))
    marks = first.join(ends.withColumnRenamed(target, "first_target"), [key, "first_target"], "left")
    return with_facts(events.where(F.col(key).isNotNull()), marks, [key], [ts, event])


def outcomes(events: DataFrame, key: str = "attempt_id", ts: str = "ts", event: str = "event_id",
             target: str = "target", final: str = "final") -> DataFrame:
    """Per key: first target, terminal event, frames used, and what was turned away.

    Other targets are conflicts. After the end, ordinary frames are dropped and
    finals repeat the result.
    """
    order = F.struct(F.col(ts), F.col(event))
    rows = _marked(events, key, ts, event, target, final)
    own = F.col(target) == F.col("first_target")
    late = F.col("end").isNotNull() & (order > F.col("end"))
    return rows.groupBy(key).agg(
        F.first("first_target").alias("target"),
        F.max(F.col("end")[event]).alias("terminal_event"),
        F.count_if(own & ~late).alias("frames_seen"),
        F.least(F.count_if(own & ~late), F.lit(FRAMES_KEPT)).alias("frames_used"),
        F.count_if(~own).alias("conflicts"),
        F.count_if(own & late & ~F.col(final)).alias("late_frames"),
        F.count_if(own & late & F.col(final)).alias("repeated_finals"))


def used_frames(events: DataFrame, key: str = "attempt_id", ts: str = "ts", event: str = "event_id",
                target: str = "target", final: str = "final") -> DataFrame:
    """The frames each finished attempt is scored on: the last 48 up to its final."""
    order = F.struct(F.col(ts), F.col(event))
    rows = _marked(events, key, ts, event, target, final)
    kept = rows.where((F.col(target) == F.col("first_target")) & (order <= F.col("end")))
    return last_frames(kept.drop("first_target", "end"), key, ts, event)


def thin(events: DataFrame, key: str = "attempt_id", ts: str = "ts", event: str = "event_id", *,
         interval_millis: int = THIN_MILLIS, duration_millis: int = RECORD_MILLIS) -> DataFrame:
    """One frame per interval since the attempt's start, until a final one.

    The final frame is the first at or after the full duration; nothing follows it.
    """
    order = F.struct(F.col(ts), F.col(event))
    started = events.groupBy(key).agg(F.min(ts).alias("_start"))
    since = (F.unix_micros(F.col(ts).cast("timestamp"))
             - F.unix_micros(F.col("_start").cast("timestamp")))
    over = since >= duration_millis * 1000
    slot = F.when(over, F.lit(-1).cast("long")).otherwise(
        F.expr("0L") + F.floor(since / (interval_millis * 1000)))
    slotted = with_facts(events.where(F.col(key).isNotNull()), started, [key], [ts, event]).withColumn("slot", slot)
    picked = slotted.groupBy(key, "slot").agg(F.min(order).alias("_p"))
    return picked.select(key, F.col(f"_p.{ts}").alias(ts), F.col(f"_p.{event}").alias(event),
                         (F.col("slot") < 0).alias("final"))
