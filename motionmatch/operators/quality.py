"""Recording quality measured on prepared sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionmatch.functions.scoring import GATE_RULE, GateRule, finite, quality_reasons
from motionmatch.operators.sequence import visible
from motionmatch.schemas import HAND_LANDMARKS, STEPS


def measure(prepared: DataFrame, frame_counts: DataFrame, sequence: str = "sequence_id", *,
            steps: int = STEPS, hand_landmarks: int = HAND_LANDMARKS) -> DataFrame:
    """Six measurements per sequence of ``frame_counts`` (sequence, frames).

    ``prepared`` has at most steps x landmarks rows per sequence, so one exchange by
    sequence serves both windows and the final aggregate.
    """
    hands = prepared.where((F.col("landmark") < hand_landmarks) & visible())
    hands = hands.select(sequence, "step", "landmark", "x", "y").repartition(F.col(sequence))
    track = Window.partitionBy(sequence, "landmark").orderBy("step")
    frame = Window.partitionBy(sequence, "step")
    dx, dy = F.col("x") - F.lag("x").over(track), F.col("y") - F.lag("y").over(track)
    adjacent = F.col("step") - F.lag("step").over(track) == 1
    moves = hands.select(
        sequence, "step",
        F.when(adjacent, F.sqrt(dx * dx + dy * dy)).alias("_move"),
        F.avg("x").over(frame).alias("_cx"), F.avg("y").over(frame).alias("_cy"))
    wide = F.max("_cx") - F.min("_cx")
    tall = F.max("_cy") - F.min("_cy")
    offset = F.sqrt(F.col("_cx") * F.col("_cx") + F.col("_cy") * F.col("_cy"))
    measured = moves.groupBy(sequence).agg(
        # at most ``steps`` distinct values
        (F.size(F.collect_set("step")) / F.lit(float(steps))).alias("hand_visibility"),
        F.percentile("_move", F.lit(0.75)).alias("motion_energy"),
        F.sqrt(wide * wide + tall * tall).alias("motion_span"),
        F.min_by(offset, "step").alias("start_position_difference"),
        F.max_by(offset, "step").alias("end_position_difference"))
    zero = F.lit(0.0)
    return frame_counts.join(measured, sequence, "left").select(
        sequence, "frames",
        *[F.coalesce(c, zero).alias(c) for c in ("hand_visibility", "motion_energy", "motion_span")],
        F.least(F.col("frames") / F.lit(float(steps)), F.lit(1.0)).alias("sequence_completeness"),
        *[F.coalesce(c, zero).alias(c)
          for c in ("start_position_difference", "end_position_difference")])


def gate(measured: DataFrame, rule: GateRule = GATE_RULE) -> DataFrame:
    """Add ``reasons`` and ``quality_valid``. A measurement that is not a number is an error."""
    sound = finite(F.col("hand_visibility")) & finite(F.col("motion_energy")) & finite(
        F.col("motion_span")) & finite(F.col("sequence_completeness"))
    found = quality_reasons(F.col("hand_visibility"), F.col("motion_energy"),
                              F.col("motion_span"), F.col("sequence_completeness"), rule)
    reasons = F.when(~sound, F.raise_error(F.lit("a quality measurement is not finite"))).otherwise(found)
    return measured.withColumn("reasons", reasons).withColumn(
        "quality_valid", F.size("reasons") == 0)
