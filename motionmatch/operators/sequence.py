"""Keypoint sequences: densify, normalise, resample, difference, thin.

Long sparse rows (sequence, frame, landmark, x, y, z) in; a missing landmark has no
row and counts as (0, 0, 0) wherever it takes part in arithmetic. After
``resample`` a sequence has at most steps x landmarks rows whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionmatch.operators.facts import with_facts
from motionmatch.operators.ordered import OrderedRows
from motionmatch.operators.percentiles import exact_percentile
from motionmatch.operators.sizing import SPREAD_BYTES
from motionmatch.schemas import LEFT_HAND, LIP_LANDMARKS, POSE, RIGHT_HAND, STEPS

VISIBLE = 1e-6


def visible(x: Column | str = "x", y: Column | str = "y") -> Column:
    """A landmark was seen: x or y differs from zero; z is ignored."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    return (F.abs(x) > VISIBLE) | (F.abs(y) > VISIBLE)


def frame_index(points: DataFrame, sequence: str = "sequence_id", frame: str = "frame", *,
                spread_bytes: int = SPREAD_BYTES) -> DataFrame:
    """One row per frame: dense 0-based ``idx`` and the sequence's ``frames`` count."""
    frames = points.select(sequence, frame).distinct()
    return OrderedRows(frames, [sequence], [frame], spread_bytes=spread_bytes).index(
        "idx", total="frames").done()


def densify(points: DataFrame, sequence: str = "sequence_id", frame: str = "frame", *,
            spread_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Replace frame numbers by dense positions; gaps in frame numbers collapse."""
    index = frame_index(points, sequence, frame, spread_bytes=spread_bytes)
    return points.join(index, [sequence, frame])


def _places(points: DataFrame) -> list[str]:
    """Columns that tell the rows of a sequence apart, of those that are there."""
    return [c for c in ("frame", "idx", "step", "landmark") if c in points.columns]


def centres(points: DataFrame, sequence: str = "sequence_id") -> DataFrame:
    """Per sequence: centre of the visible points and 90th percentile distance."""
    seen = points.where(visible()).select(sequence, "x", "y", *_places(points))
    centre = seen.groupBy(sequence).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    apart = ["x", "y", *_places(points)]
    away = with_facts(seen, centre, [sequence], apart).select(sequence, *apart, F.sqrt(dx * dx + dy * dy).alias("_away"))
    spread = exact_percentile(away, [sequence], "_away", 0.9, "_p90", by=apart)
    scale = F.when(F.col("_p90") < 1e-6, F.lit(1.0)).otherwise(F.col("_p90"))
    return centre.join(spread, sequence).select(sequence, "cx", "cy", scale.alias("scale"))


def normalise(points: DataFrame, sequence: str = "sequence_id") -> DataFrame:
    """Centre and scale each sequence; unseen points become (0, 0, 0).

    A sequence without a visible point passes unchanged.
    """
    joined = with_facts(points, centres(points, sequence), [sequence], ["x", "y", *_places(points)], how="left")
    kept = F.col("cx").isNull()

    def moved(axis: str, centre: Column) -> Column:
        value = (F.col(axis) - centre) / F.col("scale")
        return (F.when(kept, F.col(axis)).when(visible(), value)
                .otherwise(F.lit(0.0)).alias(axis))

    others = [c for c in points.columns if c not in ("x", "y", "z")]
    return joined.select(*others, moved("x", F.col("cx")), moved("y", F.col("cy")),
                         moved("z", F.lit(0.0)))


def resample(points: DataFrame, sequence: str = "sequence_id", steps: int = STEPS) -> DataFrame:
    """Linear resampling of dense positions to ``steps``.

    Step j sits at j(T-1)/(steps-1). Each row is sent to the steps it has a nonzero
    weight for and the weighted rows are summed, so the sum is combined before the
    shuffle and no grid is joined. Weights are ratios of whole numbers.
    """
    if steps <= 0:
        raise ValueError("steps must be positive")
    last, span = F.col("frames") - 1, max(steps - 1, 1)
    idx = F.col("idx")
    # whole steps strictly inside ((idx-1), (idx+1)) * span / last
    first_step = F.greatest(F.expr(f"((idx - 1) * {span}) div (frames - 1)"), F.lit(0))
    last_step = F.least(F.expr(f"((idx + 1) * {span}) div (frames - 1)"), F.lit(steps - 1))
    one = F.col("frames") == 1
    if steps == 1:
        # A single step sits on the first frame.
        spread = points.where(idx == 0).withColumn("step", F.lit(0)).withColumn("_w", F.lit(1.0))
    else:
        reach = (F.when(one, F.sequence(F.lit(0), F.lit(steps - 1)))
                 .when(first_step <= last_step,
                       F.sequence(first_step.cast("int"), last_step.cast("int"))))
        gap = F.abs(F.col("step").cast("long") * last - idx * span)
        weight = F.when(one, F.lit(1.0)).otherwise(1.0 - gap / F.lit(float(span)))
        spread = (points.withColumn("step", F.explode(reach))
                  .withColumn("_w", weight).where("_w > 0"))
    return spread.groupBy(sequence, "step", "landmark").agg(
        *[F.sum(F.col("_w") * F.col(axis)).alias(axis) for axis in ("x", "y", "z")])


def prepare(points: DataFrame, sequence: str = "sequence_id", frame: str = "frame",
            steps: int = STEPS, *, spread_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Densify, normalise, resample. Feed the result to quality and embedding."""
    dense = densify(points, sequence, frame, spread_bytes=spread_bytes)
    return resample(normalise(dense, sequence), sequence, steps)


def velocity(prepared: DataFrame, sequence: str = "sequence_id", steps: int = STEPS) -> DataFrame:
    """First difference over steps; step 0 is zero, a missing side counts as zero.

    Every row is added at its own step and subtracted at the next one.
    """
    axes = ("x", "y", "z")
    own = F.when(F.col("step") > 0, F.struct(
        F.col("step"), *[F.col(a) for a in axes]))
    after = F.when(F.col("step") < steps - 1, F.struct(
        (F.col("step") + 1).alias("step"), *[(-F.col(a)).alias(a) for a in axes]))
    parts = prepared.select(
        sequence, "landmark", F.explode(F.array_compact(F.array(own, after))).alias("p"))
    moved = parts.select(sequence, "landmark", "p.*")
    return moved.groupBy(sequence, "step", "landmark").agg(*[F.sum(a).alias(a) for a in axes])


def subsample(index: DataFrame, limit: int = 96) -> DataFrame:
    """Keep at most ``limit`` evenly spaced frames of each longer sequence.

    Frame ``idx`` is kept when it is floor(i(T-1)/(limit-1)) for some i.
    """
    span, last = limit - 1, F.col("frames") - 1
    # smallest i whose position reaches idx; it must not reach idx + 1
    i = F.expr(f"(idx * {span} + frames - 2) div (frames - 1)")
    hit = F.floor(i * last / F.lit(span)) == F.col("idx")
    return index.where((F.col("frames") <= limit) | hit)


def assemble_frame(left: Column, right: Column, pose: Column, face: Column) -> Column:
    """One frame's landmark array from detector parts; an absent part is zeros."""
    zero = F.struct(*[F.lit(0.0).alias(a) for a in ("x", "y", "z")])

    def part(points: Column, count: int) -> Column:
        found = F.slice(F.coalesce(points, F.array().cast("array<struct<x:double,y:double,z:double>>")),
                        1, count)
        return F.concat(found, F.array_repeat(zero, F.lit(count) - F.size(found)))

    lips = F.when(face.isNull(), F.array_repeat(zero, len(LIP_LANDMARKS))).otherwise(
        F.array(*[F.get(face, F.lit(i)) for i in LIP_LANDMARKS]))
    return F.concat(part(left, LEFT_HAND), part(right, RIGHT_HAND), part(pose, POSE), lips)


def explode_frame(frames: DataFrame, points: str, keep: list[str]) -> DataFrame:
    """Frames holding landmark arrays to long rows; unseen landmarks are dropped."""
    rows = frames.select(*keep, F.posexplode(points).alias("landmark", "p"))
    return rows.select(*keep, "landmark", "p.x", "p.y", "p.z").where(visible())


def repeat_samples(df: DataFrame, repeats: int) -> DataFrame:
    if repeats <= 0:
        raise ValueError("repeats must be positive")
    return df.withColumn("repeat_index", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
