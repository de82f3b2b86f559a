"""Bounds of the nine model features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motionmatch.functions.scoring import finite
from motionmatch.schemas import FEATURES


@dataclass(frozen=True)
class Bound:
    name: str
    minimum: float
    maximum: float | None
    direction: str


# Fixed values, in feature order.
BOUNDS = (
    Bound("target_similarity", -1.0, 1.0, "higher_is_better"),
    Bound("best_other_similarity", -1.0, 1.0, "lower_is_better"),
    Bound("similarity_margin", -2.0, 2.0, "higher_is_better"),
    Bound("hand_visibility", 0.0, 1.0, "higher_is_better"),
    Bound("motion_energy", 0.0, None, "higher_means_more_motion"),
    Bound("motion_span", 0.0, None, "higher_means_larger_motion"),
    Bound("sequence_completeness", 0.0, 1.0, "higher_is_better"),
    Bound("start_position_difference", 0.0, None, "lower_means_more_centered"),
    Bound("end_position_difference", 0.0, None, "lower_means_more_centered"),
)
assert tuple(b.name for b in BOUNDS) == FEATURES


def bounds_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, b.name, b.minimum, b.maximum, b.direction) for i, b in enumerate(BOUNDS)],
        "ordinal INT, feature STRING, minimum DOUBLE, maximum DOUBLE, direction STRING")


def within(value: Column, bound: Bound) -> Column:
    """Inclusive bounds; an open top still refuses NaN and infinity."""
    inside = finite(value) & (value >= bound.minimum)
    return inside if bound.maximum is None else inside & (value <= bound.maximum)


def bad_features(columns: dict[str, Column] | None = None) -> Column:
    """Names of missing or out-of-bounds features, in feature order."""
    columns = columns or {name: F.col(name) for name in FEATURES}
    return F.array_compact(F.array(*[
        F.when(~F.coalesce(within(columns[b.name], b), F.lit(False)), F.lit(b.name))
        for b in BOUNDS if b.name in columns]))


def trajectory_ok(value: Column) -> Column:
    """Null, or finite and not negative."""
    return value.isNull() | (finite(value) & (value >= 0))
