import math

import pytest
from pyspark.sql import functions as F

from motionmatch.functions.features import bad_features, trajectory_ok
from motionmatch.functions.scoring import (
    decision, diagnostics, is_accepted, is_ambiguous, manual_score, quality_reasons, scaled_unit,
)
from motionmatch.schemas import FEATURES

GOLDEN = [
    (0.68, -0.02, 0, False, False), (0.90, 0.06, 100, True, False), (0.90, 0.00, 74, False, False),
    (0.832, 0.06, 79, False, False), (0.835, 0.06, 80, True, False), (0.78, 0.06, 63, False, False),
    (0.779999, 0.06, 63, False, False), (0.94, -0.015, 82, True, True),
    (0.939999, -0.015, 70, False, False), (0.94, -0.015001, 70, False, False),
]


def test_golden_points(spark):
    rows = spark.createDataFrame([(t, m) for t, m, *_ in GOLDEN], "t double, m double").coalesce(1)
    score = manual_score(F.col("t"), F.col("m"))
    got = rows.select("t", "m", score, is_accepted(score), is_ambiguous(F.col("t"), F.col("m"))).collect()
    assert [tuple(r) for r in got] == GOLDEN


@pytest.mark.parametrize("pair", [(float("nan"), 0.0), (float("inf"), 0.0), (1.01, 0.0), (0.5, 2.01),
                                  (0.5, float("-inf"))])
def test_out_of_bounds_is_an_error(spark, pair):
    rows = spark.createDataFrame([pair], "t double, m double")
    with pytest.raises(Exception, match="out of bounds"):
        rows.select(manual_score(F.col("t"), F.col("m"))).collect()


def test_gated_attempt_has_no_score(spark):
    rows = spark.createDataFrame([(None, None)], "t double, m double")
    score = manual_score(F.col("t"), F.col("m"))
    assert tuple(rows.select(score, is_accepted(score), decision(F.lit(False), score)).first()) == (
        None, False, "rerecord")


def test_scaled_unit_needs_an_interval():
    with pytest.raises(ValueError):
        scaled_unit(None, 1.0, 1.0)


def test_gate_reasons_in_order(spark):
    rows = spark.createDataFrame(
        [(0.0, 0.0, 0.0, 0.0), (0.18, 0.0, 0.075, 6 / 32), (0.18, 0.014, 0.0, 1.0), (0.5, 0.0139, 0.0749, 1.0)],
        "v double, e double, s double, c double").coalesce(1)
    got = [r[0] for r in rows.select(quality_reasons(*map(F.col, "vesc"))).collect()]
    assert got == [["insufficient_hand_visibility", "incomplete_sequence", "insufficient_motion"], [], [],
                   ["insufficient_motion"]]


def test_diagnostics(spark):
    rows = spark.createDataFrame([
        (0.0, 0.0, 0.0, 0.0, None, None, None), (0.9, 0.05, 0.5, 1.0, 0.9, 0.5, 100),
        (0.9, 0.05, 0.5, 1.0, 0.5, 0.9, 10), (0.9, 0.007, 0.03, 1.0, None, None, None)],
        "v double, e double, s double, c double, t double, o double, score int").coalesce(1)
    got = [[(d["code"], round(d["severity"], 6)) for d in r[0]] for r in rows.select(
        diagnostics(*map(F.col, ("v", "e", "s", "c", "t", "o", "score")))).collect()]
    assert got == [[("HANDS_NOT_VISIBLE", 1.0), ("TOO_FEW_FRAMES", 1.0)], [],
                   [("LOW_MATCH", 0.9), ("NEAREST_CONFUSION", 0.2)], [("MOTION_NOT_DETECTED", 0.5)]]


def test_feature_bounds(spark):
    good = (0.5, 0.5, 0.0, 1.0, 0.0, 9.0, 1.0, 0.0, 0.0)
    cases = {"target_similarity": 1.1, "similarity_margin": -2.1, "hand_visibility": None,
             "motion_span": math.inf, "motion_energy": math.nan, "end_position_difference": -0.1}
    rows = [good] + [tuple(bad if f == name else v for f, v in zip(FEATURES, good)) for name, bad in cases.items()]
    frame = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in FEATURES)).coalesce(1)
    assert [r[0] for r in frame.select(bad_features()).collect()] == [[]] + [[n] for n in cases]


def test_trajectory_may_be_absent(spark):
    rows = spark.createDataFrame([(None,), (0.0,), (-1.0,), (math.nan,)], "d double").coalesce(1)
    assert [r[0] for r in rows.select(trajectory_ok(F.col("d"))).collect()] == [True, True, False, False]
