"""Similarity to score, decision and diagnostics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScoreRule:
    """Fixed values of the manual score."""

    similarity_floor: float = 0.68
    similarity_ceiling: float = 0.90
    margin_floor: float = -0.02
    margin_ceiling: float = 0.06
    similarity_weight: float = 0.68
    margin_weight: float = 0.32
    weak_similarity: float = 0.78
    weak_score: int = 74
    high_similarity: float = 0.94
    ambiguous_margin: float = -0.015
    ambiguous_score: int = 82
    near_margin: float = 0.01
    near_margin_floor: float = -0.04
    near_ceiling: float = 0.96
    near_base: int = 62
    pass_score: int = 80


@dataclass(frozen=True)
class GateRule:
    """Fixed values of the recording quality gate."""

    min_visibility: float = 0.18
    min_energy: float = 0.014
    min_span: float = 0.075
    min_completeness: float = 6 / 32


SCORE_RULE = ScoreRule()
GATE_RULE = GateRule()


def finite(value: Column) -> Column:
    """Not null, NaN or infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def scaled_unit(value: Column, lower: float, upper: float) -> Column:
    if not upper > lower:
        raise ValueError("upper must be greater than lower")
    share = (value - F.lit(lower)) / F.lit(upper - lower)
    return F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))


def whole_score(value: Column) -> Column:
    """Half-even rounding to an integer."""
    return F.bround(value, 0).cast("int")


def similarity_ok(target: Column, margin: Column) -> Column:
    return finite(target) & finite(margin) & target.between(-1.0, 1.0) & margin.between(-2.0, 2.0)


def is_ambiguous(target: Column, margin: Column, rule: ScoreRule = SCORE_RULE) -> Column:
    """High similarity that another word nearly reaches too."""
    return (target >= rule.high_similarity) & (margin >= rule.ambiguous_margin)


def manual_score(target: Column, margin: Column, rule: ScoreRule = SCORE_RULE) -> Column:
    """Integer score 0..100; null for null input, an error out of bounds."""
    base = whole_score(100 * (
        rule.similarity_weight * scaled_unit(target, rule.similarity_floor, rule.similarity_ceiling)
        + rule.margin_weight * scaled_unit(margin, rule.margin_floor, rule.margin_ceiling)))
    near = whole_score(
        rule.near_base
        + 12 * scaled_unit(target, rule.weak_similarity, rule.near_ceiling)
        + 5 * scaled_unit(margin, rule.near_margin_floor, rule.near_margin))
    capped = F.when(target < rule.weak_similarity,
                    F.least(base, F.lit(rule.weak_score))).otherwise(base)
    score = (F.when(is_ambiguous(target, margin, rule), F.greatest(capped, F.lit(rule.ambiguous_score)))
             .when(margin < rule.near_margin, F.least(capped, near))
             .otherwise(capped))
    return (F.when(target.isNull() | margin.isNull(), F.lit(None).cast("int"))
            .when(similarity_ok(target, margin), score)
            .otherwise(F.raise_error(F.lit("similarity out of bounds")).cast("int")))


def is_accepted(score: Column, rule: ScoreRule = SCORE_RULE) -> Column:
    return F.coalesce(score >= rule.pass_score, F.lit(False))


def decision(valid: Column, score: Column, rule: ScoreRule = SCORE_RULE) -> Column:
    return (F.when(~valid, F.lit("rerecord"))
            .when(is_accepted(score, rule), F.lit("pass")).otherwise(F.lit("retry")))


def quality_reasons(visibility: Column, energy: Column, span: Column, completeness: Column,
                    rule: GateRule = GATE_RULE) -> Column:
    """Why a recording is unusable, in fixed order; empty when it is usable."""
    still = (energy < rule.min_energy) & (span < rule.min_span)
    return F.array_compact(F.array(
        F.when(visibility < rule.min_visibility, F.lit("insufficient_hand_visibility")),
        F.when(completeness < rule.min_completeness, F.lit("incomplete_sequence")),
        F.when(still, F.lit("insufficient_motion"))))


def _finding(code: str, severity: Column) -> Column:
    bounded = F.least(F.greatest(severity, F.lit(0.0)), F.lit(1.0))
    return F.struct(F.lit(code).alias("code"), bounded.alias("severity"))


def diagnostics(visibility: Column, energy: Column, span: Column, completeness: Column,
                target: Column, other: Column, score: Column,
                gate: GateRule = GATE_RULE, rule: ScoreRule = SCORE_RULE) -> Column:
    """Findings for the learner, at most two, as array of (code, severity)."""
    motion = F.greatest(energy / gate.min_energy, span / gate.min_span)
    still = (energy < gate.min_energy) & (span < gate.min_span)
    unusable = F.array_compact(F.array(
        F.when(visibility < gate.min_visibility, _finding("HANDS_NOT_VISIBLE", 1 - visibility)),
        F.when(completeness < gate.min_completeness,
               _finding("TOO_FEW_FRAMES", 1 - completeness / gate.min_completeness)),
        F.when(still, _finding("MOTION_NOT_DETECTED", 1 - motion))))
    weak = ~is_accepted(score, rule)
    poor = F.array_compact(F.array(
        F.when(weak, _finding("LOW_MATCH", 1 - score / 100)),
        F.when(weak & (other > target), _finding("NEAREST_CONFUSION", (other - target) / 2))))
    return F.when(F.size(unusable) > 0, F.slice(unusable, 1, 2)).otherwise(poor)


def safe_rate(numerator: Column, denominator: Column) -> Column:
    return F.bround(F.try_divide(numerator, denominator), 6)


def match_score(probability: Column) -> Column:
    return whole_score(100 * probability)
