"""Rules of raw keypoint rows and of calibration input rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionmatch.functions.features import BOUNDS, within
from motionmatch.functions.scoring import finite
from motionmatch.functions.text import stripped
from motionmatch.operators.rules import Rule, blank, duplicates, leakage, row_issues
from motionmatch.schemas import FEATURES, LANDMARKS, SAMPLE_TYPES, SEMANTIC_TYPES, VARIANT_STATUSES
from motionmatch.vocabulary import SPLITS


def typed_keypoints(raw: DataFrame) -> DataFrame:
    """Text columns to numbers; what does not parse becomes null."""
    return raw.select(
        *[c for c in raw.columns if c not in ("frame", "landmark_index", "x", "y", "z")],
        stripped("frame").try_cast("int").alias("frame"),
        stripped("landmark_index").try_cast("int").alias("landmark"),
        *[stripped(a).try_cast("double").alias(a) for a in ("x", "y", "z")])


def keypoint_issues(points: DataFrame, sequence: str = "sequence_id", *,
                    landmarks: int = LANDMARKS, row_number: str = "row_number") -> DataFrame:
    """Breaches of typed keypoint rows as (code, row_number, column, message)."""
    numbers = ("frame", "landmark", "x", "y", "z")
    unparsed = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in numbers]))
    axes = [F.col(a) for a in ("x", "y", "z")]
    not_finite = ~(finite(axes[0]) & finite(axes[1]) & finite(axes[2]))
    parsed = F.size(unparsed) == 0
    rules = [
        Rule("invalid_number", ~parsed, F.array_join(unparsed, ",")),
        Rule("negative_frame", F.col("frame") < 0, F.col("frame").cast("string"), "frame"),
        Rule("landmark_range", ~F.col("landmark").between(0, landmarks - 1),
             F.col("landmark").cast("string"), "landmark"),
        Rule("not_finite", parsed & not_finite, F.lit("coordinates must be finite")),
    ]
    issues = row_issues(points, rules, row_number)
    keyed = points.where(parsed).select(sequence, "frame", "landmark", row_number)
    later = duplicates(keyed, [sequence, "frame", "landmark"], row_number)
    return issues.unionByName(later.select(
        F.lit("duplicate_point").alias("code"), F.col(row_number).cast("long").alias("row_number"),
        F.lit("landmark").alias("column"),
        F.concat(F.lit("also on row "), F.col("first_row").cast("string")).alias("message")))


def valid_points(points: DataFrame, sequence: str = "sequence_id", *,
                 landmarks: int = LANDMARKS, row_number: str = "row_number") -> DataFrame:
    """Rows that break no keypoint rule, first of each repeated point."""
    ok = ((F.col("frame") >= 0) & F.col("landmark").between(0, landmarks - 1)
          & finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z")))
    point = F.min_by(F.struct("x", "y", "z"), row_number)
    return points.where(ok).groupBy(sequence, "frame", "landmark").agg(
        point.alias("p")).select(sequence, "frame", "landmark", "p.*")


def eligible(rows: DataFrame) -> DataFrame:
    """Typed result rows a calibrator may learn from or be judged on."""
    return rows.where(
        F.col("quality_valid") & F.col("sample_type").isin(*SEMANTIC_TYPES)
        & (F.col("variant_status") != "unreviewed") & F.col("expected_pass").isNotNull()
        & (F.col("repeat_index") == 0))


def typed_results(raw: DataFrame) -> DataFrame:
    """Calibration text columns to typed ones; blank is null."""
    def boolean(c):
        return F.when(F.col(c) == "true", True).when(F.col(c) == "false", False).alias(c)

    texts = [c for c in raw.columns if c not in (
        "repeat_index", "quality_valid", "expected_pass", "accepted", "score", *FEATURES)]
    return raw.select(
        *texts, F.col("repeat_index").try_cast("long").alias("repeat_index"),
        *[boolean(c) for c in ("quality_valid", "expected_pass", "accepted")],
        *[F.nullif(stripped(c), F.lit("")).try_cast("double").alias(c) for c in ("score", *FEATURES)])


def result_issues(raw: DataFrame, vocab: DataFrame, splits=SPLITS) -> DataFrame:
    """Breaches of calibration input (text columns plus ``row_number``).

    Words must be product keys and signers must keep to one split on every row,
    also on rows that will not be used.
    """
    judged = ("repeat_index", "quality_valid", "expected_pass", "accepted", "score")
    rows = typed_results(raw.withColumns({f"_raw_{c}": F.col(c) for c in judged}))
    words = vocab.select(F.col("target_word").alias("_w"))
    rows = (rows.join(words.withColumnRenamed("_w", "_target"),
                      F.col("target_word") == F.col("_target"), "left")
            .join(words.withColumnRenamed("_w", "_performed"),
                  F.col("performed_word") == F.col("_performed"), "left"))
    col, lit = F.col, F.lit

    def rule(code, broken, column=None):
        message = F.coalesce(col(column).cast("string"), lit("")) if column else lit(code)
        return Rule(code, broken, message, column)

    unlabelled = (col("_raw_expected_pass") == "") & (col("variant_status") == "unreviewed")
    usable = (col("quality_valid") & col("sample_type").isin(*SEMANTIC_TYPES)
              & (col("variant_status") != "unreviewed") & col("expected_pass").isNotNull())
    rules = [rule("empty", blank(c), c) for c in ("sample_id", "signer_id", "source", "source_sample_id")]
    rules += [
        rule("split", ~col("split").isin(*splits), "split"),
        rule("target_word", col("_target").isNull(), "target_word"),
        rule("performed_word", ~blank("performed_word") & col("_performed").isNull(), "performed_word"),
        rule("sample_type", ~col("sample_type").isin(*SAMPLE_TYPES), "sample_type"),
        rule("variant_status", ~col("variant_status").isin(*VARIANT_STATUSES), "variant_status"),
        rule("repeat_index", ~col("_raw_repeat_index").rlike("^(0|[1-9][0-9]*)$"), "_raw_repeat_index"),
        rule("quality_valid", col("quality_valid").isNull(), "_raw_quality_valid"),
        rule("accepted", col("accepted").isNull(), "_raw_accepted"),
        rule("score", ~F.coalesce(finite(col("score")) & col("score").between(0, 100), lit(False)),
             "_raw_score"),
        rule("expected_pass", col("expected_pass").isNull() & ~F.coalesce(unlabelled, lit(False)),
             "_raw_expected_pass"),
        rule("unshown_word", usable & blank("performed_word"), "performed_word"),
    ]
    rules += [rule("feature", col("quality_valid") & ~F.coalesce(within(col(b.name), b), lit(False)),
                   b.name) for b in BOUNDS]
    issues = row_issues(rows, rules)
    pairs = duplicates(rows.select("sample_id", "repeat_index", "row_number"),
                       ["sample_id", "repeat_index"])
    issues = issues.unionByName(pairs.select(
        lit("duplicate_pair").alias("code"), col("row_number").cast("long"),
        lit("sample_id").alias("column"),
        F.concat(col("sample_id"), lit(" also on row "), col("first_row").cast("string"))
        .alias("message")))
    crossing = leakage(raw, "signer_id", "split", splits)
    return issues.unionByName(crossing.select(
        lit("signer_leakage").alias("code"), lit(None).cast("long").alias("row_number"),
        lit("signer_id").alias("column"),
        F.concat(col("signer_id"), lit(": "), F.array_join("splits", ", ")).alias("message")))
