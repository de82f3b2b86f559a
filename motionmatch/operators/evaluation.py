"""Evaluation reports over result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionmatch.functions.scoring import safe_rate
from motionmatch.functions.text import stripped
from motionmatch.operators.ordered import OrderedRows
from motionmatch.operators.percentiles import exact_percentiles
from motionmatch.operators.sizing import SPREAD_BYTES, local_rows
from motionmatch.schemas import SAMPLE_TYPES, SEMANTIC_TYPES


def is_truth_labelled() -> Column:
    """Reviewed and labelled manifest text rows take part in an evaluation; a row without a status counts as reviewed."""
    return ~unreviewed() & (stripped(F.coalesce("expected_pass", F.lit(""))) != "")


def unreviewed() -> Column:
    return stripped(F.coalesce("variant_status", F.lit(""))) == "unreviewed"


def split_truth(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(included rows, one row of counts: rows, excluded, unreviewed excluded)."""
    labelled = is_truth_labelled()
    counts = manifest.agg(
        F.count("*").alias("manifest_row_count"),
        F.count_if(~labelled).alias("excluded_count"),
        F.count_if(~labelled & unreviewed()).alias("unreviewed_count"))
    return manifest.where(labelled), counts


def primary(results: DataFrame) -> DataFrame:
    return results.where("repeat_index = 0")


def names(spark, column: str, values: Sequence[str]) -> DataFrame:
    return local_rows(spark, enumerate(values), f"ordinal INT, {column} STRING")


def zero_fill(dimension: DataFrame, counts: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Every dimension row, with counts of absent keys as zero."""
    return dimension.join(counts, key, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in columns})


def group_summary(results: DataFrame, groups: Sequence[str] = SAMPLE_TYPES) -> DataFrame:
    """Counts and rates of each sample type, present or not."""
    counts = results.groupBy("sample_type").agg(
        F.count("*").alias("sample_count"), F.count_if("accepted").alias("accepted_count"))
    table = zero_fill(names(results.sparkSession, "sample_type", groups), counts, "sample_type",
                      ("sample_count", "accepted_count"))
    rejected = F.col("sample_count") - F.col("accepted_count")
    return table.select(
        "ordinal", "sample_type",
        F.when(F.col("sample_count") > 0, F.lit("available")).otherwise(F.lit("not_available"))
        .alias("status"),
        "sample_count", "accepted_count", rejected.alias("rejected_count"),
        safe_rate(F.col("accepted_count"), F.col("sample_count")).alias("acceptance_rate"),
        safe_rate(rejected, F.col("sample_count")).alias("rejection_rate"))


def per_word(results: DataFrame, words: DataFrame, word: str = "target_word") -> DataFrame:
    """Positive, negative and invalid rates of every word, in vocabulary order.

    Negatives are told by sample type alone: an accepted hard negative counts as a
    false acceptance whatever its label.
    """
    kind = F.col("sample_type")
    negative = kind.isin("hard_negative", "random_negative")
    accepted = F.col("accepted")
    counts = results.groupBy(word).agg(
        F.count_if(kind == "positive").alias("positive_count"),
        F.count_if((kind == "positive") & accepted).alias("_p"),
        F.count_if(negative).alias("negative_count"),
        F.count_if(negative & accepted).alias("_n"),
        F.count_if(kind == "invalid").alias("invalid_count"),
        F.count_if((kind == "invalid") & ~accepted).alias("_i"))
    table = zero_fill(words, counts, word, ("positive_count", "negative_count", "invalid_count"))
    return table.select(
        "ordinal", F.col(word).alias("word"),
        "positive_count", safe_rate(F.col("_p"), F.col("positive_count")).alias("positive_acceptance_rate"),
        "negative_count", safe_rate(F.col("_n"), F.col("negative_count")).alias("false_acceptance_rate"),
        "invalid_count", safe_rate(F.col("_i"), F.col("invalid_count")).alias("invalid_rejection_rate"))


def confusions(results: DataFrame, words: DataFrame, word: str = "target_word") -> DataFrame:
    """Rejected usable recordings by (target, nearest other word of the vocabulary)."""
    known = words.select(F.col(word).alias("nearest_confusion"))
    rows = results.where(
        F.col("quality_valid") & ~F.col("accepted")
        & (F.col("nearest_confusion") != F.col(word)))
    return rows.join(known, "nearest_confusion", "left_semi").groupBy(
        F.col(word).alias("target_word"), F.col("nearest_confusion").alias("confused_with")
    ).agg(F.count("*").alias("count"))


def stability(results: DataFrame, sample: str = "sample_id", score: str = "score_eval") -> DataFrame:
    """Spread of scores over the repeats of a sample (population deviation)."""
    each = results.groupBy(sample).agg(
        F.stddev_pop(score).alias("_sd"), F.count("*").alias("_n"))
    return each.agg(
        F.count("*").alias("sample_count"),
        F.coalesce(F.max("_n"), F.lit(0).cast("long")).alias("repeat_count"),
        F.bround(F.avg("_sd"), 6).alias("mean_score_stddev"),
        F.bround(F.max("_sd"), 6).alias("max_score_stddev"))


def auroc(rows: DataFrame, score: str, label: str, keys: Sequence[str] = (), *,
          spread_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null with one class only.

    Rows are counted per distinct score before anything is ordered.
    """
    keys = list(keys)
    each = rows.groupBy(*keys, F.col(score).cast("double").alias("_score")).agg(
        F.count_if(F.col(label)).alias("_pos"), F.count_if(~F.col(label)).alias("_neg"))
    ranked = OrderedRows(each, keys, ["_score"], spread_bytes=spread_bytes).running(
        _below=F.col("_neg")).done()
    # wins counts twice each pair, so it stays a whole number
    wins = F.col("_pos").cast("decimal(38,0)") * (2 * F.col("_below") - F.col("_neg"))
    out = ranked.groupBy(*keys).agg(
        F.coalesce(F.sum("_pos"), F.lit(0).cast("long")).alias("positive_count"),
        F.coalesce(F.sum("_neg"), F.lit(0).cast("long")).alias("negative_count"),
        F.sum(wins.cast("decimal(38,0)")).alias("_wins"))
    pairs = 2 * F.col("positive_count").cast("double") * F.col("negative_count")
    both = (F.col("positive_count") > 0) & (F.col("negative_count") > 0)
    return out.select(
        *keys, F.when(both, F.lit("available")).otherwise(F.lit("not_available")).alias("status"),
        F.when(both, F.col("_wins").cast("double") / pairs).alias("value"),
        "positive_count", "negative_count")


def semantic_auroc(results: DataFrame, **sizes) -> DataFrame:
    """Score against label over the semantic types; unusable rows count with score 0."""
    rows = results.where(F.col("sample_type").isin(*SEMANTIC_TYPES))
    return auroc(rows, "score_eval", "expected_pass", **sizes).withColumn(
        "value", F.bround("value", 6))


def latency_report(rows: DataFrame, columns: dict[str, Column], *,
                   fractions: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """Exact percentiles of each named timing as (metric, p50, p95, ...), all from one reading.

    A null timing is left out, so a stage that did not run does not count; a timing that is
    always null has no row.
    """
    timings = F.array(*[F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
                        for name, value in columns.items()])
    long = rows.select(F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind]).alias("row"), F.explode(timings).alias("t")).select("row", "t.*")
    report = exact_percentiles(long, ["metric"], "value", {f"p{f * 100:g}": f for f in fractions}, by=["row"])
    return report.select("metric", *[F.bround(c, 6).alias(c) for c in report.columns[1:]])
