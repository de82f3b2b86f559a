"""Evaluate a labelled manifest and write the reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionmatch.functions.text import stripped
from motionmatch.operators.evaluation import (
    confusions, group_summary, latency_report, per_word, primary, semantic_auroc, split_truth, stability,
)
from motionmatch.operators.manifest import manifest_issues, resolve_path
from motionmatch.operators.rules import require_clean
from motionmatch.operators.sequence import repeat_samples
from motionmatch.plans.match import Prepared, match_recordings
from motionmatch.schemas import TIMINGS
from motionmatch.sources.files import move, remove, write_text
from motionmatch.sources.sinks import write_result_csv, write_small

# Fixed values of the summary record.
SUMMARY_VERSION = 1
BENCHMARK_LABEL = "proxy_dataset_results"
SEARCH_TARGET_MS = 60
MEASUREMENT_SCOPE = "fixture_measurement_only"


def evaluate(manifest: DataFrame, points: DataFrame, library: DataFrame, vocab: DataFrame, *,
             source: str, folder: str = "", repeats: int = 2, strict: bool = True,
             **options) -> DataFrame:
    """Result rows of every truth-labelled manifest row.

    ``points.sequence_id`` is the resolved keypoint path, so rows that share a file
    share its preparation.
    """
    if strict:
        require_clean(manifest_issues(manifest, vocab, source))
    included, _ = split_truth(manifest)
    path = stripped("keypoints_path")
    recordings = included.withColumn(
        "sequence_id", resolve_path(path, folder) if folder else path
    ).withColumn("recording_id", F.col("sample_id")).drop("row_number")
    if strict:
        lost = recordings.join(points.select("sequence_id").distinct(), "sequence_id", "left_anti")
        require_clean(lost.select(F.lit("keypoints_path").alias("code"), "sample_id"))
    prepared = Prepared(points.join(recordings.select("sequence_id").distinct(),
                                    "sequence_id", "left_semi"))
    results = match_recordings(prepared, recordings, library, vocab, **options)
    results = results.withColumns({
        "expected_pass": stripped("expected_pass") == "true",
        "quality_reasons": F.array_join("reasons", "|"),
        "trajectory_distance": F.lit(None).cast("double"),
        **{t: F.lit(None).cast("double") for t in TIMINGS}})
    return repeat_samples(results, repeats)


def reports(results: DataFrame, vocab: DataFrame) -> dict[str, DataFrame]:
    first = primary(results)
    words = vocab.select("ordinal", "target_word")
    return {"per_word": per_word(first, words).orderBy("ordinal").drop("ordinal"),
            "confusions": confusions(first, words).orderBy("target_word", "confused_with"),
            "groups": group_summary(first).orderBy("ordinal").drop("ordinal"),
            "semantic_auroc": semantic_auroc(first),
            "score_stability": stability(results)}


def latency(results: DataFrame) -> DataFrame:
    """Percentiles of the whole time of every attempt, and of two stages of those that were searched."""
    searched = F.col("quality_valid")
    return latency_report(results, {
        "total": F.col("total_ms"), "similarity": F.when(searched, F.col("similarity_ms")),
        "reference_search": F.when(searched, F.col("reference_search_ms"))})


def summary(results: DataFrame, counts: DataFrame) -> dict:
    """The evaluation as one record. ``counts`` is the row of counts that ``split_truth`` gives.

    Only reports of a bounded number of rows come to the driver. A percentile of a timing that no
    attempt has is null.
    """
    first = primary(results)
    rows = results.agg(F.count("*").alias("attempts"), F.count_if(F.col("repeat_index") == 0).alias("samples")).first()
    given = counts.first()
    groups = {r["sample_type"]: r.asDict() for r in group_summary(first).drop("ordinal").collect()}
    times = {r["metric"]: r for r in latency(results).collect()}
    return {
        "schema_version": SUMMARY_VERSION, "benchmark_label": BENCHMARK_LABEL,
        "manifest_row_count": given["manifest_row_count"],
        "evaluated_sample_count": rows["samples"], "attempt_count": rows["attempts"],
        "excluded": {"total_count": given["excluded_count"], "unreviewed_count": given["unreviewed_count"]},
        "groups": {name: {k: v for k, v in group.items() if k != "sample_type"} for name, group in groups.items()},
        "semantic_auroc": semantic_auroc(first).first().asDict(),
        "score_stability": stability(results).first().asDict(),
        "latency_ms": {**{f"{metric}_{p}": times[metric][p] if metric in times else None
                          for metric in ("total", "similarity", "reference_search") for p in ("p50", "p95")},
                       "focused_reference_search_target_ms": SEARCH_TARGET_MS, "measurement_scope": MEASUREMENT_SCOPE}}


def write_summary(spark: SparkSession, record: dict, path: str) -> None:
    write_text(spark, path, json.dumps(record, sort_keys=True, allow_nan=False) + "\n")


def write_evaluation(spark: SparkSession, results: DataFrame, vocab: DataFrame, folder: str,
                     counts: DataFrame | None = None) -> None:
    """Rows, per-word table, confusions and the other reports of an evaluation, all or none of them.

    The rows are written once and every report reads the written table. Everything stands beside its
    place first; the folder is renamed last and takes the place of an older one. With ``counts``, from
    ``split_truth``, the summary is written too.
    """
    folder = folder.rstrip("/")
    stage = f"{folder}.stage"
    remove(spark, stage)
    results.write.parquet(f"{stage}/sample_results.parquet")
    rows = spark.read.schema(results.schema).parquet(f"{stage}/sample_results.parquet")
    write_result_csv(rows, f"{stage}/sample_results.csv")
    for name, report in reports(rows, vocab).items():
        if name in ("per_word", "confusions"):
            write_small(report, f"{stage}/{name}.csv", "csv")
        else:
            write_small(report, f"{stage}/{name}")
    if counts is not None:
        write_summary(spark, summary(rows, counts), f"{stage}/summary.json")
    move(spark, stage, folder)
