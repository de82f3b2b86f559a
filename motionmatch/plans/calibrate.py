"""Fit, choose a threshold, freeze, reload, then test once."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionmatch.operators.calibration import (
    MODEL_VERSIONS, artifact_problems, compare, fit, match_score, probabilities,
    provenance, quality_thresholds, require_partitions, select_threshold, split_counts,
    training_version,
)
from motionmatch.operators.keypoint_rules import eligible, result_issues, typed_results
from motionmatch.operators.rules import require_clean
from motionmatch.schemas import FEATURES
from motionmatch.sources.scratch import settled
from motionmatch.sources.sinks import write_small


def read_eligible(raw: DataFrame, vocab: DataFrame) -> DataFrame:
    """Strictly checked, typed rows the calibrator may use."""
    require_clean(result_issues(raw, vocab))
    rows = eligible(typed_results(raw))
    require_partitions(rows)
    return rows


def freeze(model: PipelineModel, stats: dict, threshold: float, rows: DataFrame, *,
           source: str, synthetic_smoke: bool, features=FEATURES) -> dict:
    """Metadata of a fitted model; raises when a clause of its contract is broken."""
    known = rows.where(F.col("split").isin("train", "val"))
    origin = provenance(known).first()
    counts = {r["split"]: {k: int(r[k]) for k in ("sample_count", "positives", "negatives")}
              for r in split_counts(known).collect()}
    logistic = model.stages[-1]
    metadata = {
        "schema_version": 1, "feature_order": list(features), "pass_threshold": threshold,
        "model_version": MODEL_VERSIONS[synthetic_smoke],
        "training_data_version": training_version(known).first()["fingerprint"],
        "spark_version": rows.sparkSession.version, "quality_thresholds": quality_thresholds(),
        "synthetic_smoke": synthetic_smoke, "synthetic_markers": origin["synthetic_markers"],
        "training_sources": list(origin["training_sources"]),
        "scaling": {f: list(v) for f, v in stats.items()},
        "coefficients": [float(x) for x in logistic.coefficients],
        "intercept": float(logistic.intercept), **counts}
    broken = artifact_problems(metadata, source, features, rows.sparkSession.version)
    if broken:
        raise ValueError(f"model contract broken: {', '.join(broken)}")
    return metadata


def save(spark: SparkSession, model: PipelineModel, metadata: dict, folder: str) -> None:
    model.write().overwrite().save(f"{folder}/model")
    text = json.dumps(metadata, sort_keys=True, allow_nan=False)
    write_small(spark.createDataFrame([(text,)], "value string"), f"{folder}/metadata", "text")


def load(spark: SparkSession, folder: str, source: str) -> tuple[PipelineModel, dict]:
    metadata = json.loads(spark.read.text(f"{folder}/metadata").first()["value"])
    broken = artifact_problems(metadata, source, metadata["feature_order"], spark.version)
    if broken:
        raise ValueError(f"model contract broken: {', '.join(broken)}")
    return PipelineModel.load(f"{folder}/model"), metadata


def calibrate(rows: DataFrame, folder: str, *, source: str, synthetic_smoke: bool = False,
              features=FEATURES) -> tuple[dict, DataFrame, DataFrame]:
    """(metadata, comparison, predictions) of eligible rows; test is opened last.

    The rows are read by fit, choice, freeze and reports in turn, so they are written once.
    """
    spark = rows.sparkSession
    rows = settled(rows, "eligible")
    train, val, test = (rows.where(F.col("split") == s) for s in ("train", "val", "test"))
    model, stats = fit(train, features)
    judged = probabilities(model, stats, val)
    chosen = select_threshold(judged, "match_probability").first()
    if chosen is None:
        raise ValueError("no feasible threshold under the false acceptance limit")
    metadata = freeze(model, stats, chosen["threshold"], rows, source=source,
                      synthetic_smoke=synthetic_smoke, features=features)
    save(spark, model, metadata, folder)
    frozen, metadata = load(spark, folder, source)
    scaling = {f: tuple(v) for f, v in metadata["scaling"].items()}
    both = probabilities(frozen, scaling, val.unionByName(test))
    threshold = metadata["pass_threshold"]
    predictions = both.select(
        "sample_id", "split", "match_probability", match_score(F.col("match_probability")).alias("score"),
        (F.col("match_probability") >= threshold).alias("accepted"),
        F.lit(metadata["model_version"]).alias("model_version"),
        F.lit(synthetic_smoke).alias("synthetic_smoke"))
    return metadata, compare(both, threshold), predictions.orderBy("split", "sample_id")


