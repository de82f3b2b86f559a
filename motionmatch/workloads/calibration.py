"""Calibration over ``labels`` joined with ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionmatch.operators.calibration import (
    compare, fit, frozen_probability, gradient, match_score, predict_frozen, predict_match, probabilities, probability_ok,
    provenance, standardisation,
)
from motionmatch.plans.calibrate import calibrate
from motionmatch.schemas import FEATURES
from motionmatch.sources.scratch import scratch_path
from motionmatch.sources.sinks import write_calibration
from motionmatch.workloads.evaluation import metrics_sql
from motionmatch.workloads.views import SOURCE, rounded, table

# Text measures stand in for the nine match features, in feature order.
_MEASURES = (
    "least(n_chars / 5000, 1.0)", "length(regexp_replace(text, '[a-z]', '')) / greatest(n_chars, 1)",
    "size(split(text, ' ')) / greatest(n_chars, 1)", "least(size(split(text, '\\n')) / 50, 1.0)",
    "length(regexp_replace(text, '[^0-9]', '')) / greatest(n_chars, 1)", "ln(n_chars + 1)",
    "least(size(array_distinct(split(text, ' '))) / size(split(text, ' ')), 1.0)",
    "length(regexp_replace(text, '[^.]', '')) / greatest(n_chars, 1)",
    "length(regexp_replace(text, '[^A-Z]', '')) / greatest(n_chars, 1)",
)


def rows(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents as eligible result rows; good ones are positives."""
    docs = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    good = F.col("quality") == 1
    return docs.select(
        F.col("doc_id").cast("string").alias("sample_id"), F.lit("HELLO").alias("target_word"),
        F.lit("HELLO").alias("performed_word"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("signer_id"),
        F.lit(SOURCE).alias("source"),
        F.expr("CASE WHEN doc_id % 5 < 3 THEN 'train' WHEN doc_id % 5 = 3 THEN 'val' ELSE 'test' END").alias("split"),
        F.when(good, F.lit("positive")).when(F.col("toxic") == 1, F.lit("random_negative"))
        .otherwise(F.lit("hard_negative")).alias("sample_type"), good.alias("expected_pass"),
        F.when(good, F.lit("target_variant")).otherwise(F.lit("different_sign")).alias("variant_status"),
        F.col("doc_id").cast("string").alias("source_sample_id"), F.lit("").alias("anomaly_type"),
        F.lit(0).cast("long").alias("repeat_index"), F.lit(True).alias("quality_valid"),
        *[F.expr(e).alias(f) for f, e in zip(FEATURES, _MEASURES)],
        (F.col("n_chars") % 101).cast("double").alias("score"), (F.col("n_chars") % 101 >= 80).alias("accepted"))


def ml1(spark, folder):
    """Weights of the fitted model, per feature."""
    train = rows(spark, folder).where("split = 'train'")
    model, stats = fit(train)
    weights = model.stages[-1].coefficients
    return spark.createDataFrame(
        [(f, float(weights[i]), *map(float, stats[f])) for i, f in enumerate(FEATURES)],
        "feature string, weight double, mean double, scale double")


def ml1_scaling(spark, folder):
    train = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id").select(
        (F.col("n_chars") / 5000).alias("size"), F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"), "lang")
    return standardisation(train, ("size", "quality", "toxic"), ["lang"]).select("lang", "feature", rounded("mean"), rounded("scale"))


ML1_SCALING_SQL = " UNION ALL ".join(
    f"SELECT lang, '{n}' AS feature, round(avg({e}), 6) AS mean, round(CASE WHEN stddev_pop({e}) = 0 THEN 1.0 ELSE stddev_pop({e}) END, 6) AS scale "
    "FROM labels JOIN documents USING (doc_id) GROUP BY lang" for n, e in (("size", "n_chars / 5000"), ("quality", "quality"), ("toxic", "toxic")))


def ml2(spark, folder):
    data = rows(spark, folder)
    model, stats = fit(data.where("split = 'train'"))
    scored = probabilities(model, stats, data)
    # A probability that is none is an error, not a row to hide.
    sound = F.when(probability_ok(), F.col("match_probability")).otherwise(
        F.raise_error(F.lit("probability out of range")).cast("double"))
    return scored.withColumn("match_probability", sound).select("sample_id", "split", F.round("match_probability", 6).alias("match_probability"))


def ml3(spark, folder):
    """Frozen, saved, reloaded, then tested: the metadata that was reloaded."""
    metadata, _, _ = calibrate(rows(spark, folder), scratch_path(spark, "calibrator"), source=SOURCE)
    kept = [(k, str(v)) for k, v in metadata.items() if k in (
        "model_version", "schema_version", "training_data_version", "training_sources", "train", "val")]
    return spark.createDataFrame(kept, "name string, value string")


def ml5(spark, folder):
    data = rows(spark, folder)
    model, stats = fit(data.where("split = 'train'"))
    return predict_match(model, stats, 0.5, data.where("split = 'test'"), "calibrator-v1").select(
        "sample_id", "score", "accepted", "model_version")


def ml6(spark, folder):
    _, comparison, _ = calibrate(rows(spark, folder), scratch_path(spark, "calibrator"), source=SOURCE)
    return comparison


def sink3(spark, folder):
    """Predictions written in order and read back."""
    _, _, predictions = calibrate(rows(spark, folder), scratch_path(spark, "calibrator"), source=SOURCE)
    path = scratch_path(spark, "predictions")
    predictions.write.parquet(path)
    return spark.read.parquet(path)


def ml1_gradient(spark, folder):
    """The penalised gradient at the fitted weights, four decimals: zero throughout."""
    train = rows(spark, folder).where("split = 'train'")
    model, stats = fit(train)
    logistic = model.stages[-1]
    fitted = {"feature_order": list(FEATURES), "scaling": stats, "coefficients": list(logistic.coefficients), "intercept": logistic.intercept}
    return gradient(train, fitted).select("feature", rounded("gradient", 4))


ML1_GRADIENT_SQL = "SELECT unnest([{}]) AS feature, 0.0 AS gradient".format(", ".join(f"'{f}'" for f in ("intercept", *FEATURES)))

# Order lines as judged rows under a model with given weights: every value can be recomputed.
_GIVEN = dict(zip(FEATURES, (
    "l_quantity / 50", "l_discount * 10", "l_tax * 10", "l_extendedprice / 100000", "l_linenumber / CAST(7 AS DOUBLE)",
    "(l_partkey % 10) / CAST(10 AS DOUBLE)", "(l_suppkey % 7) / CAST(7 AS DOUBLE)", "(l_orderkey % 5) / CAST(5 AS DOUBLE)", "abs(l_quantity - 25) / 25")))
_WEIGHTS = (1.5, -0.75, 0.25, 2.0, -0.5, 0.125, -1.25, 0.375, -0.625)
FROZEN = {"feature_order": list(FEATURES), "scaling": {f: (0.5, 0.25) for f in FEATURES}, "coefficients": list(_WEIGHTS),
          "intercept": 0.3, "pass_threshold": 0.62, "model_version": "calibrator-v1"}
_GIVEN_COLUMNS = {
    "sample_id": "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)",
    "split": "CASE WHEN l_orderkey % 5 < 3 THEN 'train' WHEN l_orderkey % 5 = 3 THEN 'val' ELSE 'test' END",
    "sample_type": "CASE WHEN l_returnflag = 'R' THEN 'positive' WHEN l_linestatus = 'O' THEN 'hard_negative' ELSE 'random_negative' END",
    "expected_pass": "l_returnflag = 'R'", "score": "CAST(l_quantity AS DOUBLE)", "accepted": "l_quantity >= 30", **_GIVEN}
_P = "1 / (1 + exp(-(0.3 + {})))".format(" + ".join(f"{w} * (({f} - 0.5) / 0.25)" for f, w in zip(FEATURES, _WEIGHTS)))
_GIVEN_SQL = ("semantic AS (SELECT *, {} AS match_probability FROM (SELECT {} FROM lineitem))".format(
    _P, ", ".join(f"{e} AS {c}" for c, e in _GIVEN_COLUMNS.items())))


def given_rows(spark, folder):
    return table(spark, folder, "lineitem").select(*[F.expr(e).alias(c) for c, e in _GIVEN_COLUMNS.items()])


def ml2_given(spark, folder):
    return predict_frozen(FROZEN, given_rows(spark, folder)).select("sample_id", rounded("match_probability"))


ML2_GIVEN_SQL = f"WITH {_GIVEN_SQL} SELECT sample_id, round(match_probability, 6) + 0.0 AS match_probability FROM semantic"


def ml5_given(spark, folder):
    scored = predict_frozen(FROZEN, given_rows(spark, folder).where("split = 'test'"))
    return scored.select("sample_id", "score", "accepted", "model_version")


ML5_GIVEN_SQL = (f"WITH {_GIVEN_SQL} SELECT sample_id, CAST(round_even(100 * match_probability, 0) AS INTEGER) AS score, match_probability >= 0.62 AS accepted, "
                 "'calibrator-v1' AS model_version FROM semantic WHERE split = 'test'")


def given_comparison(spark, folder):
    judged = given_rows(spark, folder).withColumn("match_probability", F.round(frozen_probability(FROZEN), 6))
    return compare(judged.where("split <> 'train'"), FROZEN["pass_threshold"])


def _compared(rows):
    return rows.select("decider", "split", "sample_count", "positive_count", "hard_negative_count", "random_negative_count", "threshold",
                       *[rounded(c) for c in ("positive_acceptance_rate", "hard_negative_false_acceptance_rate",
                                              "random_negative_false_acceptance_rate", "auroc")])


def ml6_given(spark, folder):
    return _compared(given_comparison(spark, folder))


ML6_GIVEN_SQL = (f"WITH {_GIVEN_SQL}".replace("semantic AS", "every AS")
                 + ", semantic AS (SELECT * REPLACE (round(match_probability, 6) AS match_probability) FROM every WHERE split <> 'train') "
                 + metrics_sql("(match_probability >= 0.62)", "match_probability", ", 'calibrated' AS decider, 0.62 AS threshold")
                 + " UNION ALL BY NAME " + metrics_sql("accepted", "score", ", 'baseline' AS decider, CAST(NULL AS DOUBLE) AS threshold"))


def sink3_reports(spark, folder):
    """All reports of a calibration written together; the comparison and the predictions read back and joined."""
    path, compared = scratch_path(spark, "calibration"), given_comparison(spark, folder)
    scored = predict_frozen(FROZEN, given_rows(spark, folder).where("split <> 'train'")).select(
        "sample_id", "split", "score", "accepted", "model_version")
    write_calibration(spark, path, FROZEN, compared, scored)
    metrics = spark.read.schema(compared.drop("decider").schema).json(f"{path}/metrics").select("split", "sample_count", rounded("auroc"))
    back = spark.read.schema(scored.schema).parquet(f"{path}/predictions").groupBy("split").agg(
        F.count("*").alias("rows"), F.count_if("accepted").alias("accepted"), F.sum("score").alias("scores"))
    text = F.lit(spark.read.text(f"{path}/metadata").first()["value"])
    return metrics.join(back, "split").withColumn("threshold", F.get_json_object(text, "$.pass_threshold").cast("double"))


SINK3_REPORTS_SQL = (
    f"WITH {_GIVEN_SQL}".replace("semantic AS", "every AS")
    + ", semantic AS (SELECT * REPLACE (round(match_probability, 6) AS match_probability) FROM every WHERE split <> 'train'), "
    + "back AS (SELECT split, count(*) AS rows, count(*) FILTER (match_probability >= 0.62) AS accepted, "
    + "CAST(sum(round_even(100 * match_probability, 0)) AS BIGINT) AS scores FROM every WHERE split <> 'train' GROUP BY 1) "
    + "SELECT split, sample_count, round(auroc, 6) + 0.0 AS auroc, rows, accepted, scores, 0.62 AS threshold FROM ("
    + metrics_sql("(match_probability >= 0.62)", "match_probability") + ") JOIN back USING (split)")


def fn13(spark, folder):
    p = F.col("l_quantity") / 50 * (1 - F.col("l_discount"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", match_score(p).alias("score"), (p >= 0.5).alias("accepted"))


FN13_SQL = ("SELECT l_orderkey, l_linenumber, l_partkey, CAST(round_even(100 * (l_quantity / 50 * (1 - l_discount)), 0) AS INTEGER) AS score, "
            "l_quantity / 50 * (1 - l_discount) >= 0.5 AS accepted FROM lineitem")


def agg11(spark, folder):
    """Sources of the documents; ids are searched for tell-tale names."""
    docs = table(spark, folder, "documents")
    return provenance(docs.select(
        "source", F.col("doc_id").cast("string").alias("sample_id"), F.col("lang").alias("source_sample_id"),
        F.when(F.col("doc_id") == 77, F.lit("Smoke-1")).otherwise(F.lit("c")).alias("signer_id"))).select(
        F.array_join("training_sources", ",").alias("sources"), "synthetic_markers")


AGG11_SQL = ("SELECT string_agg(DISTINCT source, ',' ORDER BY source) AS sources, bool_or(doc_id = 77 OR regexp_matches(lower(source), 'synthetic|fixture|smoke')) "
             "AS synthetic_markers FROM documents")

QUERIES = {
    "ml1_fit": (ml1, None),
    "ml1_gradient": (ml1_gradient, ML1_GRADIENT_SQL),
    "ml2_given_weights": (ml2_given, ML2_GIVEN_SQL),
    "ml5_given_weights": (ml5_given, ML5_GIVEN_SQL),
    "ml6_given_weights": (ml6_given, ML6_GIVEN_SQL),
    "sink3_reports": (sink3_reports, SINK3_REPORTS_SQL),
    "ml1_scaling": (ml1_scaling, ML1_SCALING_SQL),
    "ml2_probabilities": (ml2, None),
    "ml3_ml4_freeze_reload": (ml3, None),
    "ml5_predict_match": (ml5, None),
    "ml6_calibrated_vs_baseline": (ml6, None),
    "sink3_predictions": (sink3, None),
    "fn13_match_score": (fn13, FN13_SQL),
    "agg11_provenance": (agg11, AGG11_SQL),
}
