"""Calibrating a match probability: fit on train, choose on val, report on test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionmatch.functions.scoring import GATE_RULE, finite, match_score
from motionmatch.operators.evaluation import auroc
from motionmatch.operators.fingerprint import fingerprint
from motionmatch.operators.ordered import OrderedRows
from motionmatch.operators.sizing import SPREAD_BYTES
from motionmatch.schemas import FEATURES, RESULT_IDENTITY, SEMANTIC_TYPES

MAX_FALSE_ACCEPTANCE = 0.10
# Names that betray rows made for a test.
SYNTHETIC_MARKERS = "synthetic|fixture|smoke"
MODEL_VERSIONS = {True: "calibrator-synthetic-smoke", False: "calibrator-v1"}


def split_counts(rows: DataFrame, label: str = "expected_pass") -> DataFrame:
    return rows.groupBy("split").agg(
        F.count("*").alias("sample_count"), F.count_if(F.col(label)).alias("positives"),
        F.count_if(~F.col(label)).alias("negatives"),
        F.count_if(F.col("sample_type") == "positive").alias("positive_rows"),
        F.count_if(F.col("sample_type") == "hard_negative").alias("hard_negative_rows"))


def require_partitions(rows: DataFrame) -> None:
    """All three splits present, both classes to learn from, both groups to judge by."""
    counts = {r["split"]: r for r in split_counts(rows).collect()}
    if set(counts) != {"train", "val", "test"}:
        raise ValueError("eligible train, val and test rows are required")
    if not counts["train"]["positives"] or not counts["train"]["negatives"]:
        raise ValueError("train requires both classes")
    if not counts["val"]["positive_rows"] or not counts["val"]["hard_negative_rows"]:
        raise ValueError("val requires positive and reviewed hard_negative")


def standardisation(rows: DataFrame, features: Sequence[str] = FEATURES,
                    keys: Sequence[str] = ()) -> DataFrame:
    """(feature, mean, scale): population deviation, 1 where a feature is constant."""
    stats = rows.groupBy(*keys).agg(*[
        F.struct(F.lit(f).alias("feature"), F.avg(f).alias("mean"), F.stddev_pop(f).alias("_sd"))
        .alias(f) for f in features])
    long = stats.select(*keys, F.explode(F.array(*features)).alias("s")).select(*keys, "s.*")
    return long.select(*keys, "feature", "mean",
                       F.when(F.col("_sd") == 0, F.lit(1.0)).otherwise(F.col("_sd")).alias("scale"))


def standardised(rows: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({
        f"z_{name}": (F.col(name) - mean) / scale for name, (mean, scale) in stats.items()})


def fit(train: DataFrame, features: Sequence[str] = FEATURES, label: str = "expected_pass"):
    """(PipelineModel over z_ columns, scaling stats). One L2 logistic model.

    The penalty is half the squared weights on the *sum* of losses; Spark averages
    the losses, hence regParam = 1/n.
    """
    stats = {r["feature"]: (r["mean"], r["scale"])
             for r in standardisation(train, features).collect()}
    n = train.count()
    assembler = VectorAssembler(inputCols=[f"z_{f}" for f in features], outputCol="features")
    logistic = LogisticRegression(
        featuresCol="features", labelCol="_label", regParam=1.0 / n, elasticNetParam=0.0,
        standardization=False, maxIter=1000, tol=1e-10)
    data = standardised(train, stats).withColumn("_label", F.col(label).cast("double"))
    model = logistic.fit(assembler.transform(data).select("features", "_label"))
    return PipelineModel([assembler, model]), stats


def probabilities(model: PipelineModel, stats: dict, rows: DataFrame,
                  name: str = "match_probability") -> DataFrame:
    scored = model.transform(standardised(rows, stats))
    return scored.withColumn(name, vector_to_array("probability")[1]).select(
        *[F.col(c) for c in rows.columns], name)


def frozen_probability(metadata: dict) -> Column:
    """Probability by the weights of frozen metadata, as one expression; equal to the model's own."""
    total = F.lit(float(metadata["intercept"]))
    for name, weight in zip(metadata["feature_order"], metadata["coefficients"]):
        mean, scale = metadata["scaling"][name]
        total = total + F.lit(float(weight)) * ((F.col(name) - mean) / scale)
    return 1 / (1 + F.exp(-total))


def predict_frozen(metadata: dict, rows: DataFrame) -> DataFrame:
    """``predict_match`` from frozen metadata, without loading a model."""
    p = F.col("match_probability")
    return rows.withColumn("match_probability", frozen_probability(metadata)).withColumns({
        "score": match_score(p), "accepted": p >= metadata["pass_threshold"],
        "model_version": F.lit(metadata["model_version"])})


def gradient(rows: DataFrame, metadata: dict, label: str = "expected_pass") -> DataFrame:
    """(feature, gradient) of the penalised mean loss at frozen weights, in one pass over the training rows;
    zeros where the fit has converged. The intercept has no penalty."""
    error = frozen_probability(metadata) - F.col(label).cast("double")
    names = metadata["feature_order"]
    sums = [F.avg(error * (F.col(f) - metadata["scaling"][f][0]) / metadata["scaling"][f][1]).alias(f) for f in names]
    once = rows.agg(F.count("*").alias("_n"), F.avg(error).alias("_intercept"), *sums)
    parts = [F.struct(F.lit("intercept").alias("feature"), F.col("_intercept").alias("gradient"))]
    parts += [F.struct(F.lit(f).alias("feature"), (F.col(f) + F.lit(float(w)) / F.col("_n")).alias("gradient"))
              for f, w in zip(names, metadata["coefficients"])]
    return once.select(F.explode(F.array(*parts)).alias("g")).select("g.*")


def predict_match(model: PipelineModel, stats: dict, threshold: float, rows: DataFrame,
                  model_version: str) -> DataFrame:
    """Probability, score and decision; apply the quality gate to ``rows`` first."""
    p = F.col("match_probability")
    return probabilities(model, stats, rows).withColumns({
        "score": match_score(p), "accepted": p >= threshold,
        "model_version": F.lit(model_version)})


def threshold_sweep(rows: DataFrame, probability: str, keys: Sequence[str] = (), *,
                    spread_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Acceptance and false acceptance at each candidate (every probability, 0 and 1).

    A row passes at p >= t. Rows are counted per distinct probability, then summed
    downwards.
    """
    keys = list(keys)
    kind = F.col("sample_type")
    counted = rows.groupBy(*keys, F.col(probability).cast("double").alias("threshold")).agg(
        F.count_if(kind == "positive").alias("_p"), F.count_if(kind == "hard_negative").alias("_h"))
    zero = F.lit(0).cast("long")
    ends = rows.select(*keys).distinct() if keys else rows.agg(F.count("*").alias("_n")).drop("_n")
    ends = ends.select(*keys, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("threshold"),
                       zero.alias("_p"), zero.alias("_h"))
    both = counted.unionByName(ends).groupBy(*keys, "threshold").agg(
        F.sum("_p").alias("_p"), F.sum("_h").alias("_h"))
    swept = OrderedRows(both, keys, ["threshold"], descending=True, spread_bytes=spread_bytes).running(
        totals=True, passed=F.col("_p"), false_passed=F.col("_h")).done()
    return swept.select(
        *keys, "threshold",
        F.try_divide("passed", "passed_total").alias("positive_acceptance_rate"),
        F.try_divide("false_passed", "false_passed_total").alias("false_acceptance_rate"))


def select_threshold(rows: DataFrame, probability: str, keys: Sequence[str] = (), *,
                     limit: float = MAX_FALSE_ACCEPTANCE,
                     spread_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Best feasible threshold: most positives, then fewest false, then the highest.

    No row comes back for a group in which every candidate is infeasible.
    """
    swept = threshold_sweep(rows, probability, keys, spread_bytes=spread_bytes)
    best = F.max(F.struct(
        F.col("positive_acceptance_rate"), (-F.col("false_acceptance_rate")).alias("_far"),
        F.col("threshold")))
    chosen = swept.where(F.col("false_acceptance_rate") <= limit).groupBy(*keys).agg(best.alias("b"))
    return chosen.where(F.col("b").isNotNull()).select(
        *keys, "b.threshold", "b.positive_acceptance_rate",
        F.abs(F.col("b._far")).alias("false_acceptance_rate"))


def metrics(rows: DataFrame, score: str, accepted: Column, keys: Sequence[str] = ("split",), *,
            label: str = "expected_pass", spread_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Counts and acceptance rates by sample type, and AUROC of ``score``."""
    keys = list(keys)
    judged = rows.withColumn("_ok", accepted)
    names = ("positive_acceptance_rate", "hard_negative_false_acceptance_rate",
             "random_negative_false_acceptance_rate")
    columns = [F.count("*").alias("sample_count")]
    for group, name in zip(SEMANTIC_TYPES, names):
        mine = F.col("sample_type") == group
        columns += [F.count_if(mine).alias(f"{group}_count"),
                    F.avg(F.when(mine, F.col("_ok").cast("double"))).alias(name)]
    rates = judged.groupBy(*keys).agg(*columns)
    area = auroc(rows, score, label, keys, spread_bytes=spread_bytes).select(
        *keys, F.col("value").alias("auroc"))
    return rates.join(area, keys, "left")


def compare(rows: DataFrame, threshold: float, keys: Sequence[str] = ("split",), **sizes) -> DataFrame:
    """Calibrated and given decisions side by side, same rows."""
    calibrated = metrics(rows, "match_probability", F.col("match_probability") >= threshold,
                         keys, **sizes)
    given = metrics(rows, "score", F.col("accepted"), keys, **sizes)
    return calibrated.withColumn("decider", F.lit("calibrated")).withColumn(
        "threshold", F.lit(threshold)).unionByName(
        given.withColumn("decider", F.lit("baseline")).withColumn(
            "threshold", F.lit(None).cast("double")))


def training_version(train_and_val: DataFrame) -> DataFrame:
    """Digest of identity and features; scores, timings and test rows have no part."""
    return fingerprint(train_and_val.where(F.col("split").isin("train", "val")),
                       [*RESULT_IDENTITY, *FEATURES])


def provenance(rows: DataFrame) -> DataFrame:
    """Sources of the rows, and whether any row looks made for a test."""
    marked = None
    for c in ("source", "sample_id", "source_sample_id", "signer_id"):
        hit = F.lower(c).rlike(SYNTHETIC_MARKERS)
        marked = hit if marked is None else marked | hit
    return rows.agg(F.array_sort(F.collect_set("source")).alias("training_sources"),
                    F.coalesce(F.bool_or(marked), F.lit(False)).alias("synthetic_markers"))


def artifact_problems(metadata: dict, source: str, features: Sequence[str] = FEATURES,
                      runtime_version: str | None = None) -> list[str]:
    """Broken clauses of a frozen model's contract; empty when it may be used."""
    m, problems = metadata, []

    def need(ok: bool, what: str) -> None:
        if not ok:
            problems.append(what)

    def real(x) -> bool:
        return type(x) in (int, float) and x == x and abs(x) != float("inf")

    need(m.get("schema_version") == 1 and type(m.get("schema_version")) is int, "schema_version")
    need(list(m.get("feature_order", ())) == list(features), "feature_order")
    threshold = m.get("pass_threshold")
    need(real(threshold) and 0 <= threshold <= 1, "pass_threshold")
    need(m.get("quality_thresholds") == quality_thresholds(), "quality_thresholds")
    version = m.get("training_data_version")
    need(isinstance(version, str) and len(version) == 64
         and set(version) <= set("0123456789abcdef"), "training_data_version")
    smoke, marked = m.get("synthetic_smoke"), m.get("synthetic_markers")
    need(type(smoke) is bool and type(marked) is bool, "synthetic flags")
    need(m.get("model_version") == MODEL_VERSIONS.get(bool(smoke)), "model_version")
    sources = m.get("training_sources")
    need(isinstance(sources, list) and bool(sources) and all(sources), "training_sources")
    need(bool(smoke) or (marked is False and sources == [source]), "real run on synthetic rows")
    for split in ("train", "val"):
        counts = m.get(split) or {}
        numbers = [counts.get(k) for k in ("sample_count", "positives", "negatives")]
        ok = all(type(n) is int for n in numbers)
        need(ok and numbers[0] == numbers[1] + numbers[2] and min(numbers[1:]) >= 1,
             f"{split} counts")
    weights = m.get("coefficients") or []
    need(len(weights) == len(features) and all(map(real, weights))
         and real(m.get("intercept")), "coefficients")
    scaling = m.get("scaling") or {}
    need(set(scaling) == set(features) and all(
        real(a) and real(b) and b > 0 for a, b in scaling.values()), "scaling")
    if runtime_version is not None:
        need(m.get("spark_version") == runtime_version, "spark_version")
    return problems


def quality_thresholds() -> dict[str, float]:
    return {"min_hand_visibility": GATE_RULE.min_visibility,
            "min_motion_energy": GATE_RULE.min_energy,
            "min_motion_span": GATE_RULE.min_span,
            "min_sequence_completeness": GATE_RULE.min_completeness}


def probability_ok(name: str = "match_probability") -> Column:
    return finite(F.col(name)) & F.col(name).between(0.0, 1.0)
