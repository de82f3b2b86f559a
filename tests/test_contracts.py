"""Input contracts: searches, truth labels, digests of long files, reports of a calibration."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionmatch.operators.calibration import fit, frozen_probability, gradient, probabilities
from motionmatch.operators.evaluation import split_truth
from motionmatch.operators.search import search
from motionmatch.schemas import FEATURES
from motionmatch.sources.scans import file_digests
from motionmatch.sources.sinks import write_calibration

LIB = "ref_id long, word string, embedding array<float>"
ASKED = "query_id string, target string, embedding array<float>"


@pytest.mark.parametrize("way", [{}, {"broadcast_bytes": 0, "tile_bytes": 64}])
@pytest.mark.parametrize("library, asked, message", [
    ([], [1.0, 0.0], "empty"), ([[1.0, 0.0], [1.0]], [1.0, 0.0], "dimension"), ([[1.0, 0.0], [0.0, 1.0]], [1.0], "components"),
    ([[1.0, 0.0], [0.0, 1.0]], [float("nan"), 0.0], "finite"), ([[1.0, float("inf")], [0.0, 1.0]], [1.0, 0.0], "finite")])
def test_unusable_inputs_of_a_search_are_errors(spark, way, library, asked, message):
    lib = spark.createDataFrame([(k, f"W{k}", v) for k, v in enumerate(library)], LIB)
    with pytest.raises(Exception, match=message):
        search(spark.createDataFrame([("q", "W0", asked)], ASKED), lib, **way).collect()


def test_every_row_is_included_or_counted(spark):
    rows = spark.createDataFrame([("a", None, "true"), ("b", "unreviewed ", "true"), ("c", "target_variant", "\t"),
                                  ("d", "target_variant", "true\t"), ("e", None, None)],
                                 "sample_id string, variant_status string, expected_pass string")
    included, counts = split_truth(rows)
    assert sorted(r.sample_id for r in included.collect()) == ["a", "d"]
    assert counts.first().asDict() == {"manifest_row_count": 5, "excluded_count": 3, "unreviewed_count": 1}


def test_long_files_are_digested_in_chunks(spark, tmp_path):
    contents = {"a": b"1", "b": b"short", "c": bytes(range(256)) * 700, "d": b"x" * 5_000_000}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    with open(tmp_path / "sparse", "wb") as f:
        f.truncate((2 << 30) + 5)                        # no array of the JVM holds it
    for limit in (0, 100, 1_000_000):
        got = {r.path.rsplit("/", 1)[1]: r.actual_digest for r in file_digests(
            spark, str(tmp_path), whole_bytes=limit, chunk_bytes=1 << 20).where(~F.col("path").endswith("sparse") | F.lit(limit == 100)).collect()}
        assert {n: got[n] for n in contents} == {n: hashlib.sha256(d).hexdigest() for n, d in contents.items()}
        if limit == 100:
            want, block = hashlib.sha256(), bytes(1 << 20)
            for _ in range(2048):
                want.update(block)
            want.update(bytes(5))
            assert got["sparse"] == want.hexdigest()


def judged(spark, n=400):
    rng = np.random.default_rng(2)
    x = rng.random((n, len(FEATURES)))
    y = x @ rng.normal(size=len(FEATURES)) + rng.normal(0, 0.5, n)
    return spark.createDataFrame([(*map(float, r), bool(v > np.median(y))) for r, v in zip(x, y)],
                                 ", ".join(f"{f} double" for f in FEATURES) + ", expected_pass boolean")


def test_frozen_weights_give_the_models_probabilities(spark):
    rows = judged(spark)
    model, stats = fit(rows)
    logistic = model.stages[-1]
    frozen = {"feature_order": list(FEATURES), "scaling": stats, "coefficients": list(logistic.coefficients), "intercept": logistic.intercept}
    both = probabilities(model, stats, rows).withColumn("p", frozen_probability(frozen)).collect()
    assert max(abs(r.p - r.match_probability) for r in both) < 1e-12
    slopes = {r.feature: r.gradient for r in gradient(rows, frozen).collect()}
    assert set(slopes) == {"intercept", *FEATURES} and max(map(abs, slopes.values())) < 1e-5
    moved = {**frozen, "coefficients": [w + 0.3 for w in frozen["coefficients"]]}
    assert max(abs(r.gradient) for r in gradient(rows, moved).collect()) > 1e-3


def test_reports_of_a_rerun_are_the_same(spark, tmp_path):
    compared = spark.createDataFrame([("calibrated", "val", 3, 0.5), ("baseline", "val", 3, 0.25)], "decider string, split string, sample_count long, auroc double")
    predictions = spark.createDataFrame([(f"s{k}", "val", k) for k in range(50)], "sample_id string, split string, score int")
    def texts():
        files = sorted(p for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.endswith(".crc"))
        return [(p.parent.name, p.read_bytes()) for p in files if p.parent.name in ("comparison", "metrics", "metadata") and p.name.startswith("part")]
    runs = []
    for parts in (1, 7):
        write_calibration(spark, str(tmp_path / "out"), {"b": 1, "a": [0.5]}, compared.repartition(parts), predictions.repartition(parts))
        runs.append((texts(), spark.read.parquet(str(tmp_path / "out/predictions")).orderBy("sample_id").collect()))
    assert runs[0] == runs[1] and len(runs[0][0]) == 3 and not (tmp_path / "out.stage").exists()
