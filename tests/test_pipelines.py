"""Evaluation, manifest and calibration from end to end on small inputs."""

import json

import pytest
from fixtures import POINT_SCHEMA, calibration_rows, clips, manifest_rows
from pyspark.sql import functions as F

from motionmatch.operators.calibration import artifact_problems, training_version
from motionmatch.operators.evaluation import split_truth
from motionmatch.operators.keypoint_rules import eligible, keypoint_issues, result_issues, typed_results
from motionmatch.operators.manifest import label_rows, manifest_issues, signer
from motionmatch.plans.build_manifest import build_manifest
from motionmatch.plans.calibrate import calibrate, load, read_eligible
from motionmatch.plans.evaluate import evaluate, reports, summary, write_evaluation
from motionmatch.plans.match import Prepared
from motionmatch.schemas import CALIBRATION_COLUMNS, KEYPOINT_COLUMNS, MANIFEST_COLUMNS, MANIFEST_SCHEMA, RESULT_COLUMNS
from motionmatch.sources.scans import empty_files, list_media, scan_keypoints, scan_manifest
from motionmatch.sources.sinks import write_manifest
from motionmatch.vocabulary import scan_vocabulary, vocabulary_issues

CAL_SCHEMA = "row_number long, " + ", ".join(f"{c} string" for c in CALIBRATION_COLUMNS)


@pytest.fixture(scope="module")
def evaluated(spark, vocab):
    points = spark.createDataFrame(clips(), POINT_SCHEMA)
    manifest = spark.createDataFrame(manifest_rows(), "row_number long, " + MANIFEST_SCHEMA)
    ready = Prepared(points)
    library = ready.embeddings().where("sequence_id <> 'no-hands'").select(
        F.when(F.col("sequence_id") == "hello", 0).otherwise(1).alias("ref_id"),
        F.upper("sequence_id").alias("word"), "embedding").persist()
    return evaluate(manifest, points, library, vocab, source="clips").persist()


def test_evaluation_report(evaluated, vocab):
    found = {name: report.collect() for name, report in reports(evaluated, vocab).items()}
    groups = {r["sample_type"]: r for r in found["groups"]}
    assert groups["positive"]["acceptance_rate"] == 1.0
    assert groups["hard_negative"]["acceptance_rate"] == groups["random_negative"]["acceptance_rate"] == 0.0
    assert groups["invalid"]["rejection_rate"] == 1.0
    assert found["semantic_auroc"][0]["value"] == 1.0
    assert len(found["per_word"]) == 30 and found["per_word"][0]["word"] == "HELLO"
    assert [(r["target_word"], r["confused_with"], r["count"]) for r in found["confusions"]] == [
        ("HELLO", "PLEASE", 1), ("PLEASE", "HELLO", 1)]
    spread = found["score_stability"][0]
    assert (spread["sample_count"], spread["repeat_count"], spread["mean_score_stddev"]) == (5, 2, 0.0)
    gated = evaluated.where("sample_type = 'invalid'").first()
    assert (gated["score"], gated["score_eval"], gated["decision"], gated["target_similarity"]) == (None, 0, "rerecord", None)


def test_truth_counts(spark):
    manifest = spark.createDataFrame(manifest_rows(), "row_number long, " + MANIFEST_SCHEMA)
    _, counts = split_truth(manifest)
    assert tuple(counts.first()) == (6, 1, 1)


def test_reports_rerun_byte_for_byte(spark, evaluated, vocab, tmp_path):
    texts = []
    for run in ("a", "b"):
        write_evaluation(spark, evaluated.repartition(1 if run == "a" else 5), vocab, str(tmp_path / run))
        parts = sorted((tmp_path / run).rglob("part-*.json")) + sorted((tmp_path / run).rglob("part-*.csv"))
        texts.append(b"".join(p.read_bytes() for p in parts))
    assert texts[0] == texts[1] and b"true" in texts[0]
    header = next((tmp_path / "a" / "sample_results.csv").glob("part-*.csv")).read_text().splitlines()[0]
    assert tuple(header.split(",")) == RESULT_COLUMNS


def test_summary_is_written_with_the_reports(spark, evaluated, vocab, tmp_path):
    manifest = spark.createDataFrame(manifest_rows(), "row_number long, " + MANIFEST_SCHEMA)
    place = tmp_path / "report"
    for _ in range(2):  # the second takes the place of the first
        write_evaluation(spark, evaluated, vocab, str(place), split_truth(manifest)[1])
    found = json.loads((place / "summary.json").read_text())
    assert (found["manifest_row_count"], found["evaluated_sample_count"], found["attempt_count"]) == (6, 5, 10)
    assert found["excluded"] == {"total_count": 1, "unreviewed_count": 1}
    assert list(found["groups"]) == ["hard_negative", "invalid", "positive", "random_negative"]
    assert found["groups"]["positive"]["acceptance_rate"] == found["semantic_auroc"]["value"] == 1.0
    assert found["latency_ms"]["total_p50"] is None  # a batch has no time of a single attempt
    timed = evaluated.withColumn("total_ms", F.lit(3.0) + F.col("repeat_index"))
    assert summary(timed, split_truth(manifest)[1])["latency_ms"]["total_p50"] == 3.5
    words = spark.read.option("header", True).csv(str(place / "per_word.csv")).collect()
    assert len(words) == 30 and words[0]["word"] == "HELLO"
    pairs = spark.read.option("header", True).csv(str(place / "confusions.csv")).collect()
    assert [(r["target_word"], r["confused_with"], r["count"]) for r in pairs] == [("HELLO", "PLEASE", "1"), ("PLEASE", "HELLO", "1")]
    assert not (tmp_path / "report.stage").exists()


def test_missing_keypoints_are_an_error(spark, vocab):
    manifest = spark.createDataFrame(manifest_rows(), "row_number long, " + MANIFEST_SCHEMA)
    points = spark.createDataFrame([c for c in clips() if c[0] != "please"], POINT_SCHEMA)
    with pytest.raises(ValueError, match="keypoints_path"):
        evaluate(manifest, points, points, vocab, source="clips")


MUTATIONS = [
    ({"target_word": "ZEBRA"}, {"target_word", "variant_performed_word"}), ({"source": "x"}, {"source"}),
    ({"split": "dev"}, {"split"}), ({"sample_type": "odd"}, {"sample_type"}),
    ({"variant_status": "new"}, {"variant_status", "positive_variant"}),
    ({"expected_pass": "yes"}, {"expected_pass", "variant_expected_pass"}),
    ({"performed_word": "FATHER"}, {"performed_word_product_key", "variant_performed_word"}),
    ({"variant_status": "unreviewed", "expected_pass": ""}, {"unreviewed_performed_word", "positive_variant"}),
    ({"signer_id": " "}, {"required"}), ({"sample_id": "synthetic:positive:please"}, {"duplicate_sample_id"}),
    ({"signer_id": "s2", "split": "val"}, {"signer_leakage"}), ({}, set()),
]


@pytest.mark.parametrize("change,codes", MUTATIONS)
def test_manifest_rules(spark, vocab, change, codes):
    rows = [dict(zip(("row_number", *MANIFEST_COLUMNS), r)) for r in manifest_rows()]
    rows[0].update(change)
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], "row_number long, " + MANIFEST_SCHEMA)
    assert {r["code"] for r in manifest_issues(frame, vocab, "clips").collect()} == codes


def test_missing_manifest_and_wrong_header(spark, tmp_path):
    rows, issues = scan_manifest(spark, str(tmp_path / "none.csv"))
    assert rows is None and issues.first()["code"] == "manifest_missing"
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    assert scan_manifest(spark, str(tmp_path / "bad.csv"))[1].first()["code"] == "columns"
    (tmp_path / "empty.csv").write_text(",".join(MANIFEST_COLUMNS) + "\n")
    assert scan_manifest(spark, str(tmp_path / "empty.csv"))[1].first()["code"] == "empty"


def test_manifest_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([r[1:] for r in manifest_rows()], MANIFEST_SCHEMA)
    assert write_manifest(frame.coalesce(1), str(tmp_path / "m")) == 6
    one = next((tmp_path / "m").glob("part-*.csv"))
    rows, issues = scan_manifest(spark, str(one))
    assert issues.count() == 0
    assert [r["row_number"] for r in rows.orderBy("row_number").collect()] == list(range(2, 8))


GOOD = "hello/crew4a.9999-hello-2023_01_25_18_26_35.014-0.mp4"


@pytest.mark.parametrize("path,want", [
    (GOOD, "crew4a.9999"), (GOOD.replace(".mp4", ".MP4"), None), (GOOD.replace("-hello-", "-please-"), None),
    ("please/" + GOOD.split("/")[1], None), (GOOD.split("/")[1], None), ("hello/" + GOOD, None),
    (GOOD.replace("4a.9999", "4a"), None)])
def test_signer(spark, path, want):
    row = spark.createDataFrame([(path, "hello")], "below string, slug string")
    assert row.select(signer(F.col("below"), F.col("slug"))).first()[0] == want


def test_build_manifest(spark):
    vocab = scan_vocabulary(spark, ("HELLO", "MOM"))
    def clip(category, split, word, n):
        return (f"videos/{category}/{split}/{word}/{word}/c.{n}-{word}-2023_01_01_12_00_00.001-0.mp4",)
    listing = spark.createDataFrame([clip("game", "val", "mom", 1), clip("game", "train", "mom", 2),
                                     clip("non-game", "test", "hello", 3), ("videos/game/train/hello/notes.txt",)], "rel_path string")
    rows = build_manifest(listing, vocab, "clips").collect()
    assert [(r["target_word"], r["split"], r["sample_type"], r["performed_word"], r["expected_pass"]) for r in rows] == [
        ("HELLO", "test", "hard_negative", "", ""), ("MOM", "train", "positive", "MOM", "true"),
        ("MOM", "val", "positive", "MOM", "true")]
    with pytest.raises(ValueError, match="no_clip"):
        build_manifest(listing.where("rel_path like '%mom%'"), vocab, "clips")
    broken = spark.createDataFrame([("videos/game/train/mom/mom/x.mp4",)], "rel_path string")
    assert label_rows(broken, vocab, "clips")[1].count() == 1
    assert vocabulary_issues(scan_vocabulary(spark), 30).count() == 0


def test_keypoint_files(spark, tmp_path):
    header = ",".join(KEYPOINT_COLUMNS)
    (tmp_path / "good.csv").write_text(f"﻿{header}\n4,0,0.1,0.2,0\n2,114,0.1,0.2,0\n", encoding="utf-8")
    (tmp_path / "bad.csv").write_text(f"{header}\n-1,0,0.1,0.2,0\n1,115,1,1,1\n2,0,nan,1,1\n3,0,x,1,1\n4,1,1,1,1\n4,1,2,2,2\n")
    (tmp_path / "empty.csv").write_text(header + "\n")
    points = scan_keypoints(spark, str(tmp_path / "*.csv"))
    bad = keypoint_issues(points).collect()
    assert sorted(r["code"] for r in bad) == [
        "duplicate_point", "invalid_number", "landmark_range", "negative_frame", "not_finite"]
    listing = list_media(spark, str(tmp_path), [".CSV"])
    assert [r["rel_path"] for r in empty_files(listing.select("path", "rel_path"), points).collect()] == ["empty.csv"]
    (tmp_path / "bad.csv").write_text("frame,x,landmark_index,y,z\n1,0,0,0,0\n")
    with pytest.raises(Exception):
        scan_keypoints(spark, str(tmp_path / "bad.csv")).collect()
    assert list_media(spark, str(tmp_path / "nowhere"), ["csv"]).count() == 0


def test_eligible_rows(spark, vocab):
    raw = spark.createDataFrame(calibration_rows(), CAL_SCHEMA)
    assert result_issues(raw, vocab).count() == 0
    rows = eligible(typed_results(raw))
    assert {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()} == {"train": 4, "val": 4, "test": 4}


BROKEN = [({"score": "101"}, "score"), ({"accepted": "TRUE"}, "accepted"), ({"repeat_index": "01"}, "repeat_index"),
          ({"target_word": "MOTHER"}, "target_word"), ({"performed_word": ""}, "unshown_word"), ({"motion_energy": "nan"}, "feature"),
          ({"expected_pass": ""}, "expected_pass"), ({"signer_id": "signer-val"}, "signer_leakage"),
          ({"sample_id": "train-positive-1"}, "duplicate_pair")]


@pytest.mark.parametrize("change,code", BROKEN)
def test_calibration_input_rules(spark, vocab, change, code):
    rows = [dict(zip(("row_number", *CALIBRATION_COLUMNS), r)) for r in calibration_rows()]
    rows[0].update(change)
    raw = spark.createDataFrame([tuple(r.values()) for r in rows], CAL_SCHEMA)
    assert code in {r["code"] for r in result_issues(raw, vocab).collect()}


def test_calibration_run(spark, vocab, tmp_path):
    raw = spark.createDataFrame(calibration_rows(), CAL_SCHEMA)
    rows = read_eligible(raw, vocab)
    metadata, comparison, predictions = calibrate(rows, str(tmp_path / "m"), source="clips", synthetic_smoke=True)
    assert metadata["scaling"]["motion_span"][1] == 1.0  # constant feature
    assert metadata["synthetic_markers"] and metadata["train"]["positives"] == 2
    by = {(r["decider"], r["split"]): r for r in comparison.collect()}
    assert by["calibrated", "test"]["auroc"] == 1.0 and by["calibrated", "test"]["positive_acceptance_rate"] == 1.0
    assert by["calibrated", "test"]["hard_negative_false_acceptance_rate"] == 0.0
    assert by["baseline", "test"]["hard_negative_false_acceptance_rate"] == 1.0  # all rows were marked accepted
    assert predictions.count() == 8
    # Test rows have no say in what was frozen.
    changed = rows.withColumn("target_similarity", F.when(F.col("split") == "test", F.lit(0.1)).otherwise(F.col("target_similarity")))
    again, _, _ = calibrate(changed, str(tmp_path / "n"), source="clips", synthetic_smoke=True)
    assert json.dumps(again, sort_keys=True) == json.dumps(metadata, sort_keys=True)
    _, loaded = load(spark, str(tmp_path / "m"), "clips")
    assert loaded == metadata
    with pytest.raises(ValueError, match="synthetic"):
        calibrate(rows, str(tmp_path / "o"), source="clips", synthetic_smoke=False)


def test_weights_solve_the_summed_loss(spark, vocab):
    """Newton's method on the penalised sum of losses gives the same weights."""
    import numpy as np
    from motionmatch.operators.calibration import fit
    from motionmatch.schemas import FEATURES
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, len(FEATURES)))
    y = (x[:, 0] + 0.5 * rng.normal(size=80) > 0).astype(float)
    frame = spark.createDataFrame([(*map(float, r), bool(t)) for r, t in zip(x, y)],
                                  ", ".join(f"{f} double" for f in FEATURES) + ", expected_pass boolean")
    model, _ = fit(frame)
    z = np.c_[(x - x.mean(0)) / x.std(0), np.ones(80)]
    penalty = np.diag([1.0] * len(FEATURES) + [0.0])
    w = np.zeros(len(FEATURES) + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
    got = [*model.stages[-1].coefficients, model.stages[-1].intercept]
    np.testing.assert_allclose(got, w, atol=1e-5)


def test_fingerprint_ignores_order_scores_and_test_rows(spark):
    rows = eligible(typed_results(spark.createDataFrame(calibration_rows(), CAL_SCHEMA)))
    def digest(df):
        return training_version(df).first()["fingerprint"]
    base = digest(rows)
    assert digest(rows.orderBy(F.col("sample_id").desc()).repartition(5)) == base
    assert digest(rows.withColumn("score", F.lit(1.0))) == base
    assert digest(rows.where("split <> 'test'")) == base
    assert digest(rows.withColumn("motion_span", F.lit(0.31))) != base


def test_contract_clauses():
    assert "schema_version" in artifact_problems({"schema_version": True}, "clips")
    assert "pass_threshold" in artifact_problems({"pass_threshold": float("nan")}, "clips")
