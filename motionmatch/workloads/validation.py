"""Rule engine queries: manifest, keypoint, feature and calibration rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from motionmatch.functions.features import BOUNDS, bad_features, trajectory_ok
from motionmatch.operators.evaluation import split_truth
from motionmatch.operators.keypoint_rules import eligible, keypoint_issues, result_issues, typed_keypoints, typed_results
from motionmatch.operators.manifest import manifest_issues, manifest_order, missing_files
from motionmatch.operators.ordered import OrderedRows
from motionmatch.operators.rules import duplicates, leakage, unmatched
from motionmatch.schemas import FEATURES, LABEL_OF_VARIANT, MANIFEST_COLUMNS, MANIFEST_REQUIRED, SAMPLE_TYPES, VARIANT_STATUSES
from motionmatch.sources.scans import CORRUPT, scan_results, strict_csv
from motionmatch.sources.scratch import scratch_path
from motionmatch.sources.sinks import CSV, write_manifest
from motionmatch.vocabulary import SPLITS, WORDS, scan_vocabulary
from motionmatch.workloads.views import CLIP_FILES, KEYPOINT_FILES, MANIFEST, RAW_POINTS, SOURCE, table

_IN = {name: "(" + ", ".join(f"'{v}'" for v in values) + ")" for name, values in {
    "words": WORDS, "splits": SPLITS, "types": SAMPLE_TYPES, "variants": VARIANT_STATUSES}.items()}
_TRIMMED = ", ".join(f"trim({c}) AS {c}" for c in MANIFEST_COLUMNS)
_MANIFEST_SQL = f"raw AS ({MANIFEST.text}), manifest AS (SELECT row_number, {_TRIMMED} FROM raw)"


def files(spark, folder):
    return CLIP_FILES.select(spark, folder).unionByName(KEYPOINT_FILES.select(spark, folder))


_FILES_SQL = f"files AS ({CLIP_FILES.text} UNION ALL {KEYPOINT_FILES.text})"


def val1(spark, folder):
    """All breaches of orders seen as manifest rows."""
    issues = manifest_issues(MANIFEST.select(spark, folder), scan_vocabulary(spark), SOURCE, files=files(spark, folder))
    return issues.select("code", "row_number", "column")


def _rule(code: str, column: str | None, broken: str) -> str:
    name = f"'{column}'" if column else "CAST(NULL AS VARCHAR)"
    return f"SELECT '{code}' AS code, row_number, {name} AS column FROM manifest WHERE {broken}"


_WANTED = "CASE variant_status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABEL_OF_VARIANT.items()) + " END"
_RULES = [_rule("required", c, f"{c} = ''") for c in MANIFEST_REQUIRED] + [
    _rule("target_word", "target_word", f"target_word <> '' AND target_word NOT IN {_IN['words']}"),
    _rule("source", "source", f"source <> '' AND source <> '{SOURCE}'"),
    _rule("split", "split", f"split <> '' AND split NOT IN {_IN['splits']}"),
    _rule("sample_type", "sample_type", f"sample_type <> '' AND sample_type NOT IN {_IN['types']}"),
    _rule("variant_status", "variant_status", f"variant_status <> '' AND variant_status NOT IN {_IN['variants']}"),
    _rule("expected_pass", "expected_pass", "expected_pass NOT IN ('', 'true', 'false')"),
    _rule("variant_expected_pass", "expected_pass", f"expected_pass <> {_WANTED}"),
    _rule("performed_word_product_key", "performed_word", f"performed_word <> '' AND performed_word NOT IN {_IN['words']}"),
    _rule("unreviewed_performed_word", "performed_word", "variant_status = 'unreviewed' AND performed_word <> ''"),
    _rule("variant_performed_word", "performed_word", "variant_status IN ('target_variant', 'valid_alternate') AND performed_word <> target_word"),
    _rule("positive_variant", "variant_status", "sample_type = 'positive' AND variant_status NOT IN ('target_variant', 'valid_alternate')"),
    "SELECT 'duplicate_sample_id', row_number, 'sample_id' FROM (SELECT *, min(row_number) OVER (PARTITION BY sample_id) AS f FROM manifest "
    "WHERE sample_id <> '') WHERE row_number > f",
    f"SELECT 'signer_leakage', CAST(NULL AS BIGINT), 'signer_id' FROM manifest WHERE signer_id <> '' AND split IN {_IN['splits']} "
    "GROUP BY signer_id HAVING count(DISTINCT split) > 1",
    "SELECT 'video_path', row_number, 'video_path' FROM manifest WHERE video_path <> '' AND video_path NOT IN (SELECT path FROM files)",
    "SELECT 'keypoints_path', row_number, 'keypoints_path' FROM manifest WHERE keypoints_path <> '' AND keypoints_path NOT IN (SELECT path FROM files)",
]
VAL1_SQL = f"WITH {_MANIFEST_SQL}, {_FILES_SQL} " + " UNION ALL ".join(_RULES)


def val2(spark, folder):
    """Later orders of a customer in one year point at the first."""
    rows = table(spark, folder, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_orderkey")
    return duplicates(rows, ["o_custkey", "year"], "o_orderkey")


VAL2_SQL = ("SELECT o_custkey, year, o_orderkey, first_row FROM (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey, "
            "min(o_orderkey) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS first_row FROM orders) WHERE o_orderkey > first_row")


def val3(spark, folder):
    """Parts seen under more than one return flag."""
    lines = table(spark, folder, "lineitem").select(F.col("l_partkey"), "l_returnflag")
    return leakage(lines, "l_partkey", "l_returnflag").select("l_partkey", F.array_join("splits", ",").alias("splits"))


VAL3_SQL = ("SELECT l_partkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS splits FROM lineitem GROUP BY 1 "
            "HAVING count(DISTINCT l_returnflag) > 1")


def val4(spark, folder):
    rows = MANIFEST.select(spark, folder)
    return missing_files(rows, files(spark, folder)).select("code", "row_number", "message")


VAL4_SQL = (f"WITH {_MANIFEST_SQL}, {_FILES_SQL} SELECT code, row_number, concat('file not found: ', p) AS message FROM ("
            "SELECT 'video_path' AS code, row_number, video_path AS p FROM manifest UNION ALL SELECT 'keypoints_path', row_number, keypoints_path FROM manifest) "
            "WHERE p <> '' AND p NOT IN (SELECT path FROM files)")


def val4_references(spark, folder):
    """Lines whose part is not among the smaller parts."""
    known = table(spark, folder, "part").where("p_size <= 40")
    return unmatched(table(spark, folder, "lineitem"), "l_partkey", known, "p_partkey").groupBy("l_partkey").agg(
        F.count("*").alias("lines"))


VAL4_REF_SQL = ("SELECT l_partkey, count(*) AS lines FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) GROUP BY 1")


def val5(spark, folder):
    issues = keypoint_issues(typed_keypoints(RAW_POINTS.select(spark, folder)))
    return issues.select("code", "row_number")


VAL5_SQL = (
    f"WITH raw AS ({RAW_POINTS.text.replace(', 0)', ')')}), typed AS (SELECT row_number, sequence_id, TRY_CAST(frame AS INTEGER) AS frame, "
    "TRY_CAST(landmark_index AS INTEGER) AS landmark, TRY_CAST(x AS DOUBLE) AS x, TRY_CAST(nullif(y, '') AS DOUBLE) AS y, TRY_CAST(z AS DOUBLE) AS z FROM raw), "
    "ok AS (SELECT *, frame IS NOT NULL AND landmark IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AS parsed FROM typed) "
    "SELECT 'invalid_number' AS code, row_number FROM ok WHERE NOT parsed "
    "UNION ALL SELECT 'negative_frame', row_number FROM ok WHERE frame < 0 "
    "UNION ALL SELECT 'landmark_range', row_number FROM ok WHERE landmark NOT BETWEEN 0 AND 114 "
    "UNION ALL SELECT 'not_finite', row_number FROM ok WHERE parsed AND NOT (isfinite(x) AND isfinite(y) AND isfinite(z)) "
    "UNION ALL SELECT 'duplicate_point', row_number FROM (SELECT *, min(row_number) OVER (PARTITION BY sequence_id, frame, landmark) AS f "
    "FROM ok WHERE parsed) WHERE row_number > f")

# Lines as feature rows; most features stay within bounds.
_FEATURE_SQL = {
    "target_similarity": "l_quantity / 49", "best_other_similarity": "l_discount * 10.5",
    "similarity_margin": "l_tax * 26", "hand_visibility": "l_quantity / 50.5", "motion_energy": "l_discount - 0.005",
    "motion_span": "CASE WHEN l_linenumber = 3 THEN CAST('NaN' AS DOUBLE) ELSE 0.5 END",
    "sequence_completeness": "CASE WHEN l_linenumber = 5 THEN NULL ELSE 1.0 END",
    "start_position_difference": "CASE WHEN l_suppkey % 20 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE 0.1 END",
    "end_position_difference": "l_extendedprice / 1000 - 1",
}


def val6(spark, folder):
    """Counts of lines by the features they break."""
    rows = table(spark, folder, "lineitem")
    bad = bad_features({c: F.expr(_FEATURE_SQL[c]) for c in FEATURES})
    distance = F.expr("CASE WHEN l_linenumber = 2 THEN NULL ELSE l_tax - 0.01 END")
    return rows.select(F.array_join(bad, ",").alias("bad"), trajectory_ok(distance).alias("trajectory_ok")).groupBy(
        "bad", "trajectory_ok").agg(F.count("*").alias("n"))


def _outside(name: str, low: float, high: float | None) -> str:
    v = f"({_FEATURE_SQL[name]})"
    top = f" OR {v} > {high}" if high is not None else ""
    return f"CASE WHEN {v} IS NULL OR NOT isfinite({v}) OR {v} < {low}{top} THEN '{name}' END"


VAL6_SQL = ("SELECT concat_ws(',', " + ", ".join(_outside(b.name, b.minimum, b.maximum) for b in BOUNDS)
            + ") AS bad, l_linenumber = 2 OR l_tax - 0.01 >= 0 AS trajectory_ok, count(*) AS n FROM lineitem GROUP BY 1, 2")

# Manifest rows completed to calibration input text.
_EXTRA = {
    "repeat_index": "CASE WHEN row_number % 59 = 0 THEN '01' WHEN row_number % 10 = 0 THEN '1' ELSE '0' END",
    "quality_valid": "CASE WHEN row_number % 61 = 0 THEN 'TRUE' WHEN row_number % 13 = 0 THEN 'false' ELSE 'true' END",
    "accepted": "CASE WHEN row_number % 67 = 0 THEN '' WHEN row_number % 2 = 0 THEN 'true' ELSE 'false' END",
    "score": "CASE WHEN row_number % 71 = 0 THEN '101' WHEN row_number % 73 = 0 THEN 'abc' ELSE CAST(row_number % 101 AS STRING) END",
    **{f: "CASE WHEN row_number % 13 = 0 THEN '' ELSE '0.5' END" for f in FEATURES},
}
_EXTRA["motion_span"] = "CASE WHEN row_number % 79 = 0 THEN '-1' ELSE '0.5' END"


def calibration_text(spark, folder):
    rows = MANIFEST.select(spark, folder)
    return rows.select("*", *[F.expr(e).alias(c) for c, e in _EXTRA.items()])


_INPUT_SQL = f"manifest0 AS ({MANIFEST.text}), manifest AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in _EXTRA.items()) + " FROM manifest0)"


def val7(spark, folder):
    return result_issues(calibration_text(spark, folder), scan_vocabulary(spark)).select("code", "row_number")


def _r7(code: str, broken: str) -> str:
    return f"SELECT '{code}' AS code, row_number FROM manifest WHERE {broken}"


_REVIEWED = "quality_valid = 'true' AND sample_type IN ('positive', 'hard_negative', 'random_negative') AND variant_status <> 'unreviewed' AND expected_pass IN ('true', 'false')"
VAL7_SQL = f"WITH {_INPUT_SQL} " + " UNION ALL ".join([
    *[_r7("empty", f"trim({c}) = ''") for c in ("sample_id", "signer_id", "source", "source_sample_id")],
    _r7("split", f"split NOT IN {_IN['splits']}"), _r7("target_word", f"target_word NOT IN {_IN['words']}"),
    _r7("performed_word", f"trim(performed_word) <> '' AND performed_word NOT IN {_IN['words']}"),
    _r7("sample_type", f"sample_type NOT IN {_IN['types']}"), _r7("variant_status", f"variant_status NOT IN {_IN['variants']}"),
    _r7("repeat_index", "repeat_index = '01'"), _r7("quality_valid", "quality_valid = 'TRUE'"), _r7("accepted", "accepted = ''"),
    _r7("score", "score IN ('101', 'abc')"),
    _r7("expected_pass", "expected_pass NOT IN ('true', 'false') AND NOT (expected_pass = '' AND variant_status = 'unreviewed')"),
    _r7("unshown_word", f"{_REVIEWED} AND trim(performed_word) = ''"),
    _r7("feature", "quality_valid = 'true' AND motion_span = '-1'"),
    "SELECT 'duplicate_pair', row_number FROM (SELECT *, min(row_number) OVER (PARTITION BY sample_id, CAST(repeat_index AS BIGINT)) AS f FROM manifest) WHERE row_number > f",
    f"SELECT 'signer_leakage', CAST(NULL AS BIGINT) FROM manifest WHERE trim(signer_id) <> '' AND split IN {_IN['splits']} GROUP BY signer_id HAVING count(DISTINCT split) > 1",
])


def flt3(spark, folder):
    _, counts = split_truth(MANIFEST.select(spark, folder))
    return counts


FLT3_SQL = (f"WITH m AS ({MANIFEST.text}), e AS (SELECT *, variant_status <> 'unreviewed' AND trim(expected_pass) <> '' AS ok FROM m) "
            "SELECT count(*) AS manifest_row_count, count(*) FILTER (NOT ok) AS excluded_count, "
            "count(*) FILTER (NOT ok AND variant_status = 'unreviewed') AS unreviewed_count FROM e")


def flt5(spark, folder):
    rows = eligible(typed_results(calibration_text(spark, folder)))
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.count_if("expected_pass").alias("positives"))


FLT5_SQL = (f"WITH {_INPUT_SQL} SELECT split, count(*) AS rows, count(*) FILTER (expected_pass = 'true') AS positives FROM manifest "
            f"WHERE {_REVIEWED} AND CAST(repeat_index AS BIGINT) = 0 GROUP BY 1")


def srt1(spark, folder):
    """Place of each row in manifest order; unknown splits sort first."""
    word, split, sample = manifest_order()
    rows = MANIFEST.select(spark, folder).select(
        "row_number", word.alias("target_word"), split.alias("split_ord"), sample.alias("sample_id"))
    return OrderedRows(rows, [], ["target_word", "split_ord", "sample_id", "row_number"]).index("place").done().select(
        "row_number", "place")


SRT1_SQL = (f"WITH m AS ({MANIFEST.text}) SELECT row_number, row_number() OVER (ORDER BY target_word, CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 "
            "WHEN 'test' THEN 3 ELSE 0 END, sample_id, m.row_number) - 1 AS place FROM m")


def sink1(spark, folder):
    """Manifest written in order and scanned back strictly (SRC-2)."""
    path = scratch_path(spark, "manifest")
    write_manifest(MANIFEST.select(spark, folder), path)
    read = strict_csv(spark, path, MANIFEST_COLUMNS)
    sound = F.when(F.col(CORRUPT).isNull(), True).otherwise(F.raise_error(F.lit("a written row came back damaged")).cast("boolean"))
    return read.where(sound).select(*[F.coalesce(c, F.lit("")).alias(c) for c in MANIFEST_COLUMNS])


SINK1_SQL = f"WITH m AS ({MANIFEST.text}) SELECT {', '.join(MANIFEST_COLUMNS)} FROM m"


def src3(spark, folder):
    """Calibration input with extra columns, written as CSV and scanned by name."""
    path = scratch_path(spark, "results")
    rows = calibration_text(spark, folder).drop("row_number")
    rows.write.options(**CSV).csv(path)
    return scan_results(spark, path).select("sample_id", "split", "repeat_index", "score", "motion_span")


SRC3_SQL = f"WITH {_INPUT_SQL} SELECT sample_id, split, repeat_index, score, motion_span FROM manifest"


def win5(spark, folder):
    """Orders of each status at or above every price, by descending running counts."""
    prices = table(spark, folder, "orders").groupBy("o_orderstatus", "o_totalprice").agg(F.count("*").alias("n"))
    return OrderedRows(prices, ["o_orderstatus"], ["o_totalprice"], descending=True).running(above=F.col("n")).done().select(
        "o_orderstatus", "o_totalprice", "above")


WIN5_SQL = ("SELECT o_orderstatus, o_totalprice, CAST(sum(n) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS BIGINT) AS above FROM "
            "(SELECT o_orderstatus, o_totalprice, count(*) AS n FROM orders GROUP BY 1, 2)")


def set2(spark, folder):
    """Issue counts by code over both issue streams."""
    both = val1(spark, folder).select("code").unionByName(val5(spark, folder).select("code"))
    return both.groupBy("code").agg(F.count("*").alias("n"))


SET2_SQL = f"SELECT code, count(*) AS n FROM (SELECT code FROM ({VAL1_SQL}) UNION ALL SELECT code FROM ({VAL5_SQL})) GROUP BY 1"

QUERIES = {
    "val1_manifest": (val1, VAL1_SQL),
    "val2_duplicates": (val2, VAL2_SQL),
    "val3_leakage": (val3, VAL3_SQL),
    "val4_files": (val4, VAL4_SQL),
    "val4_references": (val4_references, VAL4_REF_SQL),
    "val5_keypoints": (val5, VAL5_SQL),
    "val6_feature_bounds": (val6, VAL6_SQL),
    "val7_calibration_rows": (val7, VAL7_SQL),
    "flt3_truth_filter": (flt3, FLT3_SQL),
    "flt5_eligible": (flt5, FLT5_SQL),
    "srt1_manifest_order": (srt1, SRT1_SQL),
    "sink1_src2_manifest": (sink1, SINK1_SQL),
    "src3_scan_results": (src3, SRC3_SQL),
    "win5_running_counts": (win5, WIN5_SQL),
    "set2_issue_union": (set2, SET2_SQL),
    "win2_first_occurrence": (val2, VAL2_SQL),
}
