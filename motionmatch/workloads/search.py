"""Vector search and scoring over ``embeddings``; the label is the word."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionmatch.functions.scoring import (
    decision, diagnostics, is_accepted, is_ambiguous, manual_score, quality_reasons,
    scaled_unit,
)
from motionmatch.operators.library import (
    coverage_difference, export_differences, filter_words, library_issues, missing_words,
    word_counts,
)
from motionmatch.operators.search import match_by_key, search
from motionmatch.sources.scans import LIBRARY_SCHEMA, scan_library
from motionmatch.sources.scratch import scratch_path
from motionmatch.workloads.views import r6, rounded, table

# Similarities here are low; they are lifted so that every branch occurs.
LIFT = 0.55


def library(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("ref_id"), F.concat(F.lit("w"), F.col("label").cast("string")).alias("word"),
        "embedding")


def leave_one_out(spark: SparkSession, folder: str, target: str = "label") -> DataFrame:
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.concat(F.lit("w"), F.expr(target).cast("string")).alias("target"), "embedding")
    return search(rows, library(spark, folder), skip_same_id=True)


def sims_sql(target: str = "label") -> str:
    return (
        "sims AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, concat('w', r.label) AS word, "
        "r.label = q.t AS mine, greatest(-1.0, least(1.0, list_cosine_similarity("
        "CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])))) AS s "
        f"FROM (SELECT *, {target} AS t FROM embeddings) q JOIN embeddings r ON q.vec_id <> r.vec_id), "
        "best AS (SELECT query_id, max(s) FILTER (mine) AS target_similarity, "
        "max(s) FILTER (NOT mine) AS best_other_similarity, "
        "arg_max(word, s) FILTER (NOT mine) AS best_other_word, "
        "arg_max(ref_id, s) FILTER (NOT mine) AS best_other_id FROM sims GROUP BY 1)")


def unit_sql(v: str, lo: float, hi: float) -> str:
    return f"least(greatest((({v}) - {lo!r}) / {hi - lo!r}, 0.0), 1.0)"


def score_sql(t: str, m: str) -> str:
    """Clause by clause as specified for the manual score."""
    base = f"round_even(100 * (0.68 * {unit_sql(t, .68, .90)} + 0.32 * {unit_sql(m, -.02, .06)}), 0)"
    near = f"round_even(62 + 12 * {unit_sql(t, .78, .96)} + 5 * {unit_sql(m, -.04, .01)}, 0)"
    weak = f"(CASE WHEN {t} < 0.78 THEN least({base}, 74) ELSE {base} END)"
    return (f"CAST(CASE WHEN {t} >= 0.94 AND {m} >= -0.015 THEN greatest({weak}, 82) "
            f"WHEN {m} < 0.01 THEN least({weak}, {near}) ELSE {weak} END AS INTEGER)")


def lifted(found: DataFrame) -> DataFrame:
    return found.withColumn("t", F.least(F.col("target_similarity") + LIFT, F.lit(1.0))).withColumn(
        "m", F.col("similarity_margin"))


LIFTED_SQL = (f"lifted AS (SELECT *, least(target_similarity + {LIFT}, 1.0) AS t, "
              "target_similarity - best_other_similarity AS m FROM best)")


def jn3(spark, folder):
    return leave_one_out(spark, folder).select(
        "query_id", rounded("target_similarity"), rounded("best_other_similarity"),
        "best_other_id", "best_other_word", rounded("similarity_margin"))


JN3_SQL = (f"WITH {sims_sql()} SELECT query_id, {r6('target_similarity')} AS target_similarity, "
           f"{r6('best_other_similarity')} AS best_other_similarity, best_other_id, best_other_word, "
           f"{r6('target_similarity - best_other_similarity')} AS similarity_margin FROM best")


def judged(found):
    """Scored search results; all their columns stay."""
    rows = lifted(found).withColumn("score", manual_score(F.col("t"), F.col("m")))
    return rows.withColumns({
        "accepted": is_accepted(F.col("score")),
        "decision": F.when(is_accepted(F.col("score")), F.lit("pass")).otherwise(F.lit("retry")),
        "ambiguous": is_ambiguous(F.col("t"), F.col("m"))})


def fn9(spark, folder):
    return judged(leave_one_out(spark, folder)).select("query_id", "score", "accepted", "decision", "ambiguous")


def searched_and_judged(spark, folder):
    """One search: what it found and how that scores."""
    return judged(leave_one_out(spark, folder)).select(
        "query_id", rounded("target_similarity"), rounded("best_other_similarity"), "best_other_id", "best_other_word",
        rounded("similarity_margin"), "score", "accepted", "decision", "ambiguous")


FN9_SQL = (f"WITH {sims_sql()}, {LIFTED_SQL}, scored AS (SELECT *, {score_sql('t', 'm')} AS score "
           "FROM lifted) SELECT query_id, score, score >= 80 AS accepted, CASE WHEN score >= 80 "
           "THEN 'pass' ELSE 'retry' END AS decision, t >= 0.94 AND m >= -0.015 AS ambiguous FROM scored")


def fn8(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", F.round(scaled_unit(F.col("p_retailprice"), 950.0, 1500.0), 6).alias("unit"))


FN8_SQL = f"SELECT p_partkey, round({unit_sql('p_retailprice', 950.0, 1500.0)}, 6) AS unit FROM part"


def fn10(spark, folder):
    """History view: null score when gated. Evaluation view: 0."""
    rows = lifted(leave_one_out(spark, folder))
    valid = F.col("query_id") % 17 != 0
    score = F.when(valid, manual_score(F.col("t"), F.col("m")))
    return rows.withColumn("score", score).select(
        "query_id", "score", F.coalesce("score", F.lit(0)).alias("score_eval"),
        decision(valid, F.col("score")).alias("decision"))


FN10_SQL = (f"WITH {sims_sql()}, {LIFTED_SQL}, scored AS (SELECT *, CASE WHEN query_id % 17 <> 0 THEN "
            f"{score_sql('t', 'm')} END AS score FROM lifted) SELECT query_id, score, "
            "coalesce(score, 0) AS score_eval, CASE WHEN query_id % 17 = 0 THEN 'rerecord' "
            "WHEN score >= 80 THEN 'pass' ELSE 'retry' END AS decision FROM scored")

# Events as measured attempts: value and k give measurements around the thresholds.
_MEASURES = {"visibility": "least(value / 100, 1.0)", "energy": "value / 5000",
             "span": "value / 1000", "completeness": "least(k / 40, 1.0)"}


def measured(spark, folder):
    k = F.regexp_extract("props", "[0-9]+", 0).cast("double")
    rows = table(spark, folder, "events").withColumn("k", k)
    return rows.select("event_id", *[F.expr(e).alias(c) for c, e in _MEASURES.items()])


MEASURED_SQL = ("measured AS (SELECT event_id, " + ", ".join(
    f"{e} AS {c}" for c, e in _MEASURES.items()) + " FROM (SELECT *, "
    "CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k FROM events))")


def flt6(spark, folder):
    c = F.col
    reasons = quality_reasons(c("visibility"), c("energy"), c("span"), c("completeness"))
    return measured(spark, folder).select(
        "event_id", F.array_join(reasons, "|").alias("quality_reasons"),
        (F.size(reasons) == 0).alias("quality_valid"))


_REASONS = ("concat_ws('|', CASE WHEN visibility < 0.18 THEN 'insufficient_hand_visibility' END, "
            "CASE WHEN completeness < 0.1875 THEN 'incomplete_sequence' END, "
            "CASE WHEN energy < 0.014 AND span < 0.075 THEN 'insufficient_motion' END)")
FLT6_SQL = (f"WITH {MEASURED_SQL} SELECT event_id, {_REASONS} AS quality_reasons, "
            f"{_REASONS} = '' AS quality_valid FROM measured")


def fn11(spark, folder):
    """Diagnostics of gated, weak and confused attempts, one row per finding."""
    c = F.col
    rows = lifted(leave_one_out(spark, folder)).withColumn(
        "score", manual_score(c("t"), c("m")))
    visibility = F.when(c("query_id") % 17 == 0, 0.09).otherwise(0.9)
    completeness = F.when(c("query_id") % 34 == 0, 0.125).otherwise(1.0)
    energy = F.when(c("query_id") % 51 == 0, 0.007).otherwise(0.05)
    span = F.when(c("query_id") % 51 == 0, 0.03).otherwise(0.5)
    found = diagnostics(visibility, energy, span, completeness, c("t"),
                        c("best_other_similarity") + LIFT, c("score"))
    return rows.select("query_id", F.posexplode(found).alias("position", "d")).select(
        "query_id", "position", F.col("d.code").alias("code"),
        F.round("d.severity", 6).alias("severity"))


FN11_SQL = (
    f"WITH {sims_sql()}, {LIFTED_SQL}, scored AS (SELECT *, {score_sql('t', 'm')} AS score, "
    f"best_other_similarity + {LIFT} AS o FROM lifted), cand AS ("
    "SELECT query_id, 1 AS ord, 'HANDS_NOT_VISIBLE' AS code, 0.91 AS severity FROM scored WHERE query_id % 17 = 0 "
    "UNION ALL SELECT query_id, 2, 'TOO_FEW_FRAMES', 1 - 0.125 / 0.1875 FROM scored WHERE query_id % 34 = 0 "
    "UNION ALL SELECT query_id, 3, 'MOTION_NOT_DETECTED', 1 - greatest(0.007 / 0.014, 0.03 / 0.075) "
    "FROM scored WHERE query_id % 51 = 0 "
    "UNION ALL SELECT query_id, 4, 'LOW_MATCH', 1 - score / 100 FROM scored WHERE query_id % 17 <> 0 AND score < 80 "
    "UNION ALL SELECT query_id, 5, 'NEAREST_CONFUSION', least(1, (o - t) / 2) FROM scored "
    "WHERE query_id % 17 <> 0 AND score < 80 AND o > t), ranked AS (SELECT *, "
    "row_number() OVER (PARTITION BY query_id ORDER BY ord) - 1 AS position FROM cand) "
    "SELECT query_id, CAST(position AS INTEGER) AS position, code, round(severity, 6) AS severity "
    "FROM ranked WHERE position < 2")


def top3(spark, folder):
    """How often each finding is among an attempt's first two."""
    return fn11(spark, folder).groupBy("code").agg(F.count("*").alias("n"))


TOP3_SQL = f"SELECT code, count(*) AS n FROM ({FN11_SQL}) GROUP BY 1"


def top2(spark, folder):
    return leave_one_out(spark, folder, "(label + 1) % 10").select(
        "query_id", rounded("target_similarity"), rounded("best_other_similarity"), "best_other_word")


TOP2_SQL = (f"WITH {sims_sql('(label + 1) % 10')} SELECT query_id, {r6('target_similarity')} AS target_similarity, "
            f"{r6('best_other_similarity')} AS best_other_similarity, best_other_word FROM best")


def jn2(spark, folder):
    """Product names asked by the words of a library filed under name and type."""
    parts = table(spark, folder, "part")
    refs = parts.select(F.col("p_partkey").alias("ref_id"), F.col("p_name").alias("word"),
                        F.col("p_type").alias("slug"))
    asked = parts.select(F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("word_asked")).unionByName(
        parts.select(F.lower("p_type").alias("word_asked"))).distinct()
    return match_by_key(asked, refs).groupBy("word_asked").agg(
        F.count("*").alias("entries"), F.min("ref_id").alias("first_ref"))


JN2_SQL = (
    "WITH keys AS (SELECT DISTINCT k, p_partkey FROM (SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS k, "
    "p_partkey FROM part UNION ALL SELECT regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g'), p_partkey FROM part)), "
    "asked AS (SELECT DISTINCT w FROM (SELECT upper(replace(p_name, ' ', '-')) AS w FROM part UNION ALL "
    "SELECT lower(p_type) FROM part)) SELECT w AS word_asked, count(*) AS entries, min(p_partkey) AS first_ref "
    "FROM asked JOIN keys ON k = regexp_replace(lower(w), '[^a-z0-9]', '', 'g') GROUP BY 1")


def allowed(spark, folder):
    """Words w0..w8 of the labels, asked in upper case, and one the library lacks."""
    labels = table(spark, folder, "embeddings").where("label < 9").select(
        F.concat(F.lit("W-"), F.col("label").cast("string")).alias("lookup_word"))
    return labels.unionByName(table(spark, folder, "region").select(
        F.lower("r_name").alias("lookup_word"))).distinct()


def flt2(spark, folder):
    return filter_words(library(spark, folder), allowed(spark, folder), order="ref_id").select(
        F.col("ref_id"), "source_ref_id", "word", F.size("embedding").alias("dimension"))


FLT2_SQL = ("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS ref_id, vec_id AS source_ref_id, "
            "concat('w', label) AS word, CAST(len(embedding) AS INTEGER) AS dimension FROM embeddings WHERE label < 9")


def set1(spark, folder):
    return missing_words(library(spark, folder), allowed(spark, folder)).select("lookup_word").unionByName(
        coverage_difference(library(spark, folder), allowed(spark, folder)).select(
            F.concat_ws(":", "side", "match_key").alias("lookup_word")))


SET1_SQL = ("SELECT lower(r_name) AS lookup_word FROM region UNION ALL SELECT concat('missing:', replace(lower(r_name), ' ', '')) "
            "FROM region UNION ALL SELECT DISTINCT concat('unexpected:w', label) FROM embeddings WHERE label = 9")


def agg12(spark, folder):
    return word_counts(library(spark, folder))


AGG12_SQL = "SELECT concat('w', label) AS match_key, count(*) AS entries FROM embeddings GROUP BY 1"


def val8(spark, folder):
    """A library with every hundredth id repeated, the first id missing, one NaN and zero rows."""
    rows = library(spark, folder).where("ref_id > 0")
    nan, zero = F.col("ref_id") % 90 == 7, F.col("ref_id") % 90 == 11
    vector = (F.when(nan, F.transform("embedding", lambda v: F.lit(float("nan")).cast("float")))
              .when(zero, F.transform("embedding", lambda v: F.lit(0.0).cast("float")))
              .when(F.col("ref_id") % 90 == 13, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    rows = rows.withColumn("embedding", vector).withColumn(
        "ref_id", F.when(F.col("ref_id") % 100 == 99, F.col("ref_id") - 1).otherwise(F.col("ref_id")))
    return library_issues(rows, 64)


VAL8_SQL = (
    "WITH lib AS (SELECT vec_id, CASE WHEN vec_id % 100 = 99 THEN vec_id - 1 ELSE vec_id END AS ref_id "
    "FROM embeddings WHERE vec_id > 0) "
    "SELECT 'not_finite' AS code, CAST(ref_id AS VARCHAR) AS subject FROM lib WHERE vec_id % 90 = 7 "
    "UNION ALL SELECT 'zero_vector', CAST(ref_id AS VARCHAR) FROM lib WHERE vec_id % 90 = 11 "
    "UNION ALL SELECT 'dimension', CAST(ref_id AS VARCHAR) FROM lib WHERE vec_id % 90 = 13 "
    "UNION ALL SELECT 'duplicate_id', CAST(ref_id AS VARCHAR) FROM lib GROUP BY ref_id HAVING count(*) > 1 "
    "UNION ALL SELECT 'not_contiguous', concat(min(ref_id), '..', max(ref_id)) FROM lib "
    "HAVING min(ref_id) <> 0 OR max(ref_id) <> count(*) - 1")


def jn9(spark, folder):
    """Searches that change when every tenth vector is left out of the library."""
    before = library(spark, folder)
    queries = before.select(F.col("ref_id").alias("query_id"), "embedding")
    changed = export_differences(queries, ["w0", "w1"], before, before.where("ref_id % 10 <> 0"))
    return changed.select(
        F.get_json_object("query_id", "$.query_id").cast("long").alias("query_id"),
        F.get_json_object("query_id", "$.target").alias("target"),
        rounded_field("before.target_similarity", "target_before"),
        rounded_field("after.target_similarity", "target_after"),
        F.col("before.best_other_word").alias("other_before"),
        F.col("after.best_other_word").alias("other_after"))


def rounded_field(field: str, name: str):
    return (F.round(field, 6) + F.lit(0.0)).alias(name)


def _jn9_side(name: str, where: str) -> str:
    return (f"{name} AS (SELECT query_id, target, max(s) FILTER (word = target) AS t, "
            "max(s) FILTER (word <> target) AS o, arg_max(word, s) FILTER (word <> target) AS w "
            f"FROM allsims CROSS JOIN (VALUES ('w0'), ('w1')) v(target) WHERE {where} GROUP BY 1, 2)")


JN9_SQL = (
    "WITH allsims AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, concat('w', r.label) AS word, "
    "greatest(-1.0, least(1.0, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), "
    "CAST(r.embedding AS DOUBLE[])))) AS s FROM embeddings q CROSS JOIN embeddings r), "
    f"{_jn9_side('b', 'true')}, {_jn9_side('a', 'ref_id % 10 <> 0')} "
    f"SELECT query_id, target, {r6('b.t')} AS target_before, {r6('a.t')} AS target_after, b.w AS other_before, "
    "a.w AS other_after FROM b JOIN a USING (query_id, target) "
    "WHERE coalesce(abs(b.t - a.t) > 1e-9, (b.t IS NULL) <> (a.t IS NULL)) "
    "OR coalesce(abs(b.o - a.o) > 1e-9, (b.o IS NULL) <> (a.o IS NULL))")


def src5(spark, folder):
    """Library written with the full schema, scanned back with a pushed filter."""
    path = scratch_path(spark, "library")
    rows = library(spark, folder).withColumn("slug", F.lower("word")).withColumn(
        "path", F.concat(F.lit("lib/"), "word", F.lit("/"), F.col("ref_id").cast("string")))
    empty = [F.lit(None).cast("string").alias(c) for c in ("lecture", "topic", "sentence")]
    rows.select("*", *empty).select(
        *[c.strip().split(" ")[0] for c in LIBRARY_SCHEMA.split(",")]).write.parquet(path)
    return scan_library(spark, path).where("word = 'w3'").select(
        "ref_id", "path", F.size("embedding").alias("dimension"))


SRC5_SQL = ("SELECT vec_id AS ref_id, concat('lib/w', label, '/', vec_id) AS path, "
            "CAST(len(embedding) AS INTEGER) AS dimension FROM embeddings WHERE label = 3")

QUERIES = {
    "jn3_target_search": (jn3, JN3_SQL),
    "fn9_manual_score": (fn9, FN9_SQL),
    "fn8_scaled_unit": (fn8, FN8_SQL),
    "fn10_decision": (fn10, FN10_SQL),
    "fn11_diagnostics": (fn11, FN11_SQL),
    "top2_best_per_side": (top2, TOP2_SQL),
    "top3_first_findings": (top3, TOP3_SQL),
    "flt6_quality_gate": (flt6, FLT6_SQL),
    "jn2_normalised_key": (jn2, JN2_SQL),
    "flt2_allowed_words": (flt2, FLT2_SQL),
    "set1_coverage": (set1, SET1_SQL),
    "agg12_word_counts": (agg12, AGG12_SQL),
    "val8_library": (val8, VAL8_SQL),
    "jn9_export_differences": (jn9, JN9_SQL),
    "src5_scan_library": (src5, SRC5_SQL),
}
