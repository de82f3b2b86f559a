"""Evaluation reports over searched ``embeddings``, and over larger tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionmatch.functions.scoring import manual_score, safe_rate
from motionmatch.operators.calibration import (
    compare, metrics, select_threshold, split_counts, standardisation,
)
from motionmatch.operators.evaluation import (
    auroc, confusions, group_summary, latency_report, names, per_word, primary, semantic_auroc,
    split_truth, stability, zero_fill,
)
from motionmatch.operators.ordered import OrderedRows
from motionmatch.operators.sequence import repeat_samples
from motionmatch.plans.evaluate import summary, write_summary
from motionmatch.plans.match import to_product_word
from motionmatch.schemas import SAMPLE_TYPES
from motionmatch.sources.sinks import write_small
from motionmatch.sources.scratch import scratch_path, settled
from motionmatch.workloads.search import LIFT, leave_one_out, score_sql, sims_sql
from motionmatch.workloads.views import r6, rounded, table

# Every third vector is asked for its own label, the others for the next one.
_TARGET = "CASE WHEN vec_id % 3 = 0 THEN label ELSE (label + 1) % 10 END"
_TYPE = ("CASE WHEN sample_id % 17 = 0 THEN 'invalid' WHEN sample_id % 3 = 0 THEN 'positive' "
         "WHEN sample_id % 3 = 1 THEN 'hard_negative' ELSE 'random_negative' END")
_SPLIT = "CASE WHEN sample_id % 5 < 3 THEN 'train' WHEN sample_id % 5 = 3 THEN 'val' ELSE 'test' END"
WORD_COUNT = 12  # two words more than there are labels


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Judged searches. Reports read them several times over; the search runs once."""
    found = settled(leave_one_out(spark, folder, _TARGET), "found").withColumnRenamed("query_id", "sample_id")
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("sample_id"), F.concat(
        F.lit("w"), F.expr(_TARGET).cast("string")).alias("target_word"))
    t = F.least(F.col("target_similarity") + LIFT, F.lit(1.0))
    valid = F.col("sample_id") % 17 != 0
    rows = found.join(labels, "sample_id").withColumns({
        "sample_type": F.expr(_TYPE), "split": F.expr(_SPLIT), "quality_valid": valid,
        "expected_pass": F.col("sample_id") % 3 == 0,
        "score": F.when(valid, manual_score(t, F.col("similarity_margin")))})
    return rows.withColumns({
        "score_eval": F.coalesce("score", F.lit(0)),
        "accepted": F.coalesce(F.col("score") >= 80, F.lit(False)),
        "nearest_confusion": F.when(valid, F.col("best_other_word")),
        "match_probability": F.round((F.col("target_similarity") + 1) / 2, 6),
        "repeat_index": F.lit(0)})


RESULTS_SQL = (
    f"{sims_sql(_TARGET)}, labelled AS (SELECT query_id AS sample_id, concat('w', {_TARGET}) AS target_word, "
    f"best.*, least(target_similarity + {LIFT}, 1.0) AS t, target_similarity - best_other_similarity AS m "
    "FROM best JOIN embeddings ON vec_id = query_id), results AS (SELECT *, coalesce(score >= 80, false) AS accepted, "
    "coalesce(score, 0) AS score_eval, CASE WHEN quality_valid THEN best_other_word END AS nearest_confusion FROM ("
    f"SELECT *, {_TYPE} AS sample_type, {_SPLIT} AS split, sample_id % 17 <> 0 AS quality_valid, "
    "sample_id % 3 = 0 AS expected_pass, round((target_similarity + 1) / 2, 6) AS match_probability, "
    f"CASE WHEN sample_id % 17 <> 0 THEN {score_sql('t', 'm')} END AS score FROM labelled))")


def words(spark) -> DataFrame:
    return names(spark, "target_word", [f"w{i}" for i in range(WORD_COUNT)])


_WORDS_SQL = f"words AS (SELECT CAST(i AS INTEGER) AS ordinal, concat('w', i) AS word FROM range({WORD_COUNT}) r(i))"


def rate_sql(n: str, d: str) -> str:
    return f"round_even(({n}) / nullif(CAST({d} AS DOUBLE), 0), 6)"


def agg1(spark, folder):
    return group_summary(primary(results(spark, folder)))


_GROUPS = ", ".join(f"({i}, '{g}')" for i, g in enumerate(SAMPLE_TYPES))
AGG1_SQL = (
    f"WITH {RESULTS_SQL} SELECT g.ordinal, g.sample_type, CASE WHEN n > 0 THEN 'available' ELSE 'not_available' END "
    f"AS status, n AS sample_count, a AS accepted_count, n - a AS rejected_count, {rate_sql('a', 'n')} AS acceptance_rate, "
    f"{rate_sql('n - a', 'n')} AS rejection_rate FROM (SELECT g.ordinal, g.sample_type, count(r.sample_id) AS n, "
    f"count(r.sample_id) FILTER (r.accepted) AS a FROM (VALUES {_GROUPS}) g(ordinal, sample_type) LEFT JOIN results r "
    "ON r.sample_type = g.sample_type GROUP BY 1, 2) g")


def agg2(spark, folder):
    return per_word(primary(results(spark, folder)), words(spark))


_NEG = "sample_type IN ('hard_negative', 'random_negative')"
AGG2_SQL = (
    f"WITH {RESULTS_SQL}, {_WORDS_SQL}, c AS (SELECT ordinal, word, "
    "count(sample_id) FILTER (sample_type = 'positive') AS p, count(sample_id) FILTER (sample_type = 'positive' AND accepted) AS pa, "
    f"count(sample_id) FILTER ({_NEG}) AS n, count(sample_id) FILTER ({_NEG} AND accepted) AS na, "
    "count(sample_id) FILTER (sample_type = 'invalid') AS i, count(sample_id) FILTER (sample_type = 'invalid' AND NOT accepted) AS ir "
    "FROM words LEFT JOIN results ON target_word = word GROUP BY 1, 2) SELECT ordinal, word, p AS positive_count, "
    f"{rate_sql('pa', 'p')} AS positive_acceptance_rate, n AS negative_count, {rate_sql('na', 'n')} AS false_acceptance_rate, "
    f"i AS invalid_count, {rate_sql('ir', 'i')} AS invalid_rejection_rate FROM c")


def agg3(spark, folder):
    known = words(spark).where("target_word <> 'w4'")
    return confusions(primary(results(spark, folder)), known)


AGG3_SQL = (f"WITH {RESULTS_SQL} SELECT target_word, nearest_confusion AS confused_with, count(*) AS count FROM results "
            "WHERE quality_valid AND NOT accepted AND nearest_confusion <> target_word AND nearest_confusion <> 'w4' GROUP BY 1, 2")


def agg4(spark, folder):
    """Events as repeats of a user's sample."""
    return stability(table(spark, folder, "events"), "user_id", "value")


AGG4_SQL = ("SELECT count(*) AS sample_count, max(n) AS repeat_count, round(avg(sd), 6) AS mean_score_stddev, "
            "round(max(sd), 6) AS max_score_stddev FROM (SELECT stddev_pop(value) AS sd, count(*) AS n FROM events GROUP BY user_id)")


def auroc_sql(source: str, score: str, label: str, key: str | None = None) -> str:
    """Every positive against every distinct score's negatives, ties half."""
    k = f"{key}, " if key else ""
    part = f"PARTITION BY {key} " if key else ""
    group = f"GROUP BY {key}" if key else ""
    return (
        f"SELECT {k}CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN 'available' ELSE 'not_available' END AS status, "
        "round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below - neg / 2.0)) / (sum(pos) * sum(neg)) END, 6) AS value, "
        "CAST(coalesce(sum(pos), 0) AS BIGINT) AS positive_count, CAST(coalesce(sum(neg), 0) AS BIGINT) AS negative_count "
        f"FROM (SELECT *, sum(neg) OVER ({part}ORDER BY s) AS below FROM (SELECT {k}{score} AS s, "
        f"count(*) FILTER ({label}) AS pos, count(*) FILTER (NOT {label}) AS neg FROM {source} GROUP BY {k}{score})) {group}")


def agg5(spark, folder):
    return semantic_auroc(primary(results(spark, folder)))


AGG5_SQL = (f"WITH {RESULTS_SQL}, semantic AS (SELECT * FROM results WHERE sample_type <> 'invalid') "
            + auroc_sql("semantic", "score_eval", "expected_pass"))


def labelled_documents(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, folder, "labels").join(docs, "doc_id").withColumn(
        "good", F.col("quality") == 1)


_DOCS_SQL = "docs AS (SELECT *, quality = 1 AS good FROM labels JOIN documents USING (doc_id))"


def agg5_by_language(spark, folder):
    return auroc(labelled_documents(spark, folder), "n_chars", "good", ["lang"]).withColumn(
        "value", F.round("value", 6))


AGG5_LANG_SQL = f"WITH {_DOCS_SQL} " + auroc_sql("docs", "n_chars", "good", "lang")


def agg5_orders(spark, folder):
    """Does a high price tell a finished order? All orders, mostly distinct prices."""
    rows = table(spark, folder, "orders").select(
        "o_totalprice", (F.col("o_orderstatus") == "F").alias("finished"))
    return auroc(rows, "o_totalprice", "finished").withColumn("value", F.round("value", 6))


AGG5_ORDERS_SQL = auroc_sql("orders", "o_totalprice", "(o_orderstatus = 'F')")

_TIMINGS = {"total": "value", "similarity": "CASE WHEN event_type <> 'error' THEN value * 0.5 END",
            "reference_search": "CASE WHEN event_type <> 'error' THEN value * 0.25 END"}


def agg6(spark, folder):
    return latency_report(table(spark, folder, "events"), {n: F.expr(e) for n, e in _TIMINGS.items()})


AGG6_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS metric, round(quantile_cont({e}, 0.5), 6) AS p50, round(quantile_cont({e}, 0.95), 6) AS p95 FROM events"
    for n, e in _TIMINGS.items())


def semantic(spark, folder):
    return results(spark, folder).where("sample_type <> 'invalid'")


def agg7(spark, folder):
    rows = metrics(semantic(spark, folder), "match_probability", F.col("match_probability") >= 0.62)
    return rows.select("split", "sample_count", "positive_count", "hard_negative_count", "random_negative_count",
                       *[rounded(c) for c in ("positive_acceptance_rate", "hard_negative_false_acceptance_rate",
                                              "random_negative_false_acceptance_rate", "auroc")])


def metrics_sql(accepted: str, score: str, extra: str = "") -> str:
    def rate(kind):
        return f"round(avg(CAST({accepted} AS INTEGER)) FILTER (sample_type = '{kind}'), 6)"
    return (
        f"SELECT m.*, a.value + 0.0 AS auroc{extra} FROM (SELECT split, count(*) AS sample_count, "
        "count(*) FILTER (sample_type = 'positive') AS positive_count, count(*) FILTER (sample_type = 'hard_negative') AS hard_negative_count, "
        f"count(*) FILTER (sample_type = 'random_negative') AS random_negative_count, {rate('positive')} AS positive_acceptance_rate, "
        f"{rate('hard_negative')} AS hard_negative_false_acceptance_rate, {rate('random_negative')} AS random_negative_false_acceptance_rate "
        f"FROM semantic GROUP BY 1) m JOIN ({auroc_sql('semantic', score, 'expected_pass', 'split')}) a USING (split)")


_SEMANTIC = "semantic AS (SELECT * FROM results WHERE sample_type <> 'invalid')"
AGG7_SQL = f"WITH {RESULTS_SQL}, {_SEMANTIC} " + metrics_sql("(match_probability >= 0.62)", "match_probability")


def agg8(spark, folder):
    rows = select_threshold(results(spark, folder).where("sample_type <> 'invalid'"), "match_probability", ["split"])
    return rows.select("split", "threshold", rounded("positive_acceptance_rate"), rounded("false_acceptance_rate"))


def threshold_sql(source: str, key: str, probability: str) -> str:
    """Every candidate judged by itself, straight from the definition."""
    return (
        f"SELECT {key}, t AS threshold, round(pr, 6) AS positive_acceptance_rate, round(fr, 6) AS false_acceptance_rate FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY pr DESC, fr, t DESC) AS rn FROM (SELECT c.{key}, c.t, "
        f"avg(CAST(s.{probability} >= c.t AS INTEGER)) FILTER (s.sample_type = 'positive') AS pr, "
        f"avg(CAST(s.{probability} >= c.t AS INTEGER)) FILTER (s.sample_type = 'hard_negative') AS fr "
        f"FROM (SELECT DISTINCT {key}, {probability} AS t FROM {source} UNION SELECT DISTINCT {key}, 0.0 FROM {source} "
        f"UNION SELECT DISTINCT {key}, 1.0 FROM {source}) c JOIN {source} s ON s.{key} = c.{key} GROUP BY 1, 2) WHERE fr <= 0.10) WHERE rn = 1")


AGG8_SQL = f"WITH {RESULTS_SQL}, {_SEMANTIC} " + threshold_sql("semantic", "split", "match_probability")


def line_scores(spark, folder):
    """Lines as judged samples: the share of a full quantity is the probability."""
    return table(spark, folder, "lineitem").select(
        F.col("l_linestatus").alias("split"), F.round(F.col("l_quantity") / 50, 4).alias("p"),
        F.expr("CASE WHEN l_returnflag = 'R' THEN 'positive' WHEN l_returnflag = 'A' THEN 'hard_negative' "
               "ELSE 'random_negative' END").alias("sample_type"))


def agg8_lines(spark, folder):
    rows = select_threshold(line_scores(spark, folder), "p", ["split"])
    return rows.select("split", "threshold", rounded("positive_acceptance_rate"), rounded("false_acceptance_rate"))


AGG8_LINES_SQL = (
    "WITH lines AS (SELECT l_linestatus AS split, round(l_quantity / 50, 4) AS p, CASE WHEN l_returnflag = 'R' THEN 'positive' "
    "WHEN l_returnflag = 'A' THEN 'hard_negative' ELSE 'random_negative' END AS sample_type FROM lineitem) "
    + threshold_sql("lines", "split", "p"))


def agg9(spark, folder):
    return split_counts(results(spark, folder)).select("split", "sample_count", "positives", "negatives")


AGG9_SQL = (f"WITH {RESULTS_SQL} SELECT split, count(*) AS sample_count, count(*) FILTER (expected_pass) AS positives, "
            "count(*) FILTER (NOT expected_pass) AS negatives FROM results GROUP BY 1")

_STATS = ("l_quantity", "l_extendedprice", "l_discount", "flat")


def agg14(spark, folder):
    """A constant feature must get scale 1."""
    rows = table(spark, folder, "lineitem").withColumn("flat", F.lit(3.0))
    return standardisation(rows, _STATS).select("feature", rounded("mean", 4), rounded("scale", 4))


AGG14_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END, 4) AS scale "
    "FROM (SELECT *, 3.0 AS flat FROM lineitem)" for c in _STATS)


def jn1(spark, folder):
    """Found words mapped to product words; w7 has no mapping and stays."""
    vocab = words(spark).where("ordinal <> 7").select(
        F.col("target_word").alias("lookup_word"), F.upper("target_word").alias("target_word"))
    rows = results(spark, folder).select("sample_id", "best_other_word")
    return to_product_word(rows, vocab, "best_other_word", "nearest_confusion").select("sample_id", "nearest_confusion")


JN1_SQL = (f"WITH {RESULTS_SQL} SELECT sample_id, CASE WHEN best_other_word = 'w7' THEN 'w7' ELSE upper(best_other_word) END "
           "AS nearest_confusion FROM results")


def jn5(spark, folder):
    """Accepted counts of every word and group, absent ones as zero."""
    counts = results(spark, folder).groupBy("target_word").agg(
        F.count("*").alias("samples"), F.count_if("accepted").alias("hits"))
    table_ = zero_fill(words(spark), counts, "target_word", ("samples", "hits"))
    return table_.select("target_word", "samples", "hits", safe_rate(F.col("hits"), F.col("samples")).alias("rate"))


JN5_SQL = (f"WITH {RESULTS_SQL}, {_WORDS_SQL} SELECT word AS target_word, count(sample_id) AS samples, count(sample_id) FILTER (accepted) AS hits, "
           f"{rate_sql('count(sample_id) FILTER (accepted)', 'count(sample_id)')} AS rate FROM words LEFT JOIN results ON target_word = word GROUP BY 1")


def jn7(spark, folder):
    """Calibrated and given decisions side by side."""
    rows = compare(semantic(spark, folder).withColumn("score", F.col("score_eval")), 0.62)
    return rows.select("decider", "split", "sample_count", "positive_count", "hard_negative_count", "random_negative_count", "threshold",
                       *[rounded(c) for c in ("positive_acceptance_rate", "hard_negative_false_acceptance_rate",
                                              "random_negative_false_acceptance_rate", "auroc")])


JN7_SQL = (f"WITH {RESULTS_SQL}, {_SEMANTIC} "
           + metrics_sql("(match_probability >= 0.62)", "match_probability", ", 'calibrated' AS decider, 0.62 AS threshold")
           + " UNION ALL BY NAME "
           + metrics_sql("accepted", "score_eval", ", 'baseline' AS decider, CAST(NULL AS DOUBLE) AS threshold"))


def fn12(spark, folder):
    """Returned lines per large line of each part; null without a large line."""
    lines = table(spark, folder, "lineitem").groupBy("l_partkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.count_if(F.col("l_quantity") > 45).alias("large"))
    return lines.select("l_partkey", safe_rate(F.col("returned"), F.col("large")).alias("rate"))


FN12_SQL = ("SELECT l_partkey, round_even(count(*) FILTER (l_returnflag = 'R') / nullif(CAST(count(*) FILTER (l_quantity > 45) AS DOUBLE), 0), 6) "
            "AS rate FROM lineitem GROUP BY 1")


def ts15(spark, folder):
    rows = repeat_samples(table(spark, folder, "embeddings").select("vec_id", "label"), 3)
    return rows.select("vec_id", "repeat_index")


TS15_SQL = "SELECT vec_id, CAST(i AS INTEGER) AS repeat_index FROM embeddings CROSS JOIN range(3) r(i)"


def flt4(spark, folder):
    return primary(repeat_samples(table(spark, folder, "events").select("event_id"), 2)).groupBy(
        "repeat_index").agg(F.count("*").alias("n"))


FLT4_SQL = "SELECT CAST(0 AS INTEGER) AS repeat_index, count(*) AS n FROM events"


def srt2(spark, folder):
    """Place of each result in sample and repeat order."""
    rows = repeat_samples(results(spark, folder).drop("repeat_index"), 2).select(
        F.col("sample_id").cast("string").alias("sample_id"), "repeat_index", "score_eval")
    return OrderedRows(rows, [], ["sample_id", "repeat_index"]).index("place").done()


SRT2_SQL = (f"WITH {RESULTS_SQL} SELECT CAST(sample_id AS VARCHAR) AS sample_id, CAST(i AS INTEGER) AS repeat_index, score_eval, "
            "row_number() OVER (ORDER BY CAST(sample_id AS VARCHAR), i) - 1 AS place FROM results CROSS JOIN range(2) r(i)")


def sink2(spark, folder):
    """The confusion report written and read back with its own schema."""
    report = agg3(spark, folder)
    path = scratch_path(spark, "confusions")
    write_small(report.orderBy("target_word", "confused_with"), path)
    return spark.read.schema(report.schema).json(path)


_STATUS = "CASE WHEN sample_id % 7 = 0 THEN 'unreviewed' ELSE 'target_variant' END"
_LABEL = "CASE WHEN sample_id % 7 < 2 THEN '' WHEN sample_id % 3 = 0 THEN 'true' ELSE 'false' END"
_REPEATS = 2
_TOTAL_MS = "CAST((sample_id * (repeat_index + 3)) % 997 AS DOUBLE)"


def labelled_results(spark, folder):
    """(result rows of labelled samples with repeats and timings, counts of the manifest)."""
    found = results(spark, folder).drop("repeat_index")
    manifest = found.select("sample_id", F.expr(_STATUS).alias("variant_status"), F.expr(_LABEL).alias("expected_pass"))
    included, counts = split_truth(manifest)
    rows = repeat_samples(found.join(included.select("sample_id"), "sample_id", "left_semi"), _REPEATS)
    rows = rows.withColumn("score_eval", F.col("score_eval") + F.col("repeat_index"))
    total = F.expr(_TOTAL_MS)
    return rows.withColumns({"total_ms": total, "similarity_ms": total * 0.5, "reference_search_ms": total * 0.25}), counts


def read_summary(spark, path):
    group = ", ".join(f"{t}: struct<status: string, sample_count: bigint, acceptance_rate: double>" for t in SAMPLE_TYPES)
    times = ", ".join(f"{m}_{p}: double" for m in _TIMINGS for p in ("p50", "p95"))
    schema = ("manifest_row_count bigint, evaluated_sample_count bigint, attempt_count bigint, "
              "excluded struct<total_count: bigint, unreviewed_count: bigint>, "
              f"groups struct<{group}>, semantic_auroc struct<value: double>, "
              "score_stability struct<repeat_count: bigint, mean_score_stddev: double, max_score_stddev: double>, "
              f"latency_ms struct<{times}>")
    return spark.read.schema(schema).json(path)


def sink2_summary(spark, folder):
    """The evaluation's summary written and read back, one row."""
    rows, counts = labelled_results(spark, folder)
    table_path, path = scratch_path(spark, "results"), scratch_path(spark, "summary")
    rows.write.parquet(table_path)
    write_summary(spark, summary(spark.read.schema(rows.schema).parquet(table_path), counts), path)
    found = read_summary(spark, path)
    groups = [F.col(f"groups.{t}.{m}").alias(f"{t}_{m}") for t in SAMPLE_TYPES for m in ("sample_count", "acceptance_rate")]
    return found.select(
        "manifest_row_count", "evaluated_sample_count", "attempt_count", "excluded.*", *groups,
        F.col("semantic_auroc.value").alias("auroc"), "score_stability.*", "latency_ms.*")


SINK2_SUMMARY_SQL = (
    f"WITH {RESULTS_SQL}, given AS (SELECT *, {_STATUS} AS status, {_LABEL} AS label FROM results), "
    "kept AS (SELECT * FROM given WHERE status <> 'unreviewed' AND label <> ''), "
    f"tries AS (SELECT *, {_TOTAL_MS} AS total_ms FROM (SELECT *, CAST(i AS BIGINT) AS repeat_index FROM kept CROSS JOIN range({_REPEATS}) r(i))), "
    "each AS (SELECT sample_id, stddev_pop(score_eval + repeat_index) AS sd, count(*) AS n FROM tries GROUP BY sample_id), "
    "pos AS (SELECT score_eval AS s FROM kept WHERE sample_type <> 'invalid' AND expected_pass), "
    "neg AS (SELECT score_eval AS s FROM kept WHERE sample_type <> 'invalid' AND NOT expected_pass) SELECT "
    "(SELECT count(*) FROM given) AS manifest_row_count, (SELECT count(*) FROM kept) AS evaluated_sample_count, "
    "(SELECT count(*) FROM tries) AS attempt_count, (SELECT count(*) FROM given) - (SELECT count(*) FROM kept) AS total_count, "
    "(SELECT count(*) FROM given WHERE status = 'unreviewed') AS unreviewed_count, "
    + ", ".join(f"(SELECT count(*) FROM kept WHERE sample_type = '{t}') AS {t}_sample_count, (SELECT "
                + rate_sql(f"count(*) FILTER (WHERE accepted AND sample_type = '{t}')", f"count(*) FILTER (WHERE sample_type = '{t}')")
                + f" FROM kept) AS {t}_acceptance_rate" for t in SAMPLE_TYPES)
    + ", (SELECT round_even(avg(CASE WHEN pos.s > neg.s THEN 1.0 WHEN pos.s = neg.s THEN 0.5 ELSE 0.0 END), 6) FROM pos, neg) AS auroc, "
    "(SELECT max(n) FROM each) AS repeat_count, (SELECT round_even(avg(sd), 6) FROM each) AS mean_score_stddev, "
    "(SELECT round_even(max(sd), 6) FROM each) AS max_score_stddev, "
    + ", ".join(f"(SELECT round_even(quantile_cont(total_ms * {w}, {q / 100}), 6) FROM tries{where}) AS {m}_p{q}"
                for m, w, where in (("total", 1, ""), ("similarity", 0.5, " WHERE quality_valid"),
                                    ("reference_search", 0.25, " WHERE quality_valid")) for q in (50, 95)))


QUERIES = {
    "agg1_group_summary": (agg1, AGG1_SQL),
    "agg2_per_word": (agg2, AGG2_SQL),
    "agg3_confusions": (agg3, AGG3_SQL),
    "agg4_stability": (agg4, AGG4_SQL),
    "agg5_auroc": (agg5, AGG5_SQL),
    "agg5_auroc_by_language": (agg5_by_language, AGG5_LANG_SQL),
    "agg5_auroc_orders": (agg5_orders, AGG5_ORDERS_SQL),
    "agg6_latency_percentiles": (agg6, AGG6_SQL),
    "agg7_metrics": (agg7, AGG7_SQL),
    "agg8_threshold": (agg8, AGG8_SQL),
    "agg8_threshold_lines": (agg8_lines, AGG8_LINES_SQL),
    "agg9_split_counts": (agg9, AGG9_SQL),
    "agg14_standardisation": (agg14, AGG14_SQL),
    "jn1_product_word": (jn1, JN1_SQL),
    "jn5_zero_fill": (jn5, JN5_SQL),
    "jn7_compare_deciders": (jn7, JN7_SQL),
    "fn12_safe_rate": (fn12, FN12_SQL),
    "ts15_repeats": (ts15, TS15_SQL),
    "flt4_primary_rows": (flt4, FLT4_SQL),
    "srt2_result_order": (srt2, SRT2_SQL),
    "sink2_report": (sink2, AGG3_SQL),
    "sink2_summary": (sink2_summary, SINK2_SUMMARY_SQL),
}
