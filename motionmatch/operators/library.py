"""Reference library: checks, word filter, coverage, export equivalence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionmatch.functions.scoring import finite, manual_score
from motionmatch.functions.text import normalize_key
from motionmatch.operators.ordered import OrderedRows
from motionmatch.operators.search import search
from motionmatch.operators.sizing import SPREAD_BYTES


# How far similarities of equal vectors may lie apart.
TOLERANCE = {"double": 1e-9, "single": 1e-5}


def filter_words(library: DataFrame, allowed: DataFrame, *, order: str = "position",
                 word: str = "lookup_word", spread_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Entries of the allowed words, renumbered 0..n-1 in entry order.

    Matches on ``word`` only, never on the slug. The vector stays with its row.
    """
    keys = allowed.select(normalize_key(F.col(word)).alias("_key")).distinct()
    kept = library.withColumn("_key", normalize_key(F.col("word"))).join(
        keys, "_key", "left_semi").drop("_key")
    # Only the ids are ordered; vectors join back on the id they came with.
    numbered = OrderedRows(kept.select(F.col("ref_id"), F.col(order).alias("_order")), [],
                           ["_order", "ref_id"], spread_bytes=spread_bytes).index("_new").done()
    return (kept.join(numbered.select("ref_id", "_new"), "ref_id")
            .withColumn("source_ref_id", F.col("ref_id"))
            .withColumn("ref_id", F.col("_new")).drop("_new"))


def missing_words(library: DataFrame, allowed: DataFrame, word: str = "lookup_word") -> DataFrame:
    """Allowed words without any library entry."""
    present = library.select(normalize_key(F.col("word")).alias("_key")).distinct()
    return allowed.withColumn("_key", normalize_key(F.col(word))).join(
        present, "_key", "left_anti").drop("_key")


def coverage_difference(library: DataFrame, allowed: DataFrame,
                        word: str = "lookup_word") -> DataFrame:
    """Words on one side only, as (side, match_key); empty when coverage is exact."""
    have = library.select(normalize_key(F.col("word")).alias("match_key")).distinct()
    want = allowed.select(normalize_key(F.col(word)).alias("match_key")).distinct()
    return want.join(have, "match_key", "left_anti").select(
        F.lit("missing").alias("side"), "match_key").unionByName(
        have.join(want, "match_key", "left_anti").select(
            F.lit("unexpected").alias("side"), "match_key"))


def word_counts(library: DataFrame) -> DataFrame:
    return library.groupBy(normalize_key(F.col("word")).alias("match_key")).agg(
        F.count("*").alias("entries"))


def norm(vector: str = "embedding"):
    return F.sqrt(F.aggregate(
        vector, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def library_issues(library: DataFrame, dimension: int | None = None) -> DataFrame:
    """(code, subject): bad vectors by id, and id numbering faults of the whole table."""
    length = F.size("embedding")
    bad = F.exists("embedding", lambda v: ~finite(v))
    wrong = length == 0 if dimension is None else length != dimension

    def issue(code):
        return F.struct(F.lit(code).alias("code"), F.col("ref_id").cast("string").alias("subject"))

    rows = library.select(F.explode(F.array_compact(F.array(
        F.when(bad, issue("not_finite")),
        F.when(wrong, issue("dimension")),
        F.when(~bad & (norm() <= 1e-8), issue("zero_vector")),
        F.when(F.col("path").isNotNull() & ~is_portable(F.col("path")), issue("path"))
        if "path" in library.columns else F.lit(None).cast("struct<code:string,subject:string>"),
    ))).alias("issue")).select("issue.*")
    twice = library.groupBy("ref_id").count().where("count > 1").select(
        F.lit("duplicate_id").alias("code"), F.col("ref_id").cast("string").alias("subject"))
    # Unique ids that span 0..n-1 are contiguous; uniqueness is the check above.
    gaps = library.agg(F.count("*").alias("n"), F.min("ref_id").alias("lo"),
                       F.max("ref_id").alias("hi"))
    numbering = gaps.select(F.explode(F.array_compact(F.array(
        F.when(F.col("n") == 0, F.struct(F.lit("empty").alias("code"), F.lit("0").alias("subject"))),
        F.when((F.col("n") > 0) & ((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1)),
               F.struct(F.lit("not_contiguous").alias("code"),
                        F.concat_ws("..", "lo", "hi").alias("subject"))),
    ))).alias("issue")).select("issue.*")
    issues = rows.unionByName(twice).unionByName(numbering)
    if dimension is None:
        mixed = library.agg(F.min(length).alias("a"), F.max(length).alias("b")).where("a <> b")
        issues = issues.unionByName(mixed.select(
            F.lit("mixed_dimension").alias("code"), F.concat_ws("..", "a", "b").alias("subject")))
    return issues


def is_portable(path):
    """Relative, with forward slashes and no drive."""
    return ~path.rlike(r"[:\\]|^/")


def portable_path(path, word, prefix: str):
    """prefix/word/file name; the name is what follows the last slash of either kind."""
    name = F.element_at(F.split(path, r"[\\/]"), -1)
    return F.concat_ws("/", F.lit(prefix), word, name)


def export_differences(queries: DataFrame, targets: Sequence[str], before: DataFrame,
                       after: DataFrame, *, precision: str = "double", **sizes) -> DataFrame:
    """Searches and scores that changed between two libraries; empty when equal.

    Every query (query_id, embedding) is asked for every word of ``targets``. Similarities
    differ when they are more than ``TOLERANCE`` of the precision apart, or one is null:
    the last bits of a product depend on the shape of the matrices. Score and best other
    word follow from the similarities; another word at the same similarity is a tie.
    """
    tolerance = TOLERANCE[precision]
    asked = list(dict.fromkeys(targets))

    def outcome(library, side):
        found = search(queries, library, targets=asked, precision=precision, **sizes).withColumn(
            "query_id", F.to_json(F.struct("query_id", "target")))
        score = manual_score(F.col("target_similarity"), F.col("similarity_margin"))
        return found.select("query_id", F.struct(
            "target_similarity", "best_other_similarity", "best_other_word",
            score.alias("score")).alias(side))

    def moved(field):
        a, b = F.col(f"before.{field}"), F.col(f"after.{field}")
        return F.coalesce(F.abs(a - b) > tolerance, a.isNull() != b.isNull())

    both = outcome(before, "before").join(outcome(after, "after"), "query_id", "full")
    return both.where(moved("target_similarity") | moved("best_other_similarity"))
