"""The word list recordings are scored against, and its contract checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionmatch.functions.text import stripped
from motionmatch.operators.sizing import local_rows

# The deployed words, in report order.
WORDS = (
    "HELLO", "PLEASE", "THANKYOU", "YES", "NO", "APPLE", "BOOK", "CAR", "CAT", "BIRD",
    "BLUE", "BLACK", "WHITE", "RED", "WATER", "MILK", "MOM", "DAD", "BROTHER", "CHILD",
    "HOME", "MORNING", "NIGHT", "RAIN", "SNOW", "HAPPY", "SAD", "SICK", "SHIRT", "WAIT",
)
# Words the reference library files under another name.
LOOKUP_OVERRIDES = {"THANKYOU": "THANK YOU", "MOM": "MOTHER", "DAD": "FATHER"}

CATEGORIES = ("game", "non-game")
SPLITS = ("train", "val", "test")
SCHEMA = "ordinal INT, target_word STRING, slug STRING, lookup_word STRING"


def scan_vocabulary(spark: SparkSession, words=WORDS, lookup=None) -> DataFrame:
    """The vocabulary as a small dimension: ordinal, target_word, slug, lookup_word."""
    lookup = LOOKUP_OVERRIDES if lookup is None else lookup
    rows = [(i, w, w.lower(), lookup.get(w, w)) for i, w in enumerate(words)]
    return local_rows(spark, rows, SCHEMA)


def vocabulary_issues(vocab: DataFrame, expected_count: int | None = None) -> DataFrame:
    """Contract breaches as (code, subject); empty when the vocabulary is sound."""
    blank = stripped(F.coalesce("lookup_word", F.lit(""))) == ""
    target = F.coalesce("target_word", F.lit(""))
    per_row = vocab.select(F.explode(F.array_compact(F.array(
        F.when((target == "") | (target != F.upper(target)), F.struct(
            F.lit("target_case").alias("code"), target.alias("subject"))),
        F.when(~F.coalesce("slug", F.lit("")).rlike("^[a-z0-9]+$"), F.struct(
            F.lit("unsafe_slug").alias("code"), F.coalesce("slug", F.lit("")).alias("subject"))),
        F.when(blank, F.struct(
            F.lit("lookup_word").alias("code"), target.alias("subject"))),
    ))).alias("issue")).select("issue.*")
    issues = per_row
    for column in ("target_word", "slug"):
        issues = issues.unionByName(
            vocab.groupBy(column).count().where("count > 1")
            .select(F.lit(f"duplicate_{column}").alias("code"), F.col(column).alias("subject")))
    if expected_count is not None:
        issues = issues.unionByName(
            vocab.agg(F.count("*").alias("n")).where(F.col("n") != expected_count)
            .select(F.lit("word_count").alias("code"), F.col("n").cast("string").alias("subject")))
    return issues
