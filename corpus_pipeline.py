"""A corpus pipeline over ``documents``: quality, near duplicates, test items, secrets, encoding.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; each is written as Parquet and read
back as the next one's docs. All but the last return the columns of documents, and any others.

Cases: rows with null or empty text go by their score as any other, and are otherwise never grouped,
matched or changed; the last stage gives them no pieces. Null ids, sources and languages are carried.
Texts of any length are one row's work in every stage. Of repeated rows and of ties within a group of
near duplicates the row of least id, then least text key, stays. Extra columns, also with names that
stages use inside or that differ in case only from these, go through unchanged. An empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionmatch.llm import decontamination, factorisation, jaccard_join, merge_dropout, structures
from motionmatch.llm.queries import fold
from motionmatch.llm.texts import settled, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3, learnt from the labels of these documents."""
    machine = factorisation.taught(docs, table(spark, sf_dir, "labels"), fold(5) != 0, factorisation.Fit())
    return factorisation.good_enough(docs, machine)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 or more."""
    return jaccard_join.one_of_each(docs)


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return structures.without_secrets(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, number of pieces, and whether decoding gives the text back."""
    found = merge_dropout.encoded(docs, merge_dropout.Vocabulary.load())
    return found.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_pieces"),
                        F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", test_items), ("secret scans", secrets),
          ("SentencePiece encoding and decoding", encoding)]

# Trained scores, posterior tests and merges have no SQL; the pipeline is tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name.split()[-1].lower())
    return docs
