"""Keypoints to scored results: prepare, measure, gate, embed, search, score."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionmatch.functions.scoring import (
    GATE_RULE, SCORE_RULE, decision, diagnostics, is_accepted, is_ambiguous, manual_score,
)
from motionmatch.operators.embedding import embed
from motionmatch.operators.quality import gate, measure
from motionmatch.operators.search import BROADCAST_BYTES, LoadedLibrary, search
from motionmatch.operators.sequence import frame_index, normalise, resample
from motionmatch.operators.sizing import SPREAD_BYTES
from motionmatch.schemas import HAND_LANDMARKS, LANDMARKS, STEPS


def to_lookup_word(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add the library's word for each product word."""
    words = vocab.select("target_word", "lookup_word")
    return rows.join(words, "target_word", "left")


def to_product_word(rows: DataFrame, vocab: DataFrame, found: str, name: str) -> DataFrame:
    """Map a library word back to the product word; an unmapped word stays."""
    words = vocab.select(F.col("lookup_word").alias(found),
                         F.col("target_word").alias("_product"))
    return rows.join(words, found, "left").withColumn(
        name, F.coalesce("_product", found)).drop("_product")


def scored(rows: DataFrame, score_rule=SCORE_RULE, gate_rule=GATE_RULE) -> DataFrame:
    """Add score, score_eval, accepted, decision and diagnostics to measured rows.

    An unusable recording has no score in the history view (``score`` null) and
    counts as 0 in evaluations (``score_eval``).
    """
    c = F.col
    rows = rows.withColumn("score", F.when(c("quality_valid"), manual_score(
        c("target_similarity"), c("similarity_margin"), score_rule)))
    return rows.withColumns({
        "score_eval": F.coalesce("score", F.lit(0)),
        "accepted": is_accepted(c("score"), score_rule),
        "ambiguous": F.coalesce(is_ambiguous(
            c("target_similarity"), c("similarity_margin"), score_rule), F.lit(False)),
        "decision": decision(c("quality_valid"), c("score"), score_rule),
        "diagnostics": diagnostics(
            c("hand_visibility"), c("motion_energy"), c("motion_span"), c("sequence_completeness"),
            c("target_similarity"), c("best_other_similarity"), c("score"), gate_rule, score_rule),
    })


class Prepared:
    """Prepared sequences read twice, by quality and by embedding, hence kept."""

    def __init__(self, points: DataFrame, *, steps: int = STEPS, hand_landmarks: int = HAND_LANDMARKS,
                 landmarks: int = LANDMARKS, spread_bytes: int = SPREAD_BYTES):
        self.steps, self.hands, self.landmarks = steps, hand_landmarks, landmarks
        index = frame_index(points, spread_bytes=spread_bytes)
        dense = points.join(index, ["sequence_id", "frame"])
        self.rows = resample(normalise(dense), steps=steps).persist(StorageLevel.MEMORY_AND_DISK)
        self.counts = index.groupBy("sequence_id").agg(F.max("frames").alias("frames"))

    def quality(self, rule=GATE_RULE) -> DataFrame:
        return gate(measure(self.rows, self.counts, steps=self.steps, hand_landmarks=self.hands), rule)

    def embeddings(self, usable: DataFrame | None = None, library: LoadedLibrary | None = None) -> DataFrame:
        """Vectors of all or of the usable sequences; for a ``library`` cut as it is, see ``embed``."""
        rows = self.rows
        if usable is not None:
            rows = rows.join(usable.select("sequence_id"), "sequence_id", "left_semi")
        return embed(rows, steps=self.steps, landmarks=self.landmarks, library=library)

    def release(self) -> None:
        self.rows.unpersist()


def match_recordings(prepared: Prepared, recordings: DataFrame, library: DataFrame | LoadedLibrary,
                     vocab: DataFrame, *, gate_rule=GATE_RULE, score_rule=SCORE_RULE,
                     skip_same_id: bool = False, precision: str = "double", strict: bool = True,
                     broadcast_bytes: int = BROADCAST_BYTES, **sizes) -> DataFrame:
    """One result row per recording (recording_id, sequence_id, target_word, ...).

    Several recordings may ask for one sequence; it is prepared once. Sequences
    that fail the gate are neither embedded nor searched. A word that the library lacks, and a
    library without any other word, are errors unless ``strict`` is off; then the score is null.
    """
    quality = prepared.quality(gate_rule)
    usable = quality.where("quality_valid")
    asked = to_lookup_word(recordings, vocab)
    if not isinstance(library, LoadedLibrary):
        library = LoadedLibrary(library, precision, broadcast_bytes)
    # Cut to what the library uses before they are joined: whole, a vector is 88 KB.
    vectors = prepared.embeddings(usable, library)
    queries = asked.join(vectors, "sequence_id").select(
        F.col("recording_id").alias("query_id"), F.col("lookup_word").alias("target"),
        *[c for c in vectors.columns if c != "sequence_id"])
    found = search(queries, library, skip_same_id=skip_same_id, **sizes)
    if strict:
        found = found.where(F.when(F.col("target_similarity").isNotNull() & F.col("best_other_similarity").isNotNull(), True)
                            .otherwise(F.raise_error(F.concat(
                                F.lit("no entry for the word, or none for another word, of recording "),
                                F.col("query_id").cast("string"))).cast("boolean")))
    found = to_product_word(found, vocab, "best_other_word", "nearest_confusion")
    rows = asked.join(quality, "sequence_id").join(
        found.withColumnRenamed("query_id", "recording_id"), "recording_id", "left")
    return scored(rows, score_rule, gate_rule).drop("best_other_word", "best_other_id")
