"""Inventory to manifest: label, check coverage, write in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionmatch.operators.manifest import label_rows, manifest_order
from motionmatch.operators.rules import require_clean


def build_manifest(listing: DataFrame, vocab: DataFrame, source: str) -> DataFrame:
    """Ordered manifest rows; raises on unreadable signers or words without a clip."""
    rows, rejects = label_rows(listing, vocab, source)
    require_clean(rejects.select(F.lit("signer").alias("code"), "rel_path"))
    found = rows.select("target_word").distinct()
    require_clean(vocab.join(found, "target_word", "left_anti").select(
        F.lit("no_clip").alias("code"), "target_word"))
    return rows.orderBy(*manifest_order())
