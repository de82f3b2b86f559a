"""A digest of a table's content that does not depend on row order.

Row digests are cut into 60-bit words and summed, so the table digest is one
combining aggregate: no sort, no list of rows, no hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "\x1f"
WORDS = 4


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 over the named columns as text; null and blank stay apart."""
    texts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws(UNIT, *texts), 256)


def digest_words(digest: Column) -> list[Column]:
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
            for i in range(WORDS)]


def fingerprint(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, row_count, fingerprint) over the multiset of rows."""
    hashed = df.select(*keys, row_digest(columns).alias("_d"))
    sums = [F.sum(w).alias(f"_s{i}") for i, w in enumerate(digest_words(F.col("_d")))]
    parts = hashed.groupBy(*keys).agg(F.count("*").alias("row_count"), *sums)
    text = F.concat_ws(":", "row_count", *[
        F.coalesce(F.col(f"_s{i}"), F.lit(0).cast("decimal(38,0)")).cast("string")
        for i in range(WORDS)])
    return parts.select(*keys, "row_count", F.sha2(text, 256).alias("fingerprint"))
