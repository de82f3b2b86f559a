"""Rows joined with one row of facts about their key, however many rows a key holds.

Facts come from an aggregate by the same key. Joined plainly, the rows of a key meet in one
task, and an aggregate by that key after the join keeps Spark from splitting it. Here the rows
of a key are dealt over salts and the facts are repeated once a salt, so both sides are
exchanged for the join itself: a hot key is in several tasks, which Spark can split further,
and what follows is combined before its own exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def with_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], by: Sequence[str], *,
               how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Rows with the facts of their key; null keys are equal.

    ``by`` names columns that differ within a key; their hash deals the rows, so a task that runs
    again deals them alike. ``how`` is ``inner`` or ``left``.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    keys = list(keys)
    given = [c for c in facts.columns if c not in keys]
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).alias("r")
    repeated = facts.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")).alias("f")
    same = F.col("r._salt") == F.col("f._salt")
    for key in keys:
        same &= F.col(f"r.{key}").eqNullSafe(F.col(f"f.{key}"))
    return dealt.join(repeated, same, how).select(
        *[F.col(f"r.{c}") for c in rows.columns], *[F.col(f"f.{c}") for c in given])
