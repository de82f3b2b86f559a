"""Exact percentiles per group without holding a group in one task.

``percentile`` keeps every distinct value of a group in one buffer. Here one mergeable sketch
brackets all wanted ranks, and one recount places the values: those inside a bracket one by one,
all others as whole stretches between brackets. The ranks are read off that short list. One plan
for all sizes and any number of fractions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionmatch.operators.facts import with_facts

# The sketch's rank error is at most 1/accuracy of the rows; brackets are wider by this factor.
WIDTH = 4.0


def exact_percentile(df: DataFrame, keys: Sequence[str], value: str, fraction: float,
                     name: str, **options) -> DataFrame:
    """One row per key with the exact ``fraction`` percentile of ``value``."""
    return exact_percentiles(df, keys, value, {name: fraction}, **options)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, fractions: Mapping[str, float],
                      *, by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """One row per key with a column for each of ``fractions``; linear interpolation, as in ``percentile``.

    Null values take no part; a key without values has no row. ``by`` names columns that tell rows of one
    key and value apart, so that a value which most rows share is dealt over tasks too. The list that one task puts in order
    is at most about ``2 * WIDTH / accuracy`` of a key's rows for each fraction, and only distinct values.
    """
    keys = list(keys)
    values = df.select(*keys, F.col(value).cast("double").alias("_v"),
                       F.xxhash64(value, *by).alias("_row")).where(F.col("_v").isNotNull())
    ranks = {name: (max(f - WIDTH / accuracy, 0.0), min(f + WIDTH / accuracy, 1.0)) for name, f in fractions.items()}
    wanted = [rank for pair in ranks.values() for rank in pair]
    sketch = values.groupBy(*keys).agg(
        F.percentile_approx("_v", wanted, accuracy).alias("_b"), F.count("*").alias("_n"))
    # Brackets that reach an end of the data have no bound there.
    bounds = F.array(*[F.lit(float("-inf")) if rank == 0.0 else F.lit(float("inf")) if rank == 1.0
                       else F.col("_b")[i] for i, rank in enumerate(wanted)])
    brackets = sketch.select(*keys, "_n", bounds.alias("_b"))

    placed = with_facts(values, brackets, keys, ["_row"])
    v, inside = F.col("_v"), F.lit(False)
    for i in range(0, len(wanted), 2):
        inside |= (v >= F.col("_b")[i]) & (v <= F.col("_b")[i + 1])
    # Between two neighbours of one stretch lies no bound, hence no value of a bracket.
    below = sum(((F.col("_b")[i] < v).cast("int") for i in range(len(wanted))), F.lit(0))
    stretch = F.when(~inside, below)
    counted = placed.groupBy(*keys, "_n", stretch.alias("_stretch"), F.when(inside, v).alias("_inside")).agg(
        F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_least")
                            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    listed = counted.select(*keys, "_n", "_least", "_most", (upto - F.col("_c")).alias("_from"), (upto - 1).alias("_to"))

    def at(rank: Column) -> Column:
        """The value at a 0-based rank; of a stretch only its ends are known."""
        here = (F.when(F.col("_least") == F.col("_most"), rank.between(F.col("_from"), F.col("_to")))
                .otherwise((rank == F.col("_from")) | (rank == F.col("_to"))))
        return F.max(F.when(here, F.when(rank == F.col("_from"), F.col("_least")).otherwise(F.col("_most"))))

    position = {name: (F.col("_n") - 1) * F.lit(float(f)) for name, f in fractions.items()}
    picked = listed.groupBy(*keys, "_n").agg(*[
        F.struct(at(F.floor(p)).alias("lo"), at(F.ceil(p)).alias("hi")).alias(f"_{name}") for name, p in position.items()])

    def between(name: str) -> Column:
        lo, hi, p = F.col(f"_{name}")["lo"], F.col(f"_{name}")["hi"], position[name]
        return (F.when(lo.isNull() | hi.isNull(), F.raise_error(F.lit("the sketch broke its error bound")).cast("double"))
                .when(lo == hi, lo).otherwise(lo + (hi - lo) * (p - F.floor(p))))

    return picked.select(*keys, *[between(name).alias(name) for name in fractions])
