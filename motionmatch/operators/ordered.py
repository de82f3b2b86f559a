"""Ordered work (index, lag, running sums) that no single key can stall.

A window over ``keys`` puts one key in one task. When the input is large, rows
are range-partitioned on ``keys + order``, so a hot key spans as many range
partitions as its share of the rows calls for. The partition number is stored
with the rows by a reliable checkpoint (range bounds come from a sample, so they
must not be drawn twice). Each range is windowed alone; what a range needs from
earlier ranges of its key is a one-row-per-range summary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionmatch.operators.sizing import ONE_TASK_BYTES, SPREAD_BYTES, is_small
from motionmatch.sources.scratch import shared_dir

PART = "_range"


class OrderedRows:
    """Rows ordered within ``keys`` by ``order`` (unique within the keys)."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
                 descending: bool = False, spread_bytes: int = SPREAD_BYTES):
        self.keys = list(keys)
        self.names, self.descending = list(order), descending
        self.order = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
        self.spread = not is_small(df, spread_bytes if self.keys else min(spread_bytes, ONE_TASK_BYTES))
        if self.spread:
            shared_dir(df.sparkSession)
            ranged = df.repartitionByRange(*[F.col(k) for k in self.keys], *self.order)
            self.frame = ranged.withColumn(PART, F.spark_partition_id()).checkpoint()
        else:
            self.frame = df
        self.group = [*self.keys, PART] if self.spread else self.keys

    def _window(self):
        return Window.partitionBy(*self.group).orderBy(*self.order)

    def _ranges(self):
        """Window over the summaries of one key: at most one row per range."""
        return Window.partitionBy(*self.keys).orderBy(PART)

    def _join_summary(self, summary: DataFrame) -> None:
        condition = None
        left, right = self.frame.alias("l"), summary.alias("r")
        for name in self.group:
            term = F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))
            condition = term if condition is None else condition & term
        extra = [c for c in summary.columns if c not in self.group]
        self.frame = left.join(right, condition, "left").select(
            "l.*", *[F.col(f"r.{c}") for c in extra])

    def running(self, totals: bool = False, **sums: Column) -> "OrderedRows":
        """Add inclusive running sums; with ``totals`` also ``<name>_total``."""
        upto = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if not self.spread:
            whole = Window.partitionBy(*self.group)
            columns = {name: F.sum(value).over(upto) for name, value in sums.items()}
            if totals:
                columns |= {f"{name}_total": F.sum(value).over(whole)
                            for name, value in sums.items()}
            self.frame = self.frame.withColumns(columns)
            return self
        ranges = self._ranges()
        before = ranges.rowsBetween(Window.unboundedPreceding, -1)
        summary = self.frame.groupBy(*self.group).agg(
            *[F.sum(value).alias(f"_sum_{name}") for name, value in sums.items()])
        whole = Window.partitionBy(*self.keys)
        picked = [F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}")
                  for n in sums]
        if totals:
            picked += [F.sum(f"_sum_{n}").over(whole).alias(f"{n}_total") for n in sums]
        summary = summary.select(*self.group, *picked)
        self.frame = self.frame.withColumns(
            {name: F.sum(value).over(upto) for name, value in sums.items()})
        self._join_summary(summary)
        self.frame = self.frame.withColumns(
            {name: F.col(name) + F.col(f"_before_{name}") for name in sums}
        ).drop(*[f"_before_{name}" for name in sums])
        return self

    def index(self, name: str, total: str | None = None) -> "OrderedRows":
        """Add the 0-based position and, if named, the group's row count."""
        self.running(totals=total is not None, **{name: F.lit(1).cast("long")})
        self.frame = self.frame.withColumn(name, F.col(name) - 1)
        if total is not None:
            self.frame = self.frame.withColumnRenamed(f"{name}_total", total)
        return self

    def previous(self, name: str, value: str) -> "OrderedRows":
        """Add ``value`` of the row before, null on a key's first row."""
        self.frame = self.frame.withColumn(name, F.lag(value).over(self._window()))
        if self.spread:
            ordering = F.struct(*self.names)
            pick = F.min_by if self.descending else F.max_by
            summary = self.frame.groupBy(*self.group).agg(pick(value, ordering).alias("_last"))
            summary = summary.select(
                *self.group, F.lag("_last").over(self._ranges()).alias("_carried"))
            first = F.row_number().over(self._window()) == 1
            self.frame = self.frame.withColumn("_first", first)
            self._join_summary(summary)
            self.frame = self.frame.withColumn(
                name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col(name))
            ).drop("_first", "_carried")
        return self

    def done(self) -> DataFrame:
        return self.frame.drop(PART) if self.spread else self.frame
