"""Row rules evaluated in one pass, and the set rules that need a shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionmatch.functions.text import stripped

ISSUE = "struct<code:string,row_number:bigint,column:string,message:string>"


@dataclass(frozen=True)
class Rule:
    code: str
    broken: Column
    message: Column
    column: str | None = None


def blank(column: str) -> Column:
    return stripped(F.coalesce(F.col(column), F.lit(""))) == ""


def row_issues(df: DataFrame, rules: Sequence[Rule], row_number: str = "row_number") -> DataFrame:
    """One row per broken rule; all rules of a row fire independently."""
    found = F.array_compact(F.array(*[
        F.when(F.coalesce(rule.broken, F.lit(False)), F.struct(
            F.lit(rule.code).alias("code"), F.col(row_number).cast("long").alias("row_number"),
            F.lit(rule.column).alias("column"), rule.message.alias("message")).cast(ISSUE))
        for rule in rules]))
    return df.select(F.explode(found).alias("issue")).select("issue.*")


def duplicates(df: DataFrame, keys: Sequence[str], row_number: str = "row_number") -> DataFrame:
    """Later rows of a repeated key with ``first_row``, the key's first row number.

    First rows come from a combining aggregate, so a key held by a third of all rows
    never meets in one task; AQE splits it in the join back.
    """
    firsts = df.groupBy(*keys).agg(F.min(row_number).alias("first_row"),
                                   F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return df.join(firsts, list(keys)).where(F.col(row_number) > F.col("first_row"))


def leakage(df: DataFrame, entity: str, split: str, allowed: Sequence[str] | None = None) -> DataFrame:
    """Entities seen in more than one split: (entity, splits)."""
    rows = df.where(~blank(entity) & ~blank(split)) if dict(df.dtypes)[entity] == "string" \
        else df.where(F.col(entity).isNotNull() & F.col(split).isNotNull())
    if allowed is not None:
        rows = rows.where(F.col(split).isin(*allowed))
    found = rows.groupBy(entity).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return found.where(F.size("splits") > 1)


def unmatched(df: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """Rows whose nonblank reference is not in ``known``."""
    names = known.select(F.col(known_column).alias("_known")).distinct()
    return df.where(F.col(column).isNotNull()).join(
        names, F.col(column) == F.col("_known"), "left_anti")


def require_clean(issues: DataFrame) -> None:
    """Strict mode: raise with the first issues when there are any."""
    first = issues.limit(20).collect()
    if first:
        raise ValueError("validation failed:\n" + "\n".join(
            f"[{r['code']}] {r.asDict()}" for r in first))
