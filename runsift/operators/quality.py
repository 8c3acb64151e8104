"""Quality gates as rows. All checks of one table share one pass over it."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift import constants as K


@dataclass(frozen=True)
class Check:
    """A measured aggregate and the test it must pass; a null outcome passes."""

    name: str
    measured: Column
    test: Callable[[Column], Column]


def row_count(name: str, expected: int | DataFrame) -> Check:
    """Row count equals a number or the row count of another table."""
    want = F.lit(expected) if isinstance(expected, int) else expected.agg(F.count(F.lit(1))).scalar()
    return Check(name, F.count(F.lit(1)), lambda n: n == want)


def required_columns(name: str, columns: Sequence[str]) -> Check:
    empty = reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.col(c).cast("string") == "") for c in columns])
    return Check(name, F.count_if(empty), lambda n: n == 0)


def enough_savings(name: str, share: float = K.SAVINGS_SHARE) -> Check:
    """Enough two-dimensional systems save calls; no such system passes."""
    counted = (F.col("dim") == 2) & F.col("savings_abs").isNotNull()
    return Check(name, F.avg(F.when(counted, (F.col("savings_abs") > 0).cast("int"))), lambda s: s >= share)


def category_error(name: str, categories: Collection[str], limit: float = K.CATEGORY_ERROR_LIMIT) -> Check:
    wanted = F.col("category").isin(list(categories))
    return Check(name, F.avg(F.when(wanted, F.col("pct_error_param1"))), lambda e: e <= limit)


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per check: check_name, passed, measured."""
    row = df.agg(*[c.measured.cast("double").alias(f"m{i}") for i, c in enumerate(checks)])
    tested = row.select("*", *[
        F.coalesce(c.test(F.col(f"m{i}")), F.lit(True)).cast("int").alias(f"p{i}") for i, c in enumerate(checks)])
    rows = F.array(*[
        F.struct(F.lit(c.name).alias("check_name"), F.col(f"p{i}").alias("passed"), F.col(f"m{i}").alias("measured"))
        for i, c in enumerate(checks)])
    return tested.select(F.explode(rows).alias("c")).select("c.*")


def verdict(tables: Sequence[tuple[DataFrame, Sequence[Check]]]) -> DataFrame:
    """All checks as rows, with the overall verdict as one more row."""
    rows = reduce(lambda a, b: a.unionByName(b), [run_checks(df, checks) for df, checks in tables])
    marks = F.array(F.struct("check_name", "passed", "measured"),
                    F.struct(F.lit("overall").alias("check_name"), "passed", "measured"))
    spread = rows.select(F.explode(marks).alias("c")).select("c.*")
    total = F.col("check_name") == "overall"
    return spread.groupBy("check_name").agg(
        F.min("passed").alias("passed"),
        F.when(F.first(total), F.count_if(F.col("passed") == 0).cast("double")).otherwise(F.first("measured")).alias("measured"))
