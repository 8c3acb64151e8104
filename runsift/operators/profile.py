"""Counts, buckets and coverage of run records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.functions.numeric import general_text, to_double


def flag_counts(rows: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows, and for each flag how many are set and not set."""
    out = [F.count(F.lit(1)).alias("total")]
    for f in flags:
        out += [F.count_if(F.col(f)).alias(f), F.count_if(~F.coalesce(F.col(f), F.lit(False))).alias(f"not_{f}")]
    return rows.agg(*out)


def label_column(column: str, missing: str) -> Column:
    return F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(missing))


def value_counts(rows: DataFrame, column: str, missing: str = "unknown") -> DataFrame:
    return rows.groupBy(label_column(column, missing).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def numeric_bucket(column: str) -> Column:
    """Number in short general notation; anything else is unknown."""
    return F.coalesce(general_text(to_double(F.col(column))), F.lit("unknown"))


def missing_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values per column: one pass, then long form."""
    counts = rows.agg(*[
        F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in columns])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def key_coverage(rows: DataFrame, json_column: str) -> DataFrame:
    """Rows per key of a JSON map column; malformed text counts as an empty map."""
    keys = F.array_distinct(F.map_keys(F.from_json(json_column, "map<string,string>")))
    return rows.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def top_values(counts: DataFrame, limit: int) -> DataFrame:
    return counts.orderBy(F.col("n").desc(), F.col("value").asc()).limit(limit)


def class_distribution(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Per group the total and its class counts as text; a group has one entry per class."""
    counts = rows.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct(F.col(label).alias("c"), F.concat(F.col(label), F.lit("="), F.col("n").cast("string")).alias("t"))
    return counts.groupBy(group).agg(
        F.sum("n").cast("long").alias("total"),
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"]), ", ").alias("distribution"))


def quarantine_totals(kept: DataFrame, held: DataFrame, success: Column) -> DataFrame:
    both = kept.withColumn("__held", F.lit(False)).unionByName(held.withColumn("__held", F.lit(True)))
    return both.agg(
        F.count_if(~F.col("__held")).alias("n_main"), F.count_if(F.col("__held")).alias("n_quarantined"),
        F.count(F.lit(1)).alias("n_all"), F.count_if(~F.col("__held") & success).alias("n_main_success"))


def many_value_counts(rows: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Counts of several columns in one pass."""
    entries = F.array(*[F.struct(F.lit(n).alias("column_name"), c.alias("value")) for n, c in columns.items()])
    return rows.select(F.explode(entries).alias("e")).groupBy("e.column_name", "e.value").agg(
        F.count(F.lit(1)).alias("n"))
