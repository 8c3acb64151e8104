"""Writers with a fixed column order."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsift.functions.text import canonical_json


def fixed_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly these columns: absent ones become null, extra ones are dropped."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def csv_ready(df: DataFrame) -> DataFrame:
    """Maps as canonical JSON text and booleans as True or False; nulls are written as blanks."""
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, T.MapType):
            c = F.coalesce(canonical_json(c), F.lit("{}"))
        elif isinstance(field.dataType, T.BooleanType):
            c = F.initcap(c.cast("string"))
        out.append(c.alias(field.name))
    return df.select(*out)


def write_fixed(df: DataFrame, columns: Sequence[str], path: str, form: str = "parquet") -> None:
    shaped = fixed_columns(df, columns)
    if form == "csv":
        writer = csv_ready(shaped).write.mode("overwrite").option("header", True)
        writer.option("escape", '"').option("emptyValue", "").csv(path)
    else:
        shaped.write.mode("overwrite").format(form).save(path)


def split_quarantine(records: DataFrame, excluded: Collection[str]) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and rows whose failure reason is excluded."""
    out = F.coalesce(F.col("failure_reason"), F.lit("")).isin(list(excluded))
    return records.where(~out), records.where(out)


def write_quarantined(records: DataFrame, excluded: Collection[str], path: str) -> None:
    """One write: the quarantined rows get their own partition folder."""
    flag = F.coalesce(F.col("failure_reason"), F.lit("")).isin(list(excluded))
    records.withColumn("quarantined", flag).write.mode("overwrite").partitionBy("quarantined").parquet(path)


def public_subset(summary: DataFrame) -> DataFrame:
    """Complete passes only."""
    return summary.where((F.col("pass_fail") == "pass") & (F.col("completed_grid_points") == F.col("grid_points")))


def write_summary(summary: DataFrame, public_path: str, internal_path: str) -> None:
    public_subset(summary).write.mode("overwrite").parquet(public_path)
    summary.write.mode("overwrite").parquet(internal_path)
