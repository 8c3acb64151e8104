"""How the driver tables feed the operators' inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


ROWS_PER_TASK = 25_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows that much work waits for, dealt over tasks by key: a file of one row group is read by one task."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_TASK))
    return rows.repartition(tasks, key)


def props_k():
    return F.get_json_object("props", "$.k").cast("int")


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates from events; the risk arrives as text with blank, NaN, bad and out-of-range values."""
    k = props_k()
    risk = (
        F.when(F.col("user_id") % 7 == 0, "")
        .when(F.col("user_id") % 11 == 0, "NaN")
        .when(F.col("user_id") % 13 == 0, "bad")
        .otherwise((k * 1.5 / 100.0 - 0.1).cast("string"))
    )
    return table(spark, folder, "events").select(
        F.col("event_id").alias("candidate_id"),
        F.col("event_id").alias("ordinal"),
        F.col("user_id").cast("string").alias("material_id"),
        F.col("event_type").alias("failure_label"),
        (F.col("event_type") == "error").cast("int").alias("true_failure"),
        ((k - 50) / 10.0).alias("predicted_value"),
        (F.col("value") / 100.0).alias("uncertainty"),
        risk.alias("failure_risk"),
    )


CANDIDATES_SQL = """
cand as (
  select event_id as candidate_id, cast(user_id as varchar) as material_id, event_type as failure_label,
    case when event_type = 'error' then 1 else 0 end as true_failure,
    (k - 50) / 10e0 as predicted_value, value / 100e0 as uncertainty,
    case when user_id % 7 = 0 or user_id % 11 = 0 or user_id % 13 = 0 then null
      else greatest(0e0, least(1e0, k * 1.5e0 / 100e0 - 0.1e0)) end as failure_risk
  from (select *, cast(json_extract_string(props, '$.k') as integer) as k from events)
)"""
