"""Comparison of results with reference values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift import constants as K
from runsift.functions.numeric import percent_error, ratio
from runsift.functions.order import match_keys


def join_references(dimension: DataFrame, results: DataFrame) -> DataFrame:
    """Every reference key appears; a key without a result gets a placeholder row."""
    joined = dimension.join(results, "key", "left")
    return joined.withColumns({
        "n_iterations": F.coalesce(F.col("n_iterations"), F.lit(0)),
        "converged": F.coalesce(F.col("converged"), F.lit(False)),
    })


def add_errors(rows: DataFrame, params: Sequence[int] = (1, 2)) -> DataFrame:
    """Absolute and percent error of each parameter against the computed reference."""
    out = {}
    for i in params:
        best, ref = F.col(f"best_param{i}"), F.col(f"lit_param{i}")
        out[f"abs_error_param{i}"] = F.abs(best - ref)
        out[f"pct_error_param{i}"] = percent_error(best, ref)
    return rows.withColumns(out)


def _std(column: Column) -> Column:
    """Sample deviation; 0 for one value, null for none."""
    return F.when(F.count(column) > 1, F.stddev_samp(column)).when(F.count(column) == 1, 0.0)


def category_statistics(rows: DataFrame) -> DataFrame:
    """Statistics by category, by dimension and overall, in one grouping-sets aggregate."""
    pbe, exp = F.col("pct_error_param1"), F.col("__exp")
    staged = rows.withColumn("__exp", percent_error(F.col("best_param1"), F.col("exp_param1")))
    grouped = staged.groupingSets([["category"], ["dim"], []], "category", "dim").agg(
        F.grouping("category").alias("__gc"), F.grouping("dim").alias("__gd"),
        F.count(F.lit(1)).alias("n_systems"),
        F.avg(pbe).alias("mean_abs_error_pbe"), _std(pbe).alias("std_abs_error_pbe"), F.max(pbe).alias("max_abs_error_pbe"),
        F.avg(exp).alias("mean_abs_error_exp"), _std(exp).alias("std_abs_error_exp"),
        F.avg("n_calls").alias("mean_n_calls"), _std(F.col("n_calls")).alias("std_n_calls"),
        F.min("n_calls").alias("min_n_calls"), F.max("n_calls").alias("max_n_calls"),
        (F.avg(F.col("converged").cast("int")) * 100.0).alias("pct_converged"),
        F.avg("gp_uncertainty").alias("mean_gp_uncertainty"))
    name = (
        F.when(F.col("__gc") == 0, F.col("category"))
        .when(F.col("__gd") == 0, F.concat(F.lit("Overall "), F.col("dim").cast("string"), F.lit("D")))
        .otherwise("Overall"))
    return grouped.withColumn("category", name).drop("dim", "__gc", "__gd")


def high_errors(rows: DataFrame, limit: float = K.HIGH_ERROR_PERCENT) -> DataFrame:
    return rows.where(F.col("pct_error_param1") > limit).orderBy("category", "key")


def call_savings(rows: DataFrame) -> DataFrame:
    """Calls saved against the full grid."""
    size = F.when(F.col("dim") == 1, K.FULL_GRID_1D).otherwise(K.FULL_GRID_2D)
    return rows.withColumn("grid_size", size).withColumns({
        "savings_abs": F.col("grid_size") - F.col("n_calls"),
        "savings_pct": ratio(F.col("grid_size") - F.col("n_calls"), F.col("grid_size")) * 100.0})


def first_hit(scan: DataFrame, case: str, position: str, value: str, tol: float = K.SURROGATE_TOLERANCE) -> DataFrame:
    """Position of the first value within ``tol`` of the case minimum; the whole grid when there is none."""
    low = scan.groupBy(case).agg(F.min(value).alias("__low"), F.count(F.lit(1)).alias("grid_size"))
    hit = F.min(F.when(F.col(value) <= F.col("__low") + tol, F.col(position)))
    return match_keys(scan, low, [case]).groupBy(case, "grid_size").agg(F.coalesce(hit, F.col("grid_size")).alias("n_to_minimum"))


def mean_savings(rows: DataFrame) -> DataFrame:
    """Mean saving by dimension and overall (null dimension)."""
    return rows.rollup("dim").agg(F.avg("savings_pct").alias("mean_savings_pct"), F.count("savings_pct").alias("n_systems"))


def category_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n_systems"))


def parity_bands(rows: DataFrame) -> DataFrame:
    """Predicted over reference, with the narrowest band it falls in."""
    shift = F.abs(ratio(F.col("best_param1"), F.col("lit_param1")) - 1.0)
    band = F.when(shift <= 0.01, "within_1_percent").when(shift <= 0.02, "within_2_percent").otherwise("outside")
    return rows.where(shift.isNotNull()).withColumn("band", band)


def category_errors(rows: DataFrame) -> DataFrame:
    """Mean error and population deviation per category; no value counts as 0."""
    e = F.col("pct_error_param1")
    return rows.groupBy("category").agg(
        F.coalesce(F.avg(e), F.lit(0.0)).alias("mean_error"), F.coalesce(F.stddev_pop(e), F.lit(0.0)).alias("std_error"))
