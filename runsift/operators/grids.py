"""Validation of search results against full grids.

A point of a case is a mixed-radix number: its digit of place k is the step along the k-th scanned variable. Grids are
counted out axis by axis, so no array is longer than one axis, and known points are found by number.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift import constants as K
from runsift.functions.order import top_rows


def compatible_references(variables: DataFrame, references: DataFrame) -> DataFrame:
    """Per case: the spin flag agrees and every variable has a reference value inside its bounds.

    ``variables``: case_id, name, lo, hi, spin. ``references``: case_id, best_params, best_energy, n_calls, spin.
    """
    ref = references.withColumnRenamed("spin", "report_spin")
    value = F.try_element_at("best_params", F.col("name"))
    inside = F.coalesce(value.between(F.col("lo"), F.col("hi")), F.lit(False))
    same_spin = F.col("report_spin").isNull() | (F.col("report_spin") == F.col("spin"))
    checked = variables.join(ref, "case_id", "left").groupBy("case_id").agg(
        F.bool_and(inside & same_spin).alias("compatible"))
    return checked


def axis_value(a: Column, i: Column) -> Column:
    """Value of step ``i`` on an axis of ``n`` evenly spaced values, both ends included."""
    return F.when(i == a["n"] - 1, a["hi"]).otherwise(a["lo"] + i * ((a["hi"] - a["lo"]) / (a["n"] - 1)))


def layouts(cases: DataFrame, variables: DataFrame, references: DataFrame) -> DataFrame:
    """One row per case: case_id, axes (name, lo, hi, n, stride; in scan order) and fixed (key, value).

    Variables that are not scanned sit at the reference best if compatible, else midway. Cases without an axis are left
    out. ``cases``: case_id, scan_variables, points_per_variable.
    """
    n = F.col("points_per_variable").cast("long")
    flagged = variables.join(cases, "case_id").join(compatible_references(variables, references), "case_id").join(
        references.select("case_id", "best_params"), "case_id", "left")
    reference_value = F.when(F.col("compatible"), F.try_element_at("best_params", F.col("name")))
    fixed = F.coalesce(reference_value, (F.col("lo") + F.col("hi")) * 0.5)
    scanned = F.array_contains("scan_variables", F.col("name"))
    order = F.array_position("scan_variables", F.col("name"))
    per_case = flagged.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.when(scanned, F.struct(order.alias("o"), "name", "lo", "hi", n.alias("n"))))).alias("axes"),
        F.collect_list(F.when(~scanned, F.struct(F.col("name").alias("key"), fixed.alias("value")))).alias("fixed"))
    # Points per variable are the same on all axes of a case, so strides are their powers.
    placed = F.transform("axes", lambda a, k: F.struct(
        a["name"].alias("name"), a["lo"].cast("double").alias("lo"), a["hi"].cast("double").alias("hi"), a["n"].alias("n"),
        F.pow(a["n"].cast("double"), k.cast("double")).cast("long").alias("stride")))
    return per_case.where(F.size("axes") > 0).select("case_id", placed.alias("axes"), "fixed")


def expected_points(cases: DataFrame, variables: DataFrame, references: DataFrame) -> DataFrame:
    """Grid of each case: case_id, point_id (long), params. The first scanned variable runs fastest."""
    layout = layouts(cases, variables, references)
    deepest = layout.agg(F.max(F.size("axes"))).first()[0] or 0
    points = layout.withColumn("point_id", F.lit(0).cast("long"))
    for k in range(deepest):
        axis = F.get("axes", F.lit(k))
        steps = F.sequence(F.lit(0).cast("long"), F.coalesce(axis["n"], F.lit(1)) - 1)
        points = points.withColumn("__i", F.explode(steps)).withColumn(
            "point_id", F.col("point_id") + F.col("__i") * F.coalesce(axis["stride"], F.lit(0))).drop("__i")
        if 0 < k < deepest - 1:
            # The points of one large case go on over many tasks.
            points = points.repartition("case_id", "point_id")
    values = F.transform("axes", lambda a: F.struct(
        a["name"].alias("key"), axis_value(a, F.floor(F.col("point_id") / a["stride"]) % a["n"]).alias("value")))
    return points.select("case_id", "point_id", F.map_from_entries(F.concat(values, "fixed")).alias("params"))


def point_numbers(rows: DataFrame, layout: DataFrame) -> DataFrame:
    """The rows whose ``params`` are a point of their case's grid to ten digits, with its ``point_id``.

    The names must be those of the case. On an axis without extent all steps are one place, and the row counts for the
    first of them.
    """
    def value(name: Column) -> Column:
        return F.try_element_at("params", name)

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(F.round(a, 10) == F.round(b, 10), F.lit(False))

    def step(a: Column) -> Column:
        share = F.try_divide(value(a["name"]) - a["lo"], a["hi"] - a["lo"])
        return F.coalesce(F.round(share * (a["n"] - 1)).try_cast("long"), F.lit(0).cast("long"))

    on_axes = F.forall("axes", lambda a: step(a).between(0, a["n"] - 1) & same(axis_value(a, step(a)), value(a["name"])))
    on_rest = F.forall("fixed", lambda f: same(f["value"], value(f["key"])))
    names = F.size("params") == F.size("axes") + F.size("fixed")
    number = F.aggregate("axes", F.lit(0).cast("long"), lambda s, a: s + step(a) * a["stride"])
    return rows.join(layout, "case_id").where(names & on_axes & on_rest).withColumn("point_id", number).drop("axes", "fixed")


def resume(expected: DataFrame, existing: DataFrame, layout: DataFrame, budget: int | None = None) -> DataFrame:
    """Reuse rows that are ok; of the missing points the first ``budget`` per case are due, the rest not run.

    ``layout`` is the table of ``layouts``; known rows are matched by point number.
    """
    done = point_numbers(existing.where(F.col("status") == "ok"), layout).groupBy("case_id", "point_id").agg(
        F.min("energy").alias("energy")).withColumnRenamed("point_id", "__known")
    flat = layout.select("case_id", F.filter("axes", lambda a: a["lo"] == a["hi"]).alias("__flat"))
    # Steps along an axis without extent lie on its first one.
    first = F.col("point_id") - F.aggregate("__flat", F.lit(0).cast("long"), lambda s, a: s + (
        F.floor(F.col("point_id") / a["stride"]) % a["n"]) * a["stride"])
    joined = expected.join(flat, "case_id").withColumn("__known", first).join(done, ["case_id", "__known"], "left").drop(
        "__flat", "__known")
    missing = F.col("energy").isNull()
    if budget is None:
        return joined.withColumn("status", F.when(~missing, "ok").otherwise("due"))
    # Spark trims each task to the budget before the exchange.
    due = top_rows(joined.where(missing).select("case_id", "point_id"), [F.col("point_id")], budget, "__nth", ["case_id"])
    return joined.join(due, ["case_id", "point_id"], "left").withColumn(
        "status", F.when(~missing, "ok").when(F.col("__nth").isNotNull(), "due").otherwise("not_run")).drop("__nth")


def summarise(cases: DataFrame, rows: DataFrame, variables: DataFrame, references: DataFrame) -> DataFrame:
    """Completed points, grid minimum, difference to the reference and status per case."""
    usable = rows.where((F.col("status") == "ok") & F.col("energy").isNotNull())
    best = usable.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("completed"),
        F.min(F.struct("energy", "point_id")).alias("__b"))
    ref = compatible_references(variables, references).join(
        references.select("case_id", "best_energy", "n_calls"), "case_id", "left")
    joined = cases.join(best, "case_id", "left").join(ref, "case_id", "left")
    size = F.pow(F.col("points_per_variable"), F.size("scan_variables")).cast("long")
    reference = F.when(F.col("compatible"), F.col("best_energy"))
    delta = F.abs(F.col("__b.energy") - reference)
    none_done = F.col("completed").isNull()
    status = (
        F.when(none_done & ~F.col("compatible"), "no_compatible_al_reference")
        .when(none_done, "not_run")
        .when(F.col("completed") < size, "incomplete")
        .when(delta.isNull(), "no_compatible_al_reference")
        .when(delta < K.GRID_PASS_DELTA, "pass")
        .otherwise("review"))
    return joined.select(
        "case_id", F.size("scan_variables").alias("dim"), size.alias("grid_points"),
        F.coalesce("completed", F.lit(0).cast("long")).alias("completed_grid_points"), F.col("n_calls"),
        F.col("__b.energy").alias("grid_min_energy"), F.col("__b.point_id").alias("grid_min_point"),
        reference.alias("reference_energy"), delta.alias("delta"), status.alias("pass_fail"))


def enrich(results: DataFrame, summary: DataFrame, key_map: DataFrame) -> DataFrame:
    """Attach complete passes to the result table; ``key_map`` (case_id, key) renames some cases."""
    passed = summary.where((F.col("pass_fail") == "pass") & (F.col("completed_grid_points") == F.col("grid_points")))
    named = passed.join(key_map, "case_id", "left").select(
        F.coalesce("key", "case_id").alias("key"), F.col("pass_fail").alias("direct_grid_status"),
        F.col("grid_points").alias("direct_grid_points"), F.col("completed_grid_points").alias("direct_grid_completed_points"),
        F.col("grid_min_energy").alias("direct_grid_min_energy"), F.col("delta").alias("direct_grid_delta"))
    return results.join(named, "key", "left")


def select_cases(cases: DataFrame, names: Collection[str] | None = None, include_optional: bool = False) -> DataFrame:
    """Named cases, all cases, or the public ones; an unknown name fails the job."""
    if names:
        wanted = cases.sparkSession.createDataFrame([(n,) for n in sorted(names)], "case_id string")
        found = wanted.join(cases.withColumn("__known", F.lit(True)), "case_id", "left")
        unknown = F.raise_error(F.concat(F.lit("Unknown system: "), F.col("case_id"))).cast("boolean")
        return found.where(F.when(F.col("__known"), True).otherwise(unknown)).drop("__known")
    return cases if include_optional else cases.where(F.col("public"))


def gate(summary: DataFrame) -> DataFrame:
    """An empty table or any row that is not a pass fails."""
    rows, bad = F.count(F.lit(1)), F.count_if(F.col("pass_fail") != "pass")
    return summary.agg(rows.alias("n_rows"), bad.alias("n_not_passed"),
                       F.when((rows > 0) & (bad == 0), 1).otherwise(0).alias("passed"))


def preview(expected: DataFrame, variables: DataFrame, references: DataFrame) -> DataFrame:
    """Points, first and last point and compatibility of each case."""
    return expected.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.min_by("params", "point_id").alias("first_point"),
        F.max_by("params", "point_id").alias("last_point")).join(compatible_references(variables, references), "case_id")
