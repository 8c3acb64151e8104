"""No limit of the library changes what it returns."""

import pytest
from pyspark.errors import PySparkException

from runsift.operators import grids, ranking, reports


def test_three_scanned_axes(spark):
    cases = spark.createDataFrame([("c", ["x", "y", "z"], 3)], "case_id string, scan_variables array<string>, points_per_variable int")
    variables = spark.createDataFrame(
        [("c", n, 0.0, 2.0, False) for n in "xyzw"], "case_id string, name string, lo double, hi double, spin boolean")
    references = spark.createDataFrame([("c", {"x": 1.0}, None)],
                                       "case_id string, best_params map<string,double>, spin boolean")
    points = grids.expected_points(cases, variables, references).orderBy("point_id").collect()
    assert len(points) == 27
    assert len({tuple(sorted(p["params"].items())) for p in points}) == 27
    assert [p["params"]["x"] for p in points[:3]] == [0.0, 1.0, 2.0]


def test_four_scanned_axes_are_resumed_by_number(spark):
    cases = spark.createDataFrame([("c", ["x", "y", "z", "f"], 5)], "case_id string, scan_variables array<string>, points_per_variable int")
    variables = spark.createDataFrame(
        [("c", n, -1.0, 2.0, False) for n in "xyz"] + [("c", "f", 3.0, 3.0, False), ("c", "w", 0.0, 2.0, False)],
        "case_id string, name string, lo double, hi double, spin boolean")
    references = spark.createDataFrame([("c", {"x": 1.0}, None)], "case_id string, best_params map<string,double>, spin boolean")
    points = grids.expected_points(cases, variables, references)
    at = {r["point_id"]: r["params"] for r in points.collect()}
    assert sorted(at) == list(range(625))
    assert at[1 + 2 * 5 + 3 * 25 + 4 * 125] == {"x": -0.25, "y": 0.5, "z": 1.25, "f": 3.0, "w": 1.0}
    known = [("c", at[137], 1.0, "ok"), ("c", {**at[138], "x": at[138]["x"] + 2e-11}, 2.0, "ok"), ("c", {**at[139], "x": 0.3}, 3.0, "ok"),
             ("c", {k: v for k, v in at[140].items() if k != "w"}, 4.0, "ok"), ("c", at[141], 5.0, "failed"), ("c", {**at[142], "w": None}, 6.0, "ok"),
             ("c", {**at[143], "more": 1.0}, 7.0, "ok"), ("gone", at[144], 8.0, "ok")]
    existing = spark.createDataFrame(known, "case_id string, params map<string,double>, energy double, status string")
    got = grids.resume(points, existing, grids.layouts(cases, variables, references), budget=7).collect()
    # The axis f has no extent, so five numbers share the place of each known point.
    assert {r["point_id"] for r in got if r["energy"] == 1.0} == {137 % 125 + 125 * i for i in range(5)}
    assert {r["energy"] for r in got} == {None, 1.0, 2.0} and len(got) == 625
    assert sorted(r["point_id"] for r in got if r["status"] == "due") == list(range(7))


def test_two_points_per_variable_and_one(spark):
    cases = spark.createDataFrame([("a", ["x"], 1), ("b", ["x", "y"], 2), ("c", [], 3)],
                                  "case_id string, scan_variables array<string>, points_per_variable int")
    variables = spark.createDataFrame([(c, n, 0.0, 4.0, False) for c in "abc" for n in "xy"],
                                      "case_id string, name string, lo double, hi double, spin boolean")
    references = spark.createDataFrame([], "case_id string, best_params map<string,double>, spin boolean")
    rows = grids.expected_points(cases, variables, references).orderBy("case_id", "point_id").collect()
    assert [(r["case_id"], r["params"]["x"], r["params"]["y"]) for r in rows] == [
        ("a", 4.0, 2.0), ("b", 0.0, 0.0), ("b", 4.0, 0.0), ("b", 0.0, 4.0), ("b", 4.0, 4.0)]


@pytest.mark.parametrize("mean, sigma", [(None, 0.1), (1.0, None), (float("nan"), 0.1)])
def test_missing_scores_fail(spark, mean, sigma):
    frame = spark.createDataFrame([(1, mean, sigma)], "candidate_id long, predicted_value double, uncertainty double")
    with pytest.raises(PySparkException):
        ranking.clean_candidates(frame).collect()


def test_long_trace_is_read_to_its_end(spark):
    from pyspark.sql import functions as F

    trace = spark.range(30).select(F.lit("s").alias("key"), "id", F.lit(9.0).alias("std"), F.lit(9.0).alias("imp"))
    row = reports.convergence_points(trace, "key", [F.col("id")], "std", "imp").first()
    assert (row["stop_iteration"], row["converged"]) == (30, 0)
