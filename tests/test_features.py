"""Features, splits and profiling."""

import pytest
from pyspark.sql import functions as F

from runsift.constants import POST_RUN_COLUMNS
from runsift.elements import element_table
from runsift.operators import features as X
from runsift.operators import profile as P
from runsift.operators import splits as S

SCHEMA = ("record_id int, failure_reason string, material_id string, ecutwfc string, ecutrho string, kpoints string, "
          "smearing string, mixing_beta string, pseudo_family string, pseudopotentials string")
ROWS = [
    (0, None, "m1", "40", "320", "4 4 2 0 0 0", "mp", "0.4", "PAW", '{"O":"a","Ti":"b"}'),
    (1, "qe_error", "m2", "x", "320", "5 k-points", "", "", None, '{"Zr":"a","H":"b"}'),
    (2, "geometry_overlap", None, "0", None, "", None, None, "", "{oops"),
    (3, "geometry_instability", "m1", "", "", "a b c", "mv", "1e-1", "x", '{"Xx":"a"}'),
]


@pytest.fixture(scope="module")
def rows(spark):
    return {r["record_id"]: r for r in X.build_features(spark.createDataFrame(ROWS, SCHEMA)).collect()}


def test_base_columns(rows):
    r = rows[0]
    assert (r["success"], r["failure_label"], r["failure_taxonomy"], r["elements"]) == (1, "success", "success", "O Ti")
    assert (r["k1"], r["k2"], r["k3"], r["kpoint_product"], r["ecutrho_over_ecutwfc"]) == (4, 4, 2, 32, 8.0)
    assert (rows[1]["k1"], rows[1]["kpoint_product"], rows[1]["ecutwfc"]) == (5, 0, None)
    assert (rows[2]["material_id"], rows[2]["smearing"], rows[2]["elements"], rows[2]["n_species"]) == ("unknown", "unknown", "unknown", 0)
    assert rows[2]["ecutrho_over_ecutwfc"] is None and rows[3]["kpoint_product"] == 0


def test_taxonomy(rows):
    assert [rows[i]["failure_taxonomy"] for i in range(4)] == ["success", "setup_error", "invalid_geometry", "unknown_failure"]


def test_descriptors(rows):
    r = rows[0]
    assert (r["atomic_number_mean"], r["atomic_number_std"], r["atomic_number_min"], r["atomic_number_max"]) == (15.0, 7.0, 8.0, 22.0)
    assert (r["metal_fraction"], r["has_oxygen"], r["has_hydrogen"], r["has_transition_metal"], r["has_heavy_element"]) == (0.5, 1, 0, 1, 0)
    assert (r["element_count_O"], r["element_fraction_Ti"], r["element_fraction_H"]) == (1, 0.5, 0.0)
    # Zr is a transition metal outside the element table: it counts above, not below.
    assert rows[1]["transition_metal_fraction"] == 1.0 and rows[1]["metal_fraction"] == 0.0
    assert rows[3]["atomic_number_mean"] is None and rows[3]["metal_fraction"] is None


def test_no_leakage_and_layout(spark):
    assert not set(X.FEATURES) & set(POST_RUN_COLUMNS) and len(X.FEATURES) == 35 + 62
    with pytest.raises(ValueError, match="energy_ev"):
        X.assert_no_leakage(["ecutwfc", "energy_ev"])
    names = X.feature_sets()
    assert "material_id" not in names["no_material_id_random_split"][1] and names["material_group_split"][0] == "group"
    assert element_table(spark).count() == 31


def test_features_need_no_exchange(spark):
    plan = X.build_features(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchEvalPython" not in plan


def test_splits(spark):
    df = spark.range(1000).select(
        F.col("id").alias("record_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),
        (F.col("id") % 5 == 0).cast("int").alias("y"))
    split = S.stratified_split(df, "y", "record_id")
    assert split.count() == 1000
    share = {r["y"]: r["a"] for r in split.groupBy("y").agg(F.avg("is_test").alias("a")).collect()}
    assert share == {0: 0.2, 1: 0.2}
    groups = S.group_splits(df, "g", 20)
    assert {r["c"] for r in groups.groupBy("split_id").agg(F.sum("is_test").alias("c")).collect()} == {9}
    held = S.group_split(df, "g")
    assert held.groupBy("g").agg(F.countDistinct("is_test").alias("c")).where("c > 1").count() == 0
    again = S.group_splits(df.repartition(5), "g", 20)
    assert sorted(map(tuple, groups.collect())) == sorted(map(tuple, again.collect()))


def test_profile(spark):
    rows = spark.createDataFrame([("a", "40.0", '{"H":1,"O":2}'), ("", "x", "bad"), (None, None, '{"H":1}')],
                                 "smearing string, cut string, pp string")
    assert {(r["value"], r["n"]) for r in P.value_counts(rows, "smearing").collect()} == {("a", 1), ("unknown", 2)}
    assert [r["b"] for r in rows.select(P.numeric_bucket("cut").alias("b")).collect()] == ["40", "unknown", "unknown"]
    assert {r["column_name"]: r["n_missing"] for r in P.missing_counts(rows, ["smearing", "cut"]).collect()} == {"smearing": 2, "cut": 1}
    assert {r["key"]: r["n"] for r in P.key_coverage(rows, "pp").collect()} == {"H": 2, "O": 1}
