"""Assembly, grids, gates, review batches and comparison rules on small written tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from runsift.operators import assemble as A
from runsift.operators import compare as C
from runsift.operators import grids as G
from runsift.operators import metrics as M
from runsift.operators import quality as Q
from runsift.operators import review as V
from runsift.schemas import REVIEW_BATCH


def test_overlap_screen_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for s in range(60):
        box = [rng.uniform(0.3, 4.0) if rng.random() < 0.7 else None for _ in range(3)]
        n = int(rng.integers(1, 7))
        pos = rng.uniform(-3, 3, (n, 3))
        if s % 7 == 0 and n > 1:
            pos[1] = pos[0]
        close = False
        for i in range(n):
            for j in range(i):
                gap = pos[i] - pos[j]
                for a, length in enumerate(box):
                    if length is not None:
                        gap[a] -= length * round(gap[a] / length)
                close = close or float(np.sqrt((gap ** 2).sum())) < 0.25
        want[s] = int(not close)
        rows += [(s, *map(float, p), *box) for p in pos]
    df = spark.createDataFrame(rows, "s int, x double, y double, z double, lx double, ly double, lz double")
    got = {r["s"]: r["valid"] for r in A.overlap_screen(df, "s").collect()}
    assert got == want and 0 < sum(want.values()) < 60


def test_overlap_screen_hot_structure(spark):
    """Many members on one spot are counted, not paired; 0.62 apart is fine."""
    hot = spark.range(20000).select(F.lit(1).alias("s"), *[F.lit(0.5).alias(a) for a in "xyz"])
    pair = spark.createDataFrame([(2, 0.0, 0.0, 0.0), (2, 0.62, 0.0, 0.0)], "s int, x double, y double, z double")
    both = hot.unionByName(pair).withColumns({f"l{a}": F.lit(None).cast("double") for a in "xyz"})
    assert {r["s"]: r["valid"] for r in A.overlap_screen(both, "s").collect()} == {1: 0, 2: 1}


def test_merge_batch_skips_near_and_null(spark):
    """In batch order: the first of two close results stays, whatever its value."""
    labels = spark.createDataFrame([("s", 1.0, -1.0)], "system string, p1 double, energy double")
    batch = spark.createDataFrame(
        [("s", 1.0 + 5e-7, -9.0, 0), ("s", 2.0, None, 1), ("s", 3.0, -3.0, 2), ("s", 3.0, -4.0, 3), ("t", 1.0, -2.0, 4),
         ("s", 0.5000004, -5.0, 5), ("s", 0.5000006, -6.0, 6), ("s", 0.5000016, -7.0, 7)],
        "system string, p1 double, energy double, position int")
    got = sorted(map(tuple, A.merge_batch(labels, batch, ["p1"], ["system"], ["position"]).collect()))
    assert got == [("s", 0.5000004, -5.0), ("s", 0.5000016, -7.0), ("s", 1.0, -1.0), ("s", 3.0, -3.0), ("t", 1.0, -2.0)]


def test_referenced_value_per_member(spark):
    totals = spark.createDataFrame([("a", -10.0, 4, True), ("b", -10.0, 4, False)], "k string, total double, n_members int, per_member boolean")
    refs = spark.createDataFrame([("a", -1.0), ("a", -1.0)], "k string, energy double")
    assert {r["k"]: r["value"] for r in A.referenced_values(totals, refs, "k").collect()} == {"a": -2.0, "b": -10.0}


def _case(spark):
    cases = spark.createDataFrame([("c", ["x"], 3, True), ("d", ["x", "y"], 2, False)],
                                  "case_id string, scan_variables array<string>, points_per_variable int, public boolean")
    variables = spark.createDataFrame(
        [("c", "x", 0.0, 1.0, False), ("c", "w", 0.0, 4.0, False), ("d", "x", 0.0, 1.0, False), ("d", "y", 5.0, 6.0, False)],
        "case_id string, name string, lo double, hi double, spin boolean")
    refs = spark.createDataFrame([("c", {"x": 0.5, "w": 3.0}, -1.0, 6, None), ("d", {"x": 0.5}, -1.0, 4, False)],
                                 "case_id string, best_params map<string,double>, best_energy double, n_calls int, spin boolean")
    return cases, variables, refs


def test_grid_points_and_order(spark):
    cases, variables, refs = _case(spark)
    rows = {(r["case_id"], r["point_id"]): r["params"] for r in G.expected_points(cases, variables, refs).collect()}
    assert rows[("c", 1)] == {"x": 0.5, "w": 3.0} and rows[("d", 1)] == {"x": 1.0, "y": 5.0} and rows[("d", 2)] == {"x": 0.0, "y": 6.0}


@pytest.mark.parametrize("energy, extra, status", [
    (-1.0005, 2, "pass"), (-1.5, 2, "review"), (-1.0005, 1, "incomplete")])
def test_grid_status(spark, energy, extra, status):
    cases, variables, refs = _case(spark)
    done = [("c", {"x": 0.5, "w": 3.0}, energy, "ok")] + [("c", {"x": v, "w": 3.0}, 0.0, "ok") for v in (0.0, 1.0)[:extra]]
    existing = spark.createDataFrame(done, "case_id string, params map<string,double>, energy double, status string")
    points = G.resume(G.expected_points(cases, variables, refs), existing, G.layouts(cases, variables, refs), budget=1)
    got = {r["case_id"]: r for r in G.summarise(cases, points, variables, refs).collect()}
    assert got["c"]["pass_fail"] == status and got["d"]["pass_fail"] == "no_compatible_al_reference"
    assert points.where("case_id = 'd' and status = 'due'").count() == 1
    only = G.summarise(cases, points, variables, refs).where("case_id = 'c'")
    assert G.gate(only).first()["passed"] == int(status == "pass")


def test_gate_and_case_selection(spark):
    cases, _, _ = _case(spark)
    empty = spark.createDataFrame([], "pass_fail string")
    assert G.gate(empty).first()["passed"] == 0
    assert [r["case_id"] for r in G.select_cases(cases).collect()] == ["c"] and G.select_cases(cases, include_optional=True).count() == 2
    assert G.select_cases(cases, ["d"]).first()["case_id"] == "d"
    with pytest.raises(PySparkException, match="Unknown system"):
        G.select_cases(cases, ["zz"]).collect()


def test_quality_verdict(spark):
    rows = spark.createDataFrame([("a", "m", 2, 5, 1.0), ("b", "m", 2, -1, 20.0), ("c", "n", 1, None, 90.0)],
                                 "key string, category string, dim int, savings_abs int, pct_error_param1 double")
    out = Q.verdict([
        (rows, [Q.row_count("rows", 3), Q.required_columns("cols", ["key", "category"]), Q.enough_savings("saves")]),
        (rows, [Q.category_error("error", ["m"]), Q.category_error("none", ["q"]), Q.row_count("same", rows)])])
    got = {r["check_name"]: r["passed"] for r in out.collect()}
    assert got == {"rows": 1, "cols": 1, "saves": 0, "error": 0, "none": 1, "same": 1, "overall": 0}
    assert {r["check_name"]: r["measured"] for r in out.collect()}["overall"] == 2.0


def _systems(spark, seed):
    return spark.createDataFrame([("m", "key_m", "", [("a", 1.0, 3.0, [seed])], {"Si": "Si.upf", "C": "C.upf"}, "here", 40)],
                                 "module string, key string, family string, variables array<struct<name:string,lo:double,hi:double,"
                                 "seeds:array<double>>>, species map<string,string>, source string, ecutwfc int")


def test_review_batch(spark):
    plan = spark.createDataFrame([(0, "m", "exploitation", "why", [0.25]), (1, "m", "diversity", "why", [0.75])],
                                 "position int, module string, category string, reason string, fractions array<double>")
    rows = V.build_batch(plan, _systems(spark, 2.9), ["ecutwfc"]).orderBy("candidate_id").collect()
    assert tuple(rows[0].asDict()) == REVIEW_BATCH
    assert [r["candidate_id"] for r in rows] == ["dryrun_m_1", "dryrun_m_2"] and rows[0]["candidate_variables"] == "a=1.5000"
    assert (rows[0]["formula_composition"], rows[0]["material_family"], rows[0]["status"]) == ("C,Si", "not_computed", "dry_run_only")
    with pytest.raises(PySparkException, match="known seed"):
        V.build_batch(plan, _systems(spark, 1.5), ["ecutwfc"]).collect()
    with pytest.raises(ValueError):
        V.check_columns([*REVIEW_BATCH, "true_failure"])


def test_statistics_rules(spark):
    rows = spark.createDataFrame([("k1", "m", 1, 10.0, 10.0, None, 4, True, 0.1), ("k2", "m", 1, 11.0, 0.0, 10.0, None, False, None)],
                                 "key string, category string, dim int, best_param1 double, lit_param1 double, exp_param1 double, "
                                 "n_calls int, converged boolean, gp_uncertainty double")
    staged = C.add_errors(rows, params=(1,))
    got = {r["category"]: r for r in C.category_statistics(staged).collect()}
    assert set(got) == {"m", "Overall 1D", "Overall"}
    assert (got["m"]["mean_abs_error_pbe"], got["m"]["std_abs_error_pbe"], got["m"]["pct_converged"]) == (0.0, 0.0, 50.0)
    assert got["m"]["mean_abs_error_exp"] == pytest.approx(10.0)
    missing = C.join_references(spark.createDataFrame([("z", 1)], "key string, dim int"),
                                spark.createDataFrame([("q", 3, True)], "key string, n_iterations int, converged boolean")).first()
    assert (missing["n_iterations"], missing["converged"]) == (0, False)


def test_area_and_diagnosis(spark):
    frame = pd.DataFrame({"s": [0] * 6 + [1] * 2, "id": range(8), "y": [0, 1, 0, 1, 1, 0, 1, 1], "r": [.1, .9, .5, .5, .2, .2, .01, .02]})
    df = spark.createDataFrame(frame)
    area = {r["s"]: r["roc_auc"] for r in M.roc_auc(df, "y", "r", ["s"]).collect()}
    assert area[0] == pytest.approx(6.0 / 9.0 + 1.0 / 9.0) and area[1] is None
    says = {r["s"]: r["diagnosis"] for r in M.risk_diagnosis(df, "y", "r", "id", ["s"]).collect()}
    assert says == {0: "threshold_selection", 1: "feature_or_data"}
    sweep = M.threshold_sweep(df, ["s"], "y", "r", [0.5]).orderBy("s").collect()
    assert (sweep[0]["tn"], sweep[0]["fp"], sweep[0]["fn"], sweep[0]["tp"], sweep[1]["precision"]) == (2, 1, 1, 2, 0.0)


def test_cells_of_one_partition_are_counted_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(A, "PLACED_ROWS", 50)
    stored, keep = [], A.materialize

    def counted(df):
        out = keep(df)
        stored.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(A, "materialize", counted)
    rng = np.random.default_rng(8)
    frame = pd.DataFrame(rng.uniform(0, 30, size=(2000, 3)), columns=list("xyz")).assign(s=np.arange(2000) % 400, lx=9.0, ly=9.0, lz=9.0)
    assert A.overlap_screen(spark.createDataFrame(frame).coalesce(1), "s").count() == 400
    assert stored[0] >= 40
