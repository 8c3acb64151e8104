"""Ranking laws."""

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from runsift.functions.numeric import general_text
from runsift.operators import near
from runsift.operators import ranking as R
from runsift.schemas import RANKED_CANDIDATE
from runsift.sources.sinks import fixed_columns

SCHEMA = "ordinal long, candidate_id string, predicted_value double, uncertainty double, failure_risk string"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def ranked(df, **kw):
    return sorted(R.rank_candidates(df, **kw).collect(), key=lambda r: r["rank"])


def test_missing_risk_falls_back_to_the_bound(spark):
    rows = ranked(frame(spark, [("a", 1.0, 0.5, None), ("b", 0.0, 0.1, ""), ("c", 2.0, 2.0, "NaN"), ("d", 9.0, 0.0, "bad")]))
    assert [r["candidate_id"] for r in rows] == ["c", "b", "a", "d"]
    assert all(r["risk_flag"] == "missing" and r["failure_penalty"] == 0.0 and r["rank_shift"] == 0 for r in rows)


def test_risk_penalises_but_never_rejects(spark):
    rows = ranked(frame(spark, [("risky", 0.0, 0.0, "7"), ("safe", 0.5, 0.0, "-3")]))
    assert [r["candidate_id"] for r in rows] == ["safe", "risky"]
    assert rows[1]["failure_risk"] == 1.0 and rows[1]["rank_shift"] == -1 and rows[0]["failure_risk"] == 0.0


def test_zero_weight_changes_nothing(spark):
    df = frame(spark, [("a", 0.0, 0.0, "0.9"), ("b", 0.1, 0.0, "0.0")])
    assert R.zero_weight_check(df).first()["equivalent"] == 1
    assert ranked(df, gamma=0.0)[0]["selection_reason"].endswith("gamma=0")


def test_flag_edge(spark):
    rows = {r["candidate_id"]: r["risk_flag"] for r in ranked(frame(spark, [("l", 0.0, 0.0, "0.09"), ("e", 0.0, 0.0, "0.10")]))}
    assert rows == {"l": "low", "e": "elevated"}


def test_ties_keep_the_input_order(spark):
    rows = ranked(frame(spark, [("z", 0.0, 0.0, None), ("a", 0.0, 0.0, None), ("m", 0.0, 0.0, None)]))
    assert [r["candidate_id"] for r in rows] == ["z", "a", "m"]


def test_maximise_reverses(spark):
    rows = ranked(frame(spark, [("a", 1.0, 0.0, "1"), ("b", 0.5, 0.0, "0")]), objective="maximize")
    assert [r["candidate_id"] for r in rows] == ["b", "a"]
    with pytest.raises(ValueError):
        R.rank_candidates(frame(spark, [("a", 0.0, 0.0, None)]), objective="other")


@pytest.mark.parametrize("bad", [-0.1, float("nan")])
def test_bad_uncertainty_fails_the_job(spark, bad):
    with pytest.raises(PySparkException, match="uncertainty must"):
        R.clean_candidates(frame(spark, [("a", 0.0, bad, None)])).collect()


def test_modes(spark):
    df = spark.createDataFrame([(None, "mild"), (0.7, "mild")], "gamma double, gamma_mode string")
    assert sorted(r["resolved_gamma"] for r in R.resolve_gamma(df).collect()) == [0.1, 0.7]
    with pytest.raises(PySparkException, match="unknown gamma mode"):
        R.resolve_gamma(spark.createDataFrame([(None, "wild")], "gamma double, gamma_mode string")).collect()


def test_user_scorers(spark):
    df = frame(spark, [("a", 0.0, 0.0, None), ("b", 3.0, 0.0, None)])

    @F.pandas_udf("double")
    def scorer(v: pd.Series) -> pd.Series:
        return v * 0.5

    got = {r["candidate_id"]: r["failure_risk"] for r in R.apply_risk_scorer(df, scorer("predicted_value")).collect()}
    assert got == {"a": 0.0, "b": 1.0}
    table = spark.createDataFrame([("a", "0.25")], "candidate_id string, failure_risk string")
    joined = R.apply_risk_scorer(df, lambda x: x.drop("failure_risk").join(table, "candidate_id", "left"))
    assert {r["candidate_id"]: r["failure_risk"] for r in joined.collect()} == {"a": 0.25, "b": None}


def test_ranked_layout_and_id_fallback(spark):
    df = spark.createDataFrame([(0, 5, 0.0, 0.0)], "ordinal long, record_id int, predicted_value double, uncertainty double")
    out = R.rank_candidates(df.withColumn("candidate_id", R.fallback_id(df, "ordinal")))
    assert fixed_columns(out, RANKED_CANDIDATE).columns == list(RANKED_CANDIDATE)
    assert out.first()["candidate_id"] == "5"


def test_tolerance_edges(spark):
    known = spark.createDataFrame([("s", 1.0, 2.0)], "system string, p1 double, p2 double")
    points = spark.createDataFrame([
        ("same", "s", 1.0, 2.0), ("near", "s", 1.0 + 9e-7, 2.0 - 9e-7), ("far", "s", 1.0 + 3e-6, 2.0), ("one", "s", 1.0, 2.1),
        ("other", "t", 1.0, 2.0)], "id string, system string, p1 double, p2 double")
    left = near.drop_near_known(points, known, ["p1", "p2"], ["system"])
    assert {r["id"] for r in left.collect()} == {"far", "one", "other"}
    assert {r["id"] for r in near.keep_near_known(points, known, ["p1", "p2"], ["system"]).collect()} == {"same", "near"}
    assert "Cartesian" not in left._jdf.queryExecution().executedPlan().toString()


def test_general_text_matches_python(spark):
    values = [70.0, 0.5, 1234567.0, 1e-5, 0.0, -3.25, 123456.0, 0.0001234, 100000.0, 3.9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits, form in ((6, "g"), (8, ".8g")):
        assert [r["t"] for r in df.select(general_text(F.col("v"), digits).alias("t")).collect()] == [format(v, form) for v in values]


def test_grid_sizes_and_ends(spark):
    systems = spark.createDataFrame([("a", 1, 0.0, 6.0, None, None), ("b", 2, 1.0, 2.0, -1.0, 1.0)],
                                    "system string, dim int, lo1 double, hi1 double, lo2 double, hi2 double")
    rows = R.candidate_grid(systems, 100).collect()
    one, two = ([r for r in rows if r["system"] == s] for s in "ab")
    assert len(one) == 100 and len(two) == 100
    assert {min(r["p1"] for r in one), max(r["p1"] for r in one)} == {0.0, 6.0}
    assert max(r["p2"] for r in two) == 1.0
