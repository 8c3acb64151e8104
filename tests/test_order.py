"""Ordered-data helpers against pandas, with one key that holds a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from runsift.functions.order import quantile_within, rank_within, running_within, top_rows


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    n = 3000
    key = np.where(rng.random(n) < 0.34, "hot", np.char.add("k", rng.integers(0, 40, n).astype(str)))
    return pd.DataFrame({"k": key, "id": np.arange(n), "v": rng.integers(0, 50, n).astype(float)})


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows).repartition(7)


def test_rank_in_key_and_overall(frame, rows):
    order = [F.col("v").desc(), F.col("id")]
    want = rows.sort_values(["v", "id"], ascending=[False, True])
    got = rank_within(frame, order, "r", ["k"]).toPandas().set_index("id")["r"]
    assert (got.sort_index().to_numpy() == (want.groupby("k").cumcount() + 1).sort_index().to_numpy()).all()
    overall = rank_within(frame, order, "r").toPandas().set_index("id")["r"].sort_index()
    expected = pd.Series(np.arange(1, len(want) + 1), index=want["id"]).sort_index()
    assert (overall.to_numpy() == expected.to_numpy()).all()


def test_running_values(frame, rows):
    out = running_within(frame, [F.col("id")], {"s": ("sum", F.col("v")), "m": ("min", F.col("v"))}, ["k"])
    got = out.toPandas().sort_values("id")
    want = rows.sort_values("id")
    assert np.allclose(got["s"], want.groupby("k")["v"].cumsum())
    assert np.allclose(got["m"], want.groupby("k")["v"].cummin())


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    got = rank_within(df, [F.col("v")], "r", ["k"], total="n").collect()
    assert sorted((str(x["k"]), x["v"], x["r"], x["n"]) for x in got) == [("None", 1, 1, 2), ("None", 2, 2, 2), ("a", 3, 1, 1)]
    assert quantile_within(df, "v", 0.5, "q", "v", ["k"]).count() == 2


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_quantile(frame, rows, q):
    got = quantile_within(frame, "v", q, "x", "id", ["k"]).toPandas().set_index("k")["x"].sort_index()
    assert np.allclose(got, rows.groupby("k")["v"].quantile(q).sort_index())
    assert np.isclose(quantile_within(frame, "v", q, "x", "id").first()["x"], rows["v"].quantile(q))


def test_weighted_quantile_counts_copies(spark, frame, rows):
    merged = frame.groupBy("v").agg(F.count("*").alias("w"), F.min("id").alias("id"))
    assert np.isclose(quantile_within(merged, "v", 0.95, "x", "id", weight="w").first()["x"], rows["v"].quantile(0.95))


def test_top_rows_trim_before_the_exchange(frame):
    plan = top_rows(frame, [F.col("v"), F.col("id")], 3, "r", ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
