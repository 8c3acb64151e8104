"""Sequential choice under a tolerance against the plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from runsift.operators import assemble as A
from runsift.operators import claims as C
from runsift.operators import ranking as R
from runsift.operators.claims import settle_claims

TOL = 1e-6
SCHEMA = "system string, seed_id long, trial int, x double, y double, note string"


def near(p, q):
    return all(a is not None and b is not None and abs(a - b) <= TOL for a, b in zip(p, q, strict=True))


def plain(rows):
    taken, out, seeds = {}, [], set()
    for row in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        system, seed, _, x, y, _ = row
        if (system, seed) in seeds or any(near((x, y), p) for p in taken.get(system, [])):
            continue
        seeds.add((system, seed))
        taken.setdefault(system, []).append((x, y))
        out.append(row)
    return sorted(out, key=str)


@pytest.mark.parametrize("spread", [3, 40])
def test_settle_claims(spark, spread):
    rng = random.Random(spread)
    rows = [(rng.choice(["a", "b", None]), seed, trial, rng.randrange(spread) * 7e-7, rng.choice([0.0, 5e-7, -1.2e-6]), "n")
            for seed in range(60) for trial in range(4)]
    # one system per seed, as the rule is per system
    home = {}
    rows = [(home.setdefault(r[1], r[0]), *r[1:]) for r in rows]
    rows += [("c", 1, 0, None, 0.0, "n"), ("c", 2, 0, None, 0.0, "n"), ("c", 3, 0, float("nan"), 0.0, "n"), ("c", 4, 0, 1.0, 1.0, "n")]
    got = settle_claims(spark.createDataFrame(rows, SCHEMA), ["system"], "seed_id", "trial", ["x", "y"], TOL)
    assert sorted((tuple(r) for r in got.collect() if r["system"] != "c"), key=str) == plain([r for r in rows if r[0] != "c"])
    assert got.where("system = 'c'").count() == 4


def test_settle_nothing(spark):
    assert settle_claims(spark.createDataFrame([], SCHEMA), ["system"], "seed_id", "trial", ["x", "y"]).count() == 0


def test_chain_of_neighbours(spark):
    """Each is near the next: every second one goes, in order."""
    rows = [("a", i, 0, i * 0.9e-6, 0.0, "n") for i in range(9)]
    got = settle_claims(spark.createDataFrame(rows, SCHEMA), ["system"], "seed_id", "trial", ["x", "y"], TOL).collect()
    assert sorted(r["seed_id"] for r in got) == [0, 2, 4, 6, 8]


def test_hot_point_is_taken_once(spark):
    hot = spark.range(20000).select(F.lit("a").alias("system"), F.col("id").alias("seed_id"), F.lit(0).alias("trial"),
                                    F.lit(0.5).alias("x"), F.lit(0.5).alias("y"), F.lit("n").alias("note"))
    (row,) = settle_claims(hot, ["system"], "seed_id", "trial", ["x", "y"]).collect()
    assert row["seed_id"] == 0


def test_query_never_picks_coincident_points(spark):
    points = spark.createDataFrame(
        [("s", 1, 0.5, 0.9), ("s", 2, 0.5 + 4e-7, 0.8), ("s", 3, 0.5, 0.9), ("s", 4, 0.7, 0.6), ("s", 5, 0.1, 0.95), ("s", 6, 0.9, 0.2),
         ("t", 7, 0.5, 0.7)], "system string, point int, p1 double, uncertainty double")
    known = spark.createDataFrame([("s", 0.1 + 5e-7)], "system string, p1 double")
    got = R.high_uncertainty(points, known, "system", ["p1"], "point", threshold=0.5, n=2)
    assert sorted((r["system"], r["point"], r["query_rank"]) for r in got.collect()) == [("s", 1, 1), ("s", 4, 2), ("t", 7, 1)]


def test_seeds_do_not_share_a_label(spark):
    """The later seed moves to its next trial; outcomes are found across a cell edge; a failure is passed over."""
    trials = spark.createDataFrame(
        [("s", 1, 0, 0.5, None), ("s", 1, 1, 0.47, None), ("s", 2, 0, 0.5, None), ("s", 2, 1, 0.47, None), ("s", 2, 2, 0.53, None),
         ("s", 3, 0, 0.5, None), ("t", 4, 0, 0.2, 0.1), ("t", 5, 0, 0.9, 0.1)], "system string, seed_id int, trial int, t1 double, t2 double")
    outcomes = spark.createDataFrame(
        [("s", 0.5 - 9e-7, None, -1.0), ("s", 0.5, None, -3.0), ("s", 0.47, None, None), ("s", 0.53 + 5e-7, 0.0, -2.0),
         ("t", 0.2, 0.1 + 2e-6, -5.0), ("t", 0.9, 0.1, -6.0)], "system string, t1 double, t2 double, energy double")
    got = sorted(map(tuple, A.first_successes(trials, outcomes, "system").select("system", "seed_id", "trial", "energy").collect()))
    assert got == [("s", 1, 0, -3.0), ("s", 2, 2, -2.0), ("t", 5, 0, -6.0)]


def test_options_of_one_partition_are_dealt(spark, monkeypatch):
    """A task sorts the options it holds, so their number per task is bounded."""
    monkeypatch.setattr(C, "CLAIM_ROWS", 40)
    rows = [("s", i, 0, float(i % 60), 0.0, "") for i in range(400)]
    stored, keep = [], C.materialize

    def counted(df):
        out = keep(df)
        stored.append(out.groupBy(F.spark_partition_id()).count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(C, "materialize", counted)
    got = C.settle_claims(spark.createDataFrame(rows, SCHEMA).coalesce(1), ["system"], "seed_id", "trial", ["x", "y"])
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
    assert stored[0] == 400 and stored[1] < 120
