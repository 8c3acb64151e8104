"""Pools and replay invariants on 48 candidates in six groups of eight."""

import pytest
from pyspark.sql import functions as F

from runsift import constants as K
from runsift.operators import policy_eval as E
from runsift.operators import pools as P
from runsift.schemas import POLICY_TRIAL


@pytest.fixture(scope="module")
def base(spark):
    i = F.col("id")
    return spark.range(48).select(
        i.alias("candidate_id"), F.concat(F.lit("m"), F.floor(i / 8)).alias("material_id"), (i % 4 == 0).cast("int").alias("true_failure"),
        F.when(i % 4 == 0, 0.8).otherwise(0.02).alias("failure_risk"), F.lit(0.0).alias("predicted_value"),
        (i / 47.0).alias("uncertainty"), F.when(i % 4 != 0, -100.0 + i).alias("known_energy_ev"))


@pytest.fixture(scope="module")
def trials(base):
    return E.replay(P.all_pools(base, 4)).cache()


def test_all_combinations_and_layout(trials):
    assert trials.count() == 4 * 4 * 5 * 3
    assert set(POLICY_TRIAL) == set(trials.columns)


def test_baseline_deltas_are_zero(trials):
    base = trials.where("policy = 'lcb_only'")
    assert base.where("delta_failures_vs_lcb <> 0 or delta_mean_risk_vs_lcb <> 0 or top_k_overlap_with_lcb <> 1 or mean_rank_shift <> 0").count() == 0


def test_penalty_lowers_risk(trials):
    assert trials.where("policy = 'failure_aware_aggressive' and delta_mean_risk_vs_lcb > 1e-12").count() == 0


def test_reproducible(base, trials):
    again = E.replay(P.all_pools(base.repartition(3), 4))
    key = lambda rows: sorted(map(str, (r.asDict() for r in rows)))
    columns = sorted(trials.columns)
    assert key(trials.select(columns).collect()) == key(again.select(columns).collect())


def test_pool_rules(base):
    assert P.normal_pool(base, 2).groupBy("trial_id").count().where("count <> 48").count() == 0
    small = P.draw(base, 3, 42, 5, "candidate_id")
    assert {r["count"] for r in small.groupBy("trial_id").count().collect()} == {5}
    groups = P.group_pool(base, 3, target=10)
    assert {r["count"] for r in groups.groupBy("trial_id").count().collect()} == {16}
    top = P.top_uncertainty_pool(base, 1)
    assert top.count() == 24 and top.agg(F.min("uncertainty")).first()[0] >= 24 / 47.0
    twice = P.draw_with_replacement(base, 2, 42, 100, "candidate_id")
    assert twice.count() == 200 and twice.select("candidate_id").distinct().count() <= 48
    assert P.size_gate(small.withColumn("pool_mode", F.lit("x")), 20).count() == 0


def test_draw_is_exact_when_the_first_bound_is_too_low(base):
    """A population count far above the truth makes the bound too low at first; the loop must widen it."""
    got = {r["candidate_id"] for r in P.draw(base, 1, 42, 30, "candidate_id", population=5000).collect()}
    want = {r["candidate_id"] for r in P.draw(base, 1, 42, 30, "candidate_id").collect()}
    assert got == want and len(got) == 30


def test_one_scan_gives_the_pools_of_the_single_draws(base):
    sizes = P.class_sizes(base)
    together = P.draw_strata(base, [*P._normal(sizes, 7, 42), *P._enriched(sizes, 7, 42), *P._top_uncertainty(base, sizes, 7, 42, "candidate_id"),
                                    P.Stratum("none", F.lit(False), 1, 3, 0)], 3, "candidate_id")
    keys = ["pool_mode", "trial_id", "seed", "draw", "candidate_id"]
    alone = [f(base, 3, size=7) for f in (P.normal_pool, P.enriched_pool, P.top_uncertainty_pool)]
    want = sorted(tuple(r) for part in alone for r in part.select(*keys).collect())
    assert sorted(tuple(r) for r in together.select(*keys).collect()) == want and len(want) == 63


@pytest.mark.parametrize("accuracy", [10_000, 4])
def test_among_first_with_ties_and_nulls(spark, monkeypatch, accuracy):
    monkeypatch.setattr(P, "QUANTILE_ACCURACY", accuracy)
    values = [None, 1.0, 1.0, 1.0, 1.0, 0.5, 0.2, 3.0, None, 0.5]
    frame = spark.createDataFrame(list(enumerate(values)), "k int, v double")
    order = sorted(range(10), key=lambda i: (values[i] is None, -(values[i] or 0.0), i))
    for top in (1, 3, 5, 7, 9, 10):
        got = {r["k"] for r in frame.where(P.among_first(frame, "v", "k", top, 10)).collect()}
        assert got == set(order[:top])


def test_missing_risk_is_zero_and_only_ev_counts(spark):
    predictions = spark.createDataFrame(
        [(1, 0, 0.1, "m", "success", 0, "", 2.0), (1, 1, 0.1, "m", "success", 0, "0.9", 9.0), (2, 0, 0.1, "m", "qe_error", 1, "0.4", 4.0),
         (2, 0, 0.2, "m", "qe_error", 1, "0.4", 4.0)],
        "record_id int, split_id int, threshold double, material_id string, failure_label string, true_failure int, "
        "total_failure_risk string, ood_distance double")
    outcomes = spark.createDataFrame([(1, None, -3.0), (2, -5.0, -1.0)], "record_id int, energy_ev double, final_energy_ry double")
    rows = {r["candidate_id"]: r for r in P.assemble_candidates(predictions, outcomes).collect()}
    assert len(rows) == 2 and rows[1]["failure_risk"] == 0.0 and rows[1]["known_energy_ev"] is None
    assert (rows[1]["uncertainty"], rows[2]["uncertainty"], rows[2]["known_energy_ev"]) == (0.0, 1.0, -5.0)


def test_model_slice(spark):
    rows = spark.createDataFrame([("e", "m", 0.1, i) for i in range(5)] + [("e", "x", 0.1, 9), ("e", "m", 0.2, 8)],
                                 "experiment string, model string, threshold double, record_id int")
    got = P.model_slice(rows, "e", "m", 0.1, 3, [F.col("record_id")]).collect()
    assert [r["record_id"] for r in got] == [0, 1, 2]


def test_zero_span_and_single_trial_spread(spark, trials):
    same = spark.createDataFrame([(1.0,), (1.0,)], "u double")
    assert {r["u"] for r in P.min_max_normalise(same, "u").collect()} == {0.0}
    one = E.summarise(trials.where("trial_id = 0"))
    assert one.where("std_failures_selected <> 0").count() == 0
    assert E.evidence(E.summarise(trials)).count() == 4 and len(K.POLICIES) == 5


def test_rows_of_one_partition_are_hashed_by_more_tasks_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(P, "SPREAD_ROWS", 20)
    base = spark.range(1000).coalesce(1).withColumnRenamed("id", "candidate_id")
    strata = [P.Stratum("m", F.lit(True), 1, 5, 1000)]
    assert P._spread(base, strata, "candidate_id").rdd.getNumPartitions() == 50
    assert P.draw_strata(base, strata, 3, "candidate_id").count() == 15
