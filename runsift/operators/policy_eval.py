"""Replay of ranking policies on recorded outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsift import constants as K
from runsift.functions.numeric import ratio
from runsift.functions.order import hash_order, rank_within, top_rows

POOL_KEYS = ("pool_mode", "trial_id")


def select_top(pools: DataFrame, policies: Mapping[str, float | None] = K.POLICIES, k: int = max(K.TOP_K),
               keys: Sequence[str] = POOL_KEYS, key: str = "candidate_id") -> DataFrame:
    """The first k candidates of every pool under every policy.

    The zero-weight order is the base order, so one base rank per pool serves the shift of every
    policy and the overlap with the baseline. Pools of whole groups can be large, hence rank_within.
    """
    scored = pools.withColumn("base_lcb_score", F.col("predicted_value") - F.lit(K.BETA) * F.col("uncertainty"))
    based = rank_within(scored, [F.col("base_lcb_score"), F.col(key)], "base_rank", keys)
    options = F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(0.0 if g is None else float(g)).alias("gamma"),
                 F.lit(g is None).alias("is_random"))
        for p, g in policies.items()])
    wide = based.withColumn("__p", F.explode(options)).select("*", "__p.*").drop("__p")
    wide = wide.withColumn("acquisition_score", F.col("base_lcb_score") + F.col("gamma") * F.col("failure_risk"))
    order = [
        F.when(F.col("is_random"), 0.0).otherwise(F.col("acquisition_score")),
        F.when(F.col("is_random"), hash_order(F.col("seed"), key)).otherwise(""),
        F.col(key),
    ]
    top = top_rows(wide, order, k, "rank", [*keys, "policy"])
    return top.withColumn(
        "rank_shift", F.when(F.col("is_random"), F.lit(0).cast("long")).otherwise(F.col("base_rank") - F.col("rank")))


def _at_each_k(selected: DataFrame, ks: Sequence[int]) -> DataFrame:
    spread = selected.withColumn("top_k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return spread.where(F.col("rank") <= F.col("top_k"))


def _shared_metrics(k: Column) -> list[Column]:
    return [
        F.avg("failure_risk").alias("mean_failure_risk"),
        F.avg("acquisition_score").alias("mean_acquisition_score"),
        (F.count_if(F.col("base_rank") <= k) / F.first(k)).alias("top_k_overlap_with_lcb"),
        F.avg(F.abs("rank_shift")).alias("mean_rank_shift"),
    ]


def best_known(pools: DataFrame, keys: Sequence[str] = POOL_KEYS, key: str = "candidate_id") -> DataFrame:
    """Best successful candidate with a known outcome in each pool."""
    known = (F.col("true_failure") == 0) & F.col("known_energy_ev").isNotNull()
    best = F.min(F.struct("known_energy_ev", key))
    return pools.where(known).groupBy(*keys).agg(best.alias("__b")).select(*keys, F.col(f"__b.{key}").alias("best_id"))


def topk_metrics(selected: DataFrame, best: DataFrame, ks: Sequence[int] = K.TOP_K,
                 keys: Sequence[str] = POOL_KEYS, key: str = "candidate_id") -> DataFrame:
    """One row per pool, policy and k. Failure fraction and overlap divide by k."""
    rows = _at_each_k(selected, ks).join(best, list(keys), "left")
    k = F.col("top_k")
    return rows.groupBy(*keys, "seed", "policy", "top_k").agg(
        F.sum("true_failure").cast("long").alias("failures_selected"),
        F.sum(1 - F.col("true_failure")).cast("long").alias("successes_selected"),
        (F.sum("true_failure") / F.first(k)).alias("failure_fraction"),
        F.max((F.col(key) == F.col("best_id")).cast("int")).alias("best_known_candidate_found"),
        *_shared_metrics(k),
    )


def add_deltas(metrics: DataFrame, keys: Sequence[str] = POOL_KEYS) -> DataFrame:
    """Difference to the baseline policy. Each window holds one row per policy."""
    w = Window.partitionBy(*keys, "top_k")
    base = F.col("policy") == K.BASELINE_POLICY
    return metrics.withColumns({
        "delta_failures_vs_lcb": F.col("failures_selected") - F.max(F.when(base, F.col("failures_selected"))).over(w),
        "delta_mean_risk_vs_lcb": F.col("mean_failure_risk") - F.max(F.when(base, F.col("mean_failure_risk"))).over(w),
    })


def replay(pools: DataFrame) -> DataFrame:
    return add_deltas(topk_metrics(select_top(pools), best_known(pools)))


def _spread(column: str) -> Column:
    """Sample deviation, 0 for a single row."""
    return F.coalesce(F.stddev_samp(column), F.lit(0.0))


def summarise(trials: DataFrame) -> DataFrame:
    return trials.groupBy("pool_mode", "top_k", "policy").agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.avg("failures_selected").alias("mean_failures_selected"),
        _spread("failures_selected").alias("std_failures_selected"),
        F.avg("mean_failure_risk").alias("mean_failure_risk"),
        _spread("mean_failure_risk").alias("std_failure_risk"),
        F.avg("best_known_candidate_found").alias("best_known_candidate_found_rate"),
        F.avg("delta_failures_vs_lcb").alias("mean_delta_failures_vs_lcb"),
        _spread("delta_failures_vs_lcb").alias("std_delta_failures_vs_lcb"),
        F.avg("delta_mean_risk_vs_lcb").alias("mean_delta_risk_vs_lcb"),
        _spread("delta_mean_risk_vs_lcb").alias("std_delta_risk_vs_lcb"),
    )


def evidence(summary: DataFrame, policy: str = "failure_aware_aggressive", k: int = 10) -> DataFrame:
    """Per mode: clear when the mean drop is at least its standard error, noisy when smaller, else absent."""
    rows = summary.where((F.col("policy") == policy) & (F.col("top_k") == k))
    mean, sem = F.col("mean_delta_failures_vs_lcb"), F.col("std_delta_failures_vs_lcb") / F.sqrt("n_trials")
    return rows.select(
        "pool_mode", "n_trials",
        F.when((mean < 0) & (sem > 0) & (F.abs(mean) >= sem), "clear").when(mean < 0, "noisy")
        .otherwise("absent").alias("evidence"),
        (F.col("mean_delta_risk_vs_lcb") <= 0).cast("int").alias("risk_reduced"))


def risk_reduced_everywhere(evidence_rows: DataFrame) -> DataFrame:
    return evidence_rows.agg(
        F.count(F.lit(1)).alias("n_modes"),
        F.sum("risk_reduced").cast("long").alias("n_reduced"),
        F.when(F.bool_and(F.col("risk_reduced") == 1), 1).otherwise(0).alias("reduced_in_every_mode"))


SINGLE_TRIAL_POLICIES = {
    "random_selection": None,
    "lcb_only": 0.0,
    "failure_aware_lcb_mild": 0.1,
    "failure_aware_lcb_balanced": 0.3,
    "failure_aware_lcb_aggressive": 1.0,
}


def single_trial(candidates: DataFrame, ks: Sequence[int] = K.TOP_K, seed: int = K.BASE_SEED,
                 key: str = "candidate_id") -> DataFrame:
    """One replay on the whole pool. The avoidance rate divides by the rows really selected."""
    pool = candidates.withColumn("seed", F.lit(seed))
    rows = _at_each_k(select_top(pool, SINGLE_TRIAL_POLICIES, max(ks), keys=()), ks)
    k = F.col("top_k")
    known = (F.col("true_failure") == 0) & F.col("known_energy_ev").isNotNull()
    best = F.min(F.when(known, F.struct("known_energy_ev", key, "material_id")))
    return rows.groupBy("policy", "top_k").agg(
        F.sum("true_failure").cast("long").alias("known_failures_selected"),
        F.sum(1 - F.col("true_failure")).cast("long").alias("known_successes_selected"),
        ratio(F.sum(1 - F.col("true_failure")), F.count(F.lit(1))).alias("failure_avoidance_rate"),
        *_shared_metrics(k),
        best.alias("__b"),
    ).select("*", F.col(f"__b.{key}").alias("best_candidate_id"),
             F.col("__b.material_id").alias("best_candidate_material_id"),
             F.col("__b.known_energy_ev").alias("best_candidate_energy_ev")).drop("__b")


def single_trial_verdict(rows: DataFrame, k: int = 10) -> DataFrame:
    """Each risk-aware policy against the baseline: fewer, equal or more known failures."""
    at_k = rows.where(F.col("top_k") == k)
    base = at_k.where(F.col("policy") == K.BASELINE_POLICY).select(
        "top_k", F.col("known_failures_selected").alias("baseline_failures"),
        F.col("mean_failure_risk").alias("baseline_risk"))
    own, ref = F.col("known_failures_selected"), F.col("baseline_failures")
    return at_k.where(F.col("policy").startswith("failure_aware_lcb")).join(base, "top_k").select(
        "policy", own, ref, F.col("mean_failure_risk"), "baseline_risk",
        F.when(own < ref, "fewer").when(own > ref, "more").otherwise("equal").alias("verdict"))


VERSION_NAMES = {"lcb_only": "lcb_only", "failure_aware_lcb_aggressive": "failure_aware_aggressive"}


def compare_versions(single: DataFrame, summary: DataFrame, k: int = 10) -> DataFrame:
    """Single-trial rows next to the repeated-trial rows of the matching policy."""
    names = F.create_map(*[F.lit(x) for pair in VERSION_NAMES.items() for x in pair])
    old = single.where(F.col("top_k") == k).withColumn("policy_new", F.try_element_at(names, F.col("policy")))
    old = old.where(F.col("policy_new").isNotNull()).select(
        F.col("policy").alias("policy_old"), "policy_new", F.col("known_failures_selected").alias("old_failures"),
        F.col("mean_failure_risk").alias("old_mean_risk"))
    new = summary.where((F.col("pool_mode") == "normal_pool") & (F.col("top_k") == k)).select(
        F.col("policy").alias("policy_new"), "mean_failures_selected", "std_failures_selected",
        F.col("mean_failure_risk").alias("new_mean_risk"))
    return old.join(new, "policy_new")


def readout(trials: DataFrame, k: int = 10) -> DataFrame:
    return trials.where(F.col("top_k") == k).groupBy("pool_mode", "policy").agg(
        F.avg("failures_selected").alias("mean_failures_selected"),
        F.avg("mean_failure_risk").alias("mean_failure_risk"))
