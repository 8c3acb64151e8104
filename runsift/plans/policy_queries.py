"""Candidate pools and policy replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsift import constants as K
from runsift.operators import policy_eval as E
from runsift.operators import pools as P
from runsift.plans.inputs import props_k, table


def _predictions(spark, d):
    """Long predictions from events: each record in two splits, scored at every threshold."""
    events = table(spark, d, "events")
    splits = F.explode(F.array(F.col("event_id") % 4 + 1, F.col("event_id") % 4))
    return events.select(
        F.col("event_id").alias("record_id"), F.col("user_id").cast("string").alias("material_id"),
        F.col("event_type").alias("failure_label"), (F.col("event_type") == "error").cast("int").alias("true_failure"),
        (props_k() / 100.0).alias("risk0"), F.col("value"), splits.alias("split_id"),
    ).select(
        "*", F.explode(F.array(*[F.lit(t) for t in K.RISK_THRESHOLDS])).alias("threshold"),
    ).select(
        "record_id", "material_id", "failure_label", "true_failure", "split_id", "threshold",
        F.when(F.col("record_id") % 17 == 0, "").otherwise((F.col("risk0") / (F.col("split_id") + 1)).cast("string"))
        .alias("total_failure_risk"),
        (F.col("value") * (F.col("split_id") + 1)).alias("ood_distance"))


def _outcomes(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("record_id"),
        F.when(F.col("event_type") != "error", -F.col("value")).alias("energy_ev"),
        (F.col("value") * 3.0).alias("final_energy_ry"))


def pool_assemble(spark, d):
    return P.assemble_candidates(_predictions(spark, d), _outcomes(spark, d))


def _base(spark, d):
    """Natural candidate pool straight from events."""
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("candidate_id"), F.col("user_id").cast("string").alias("material_id"),
        (F.col("event_type") == "error").cast("int").alias("true_failure"),
        (props_k() / 100.0).alias("failure_risk"), F.lit(0.0).alias("predicted_value"),
        F.col("value").alias("uncertainty"),
        F.when(F.col("event_type") != "error", -F.col("value")).alias("known_energy_ev"))
    return P.min_max_normalise(rows, "uncertainty")


def _drawn(pool):
    return pool.select("pool_mode", "trial_id", "seed", "candidate_id", "true_failure")


def pool_normal(spark, d):
    return _drawn(P.normal_pool(_base(spark, d)))


def pool_enriched(spark, d):
    return _drawn(P.enriched_pool(_base(spark, d)))


def pool_group(spark, d):
    return _drawn(P.group_pool(_base(spark, d)))


def pool_top_uncertainty(spark, d):
    return _drawn(P.top_uncertainty_pool(_base(spark, d)))


def pool_replacement(spark, d):
    """Twice as many draws as there are suppliers."""
    base = table(spark, d, "supplier").select(F.col("s_suppkey").alias("candidate_id"), "s_name")
    return P.draw_with_replacement(base, K.TRIALS, K.BASE_SEED, 2 * base.count(), "candidate_id").select(
        "trial_id", "draw", "candidate_id", "s_name")


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _trials(spark, d):
    return E.replay(P.all_pools(_base(spark, d)))


def policy_topk_metrics(spark, d):
    pools = P.all_pools(_base(spark, d))
    return _rounded(E.topk_metrics(E.select_top(pools), E.best_known(pools)),
                    "mean_failure_risk", "mean_acquisition_score", "mean_rank_shift")


def policy_single_trial(spark, d):
    return _rounded(E.single_trial(_base(spark, d)), "mean_failure_risk", "mean_acquisition_score",
                    "mean_rank_shift", "failure_avoidance_rate")


def policy_deltas(spark, d):
    return _rounded(_trials(spark, d), "delta_mean_risk_vs_lcb").select(
        "pool_mode", "trial_id", "policy", "top_k", "delta_failures_vs_lcb", "delta_mean_risk_vs_lcb")


def policy_summary(spark, d):
    out = E.summarise(_trials(spark, d))
    return _rounded(out, *[c for c, t in out.dtypes if t == "double"])


def policy_evidence(spark, d):
    return E.evidence(E.summarise(_trials(spark, d)))


def policy_risk_reduced(spark, d):
    return E.risk_reduced_everywhere(E.evidence(E.summarise(_trials(spark, d))))


def policy_single_verdict(spark, d):
    return _rounded(E.single_trial_verdict(E.single_trial(_base(spark, d))), "mean_failure_risk", "baseline_risk")


def policy_version_compare(spark, d):
    out = E.compare_versions(E.single_trial(_base(spark, d)), E.summarise(_trials(spark, d)))
    return _rounded(out, "old_mean_risk", "new_mean_risk", "mean_failures_selected", "std_failures_selected")


def policy_readout(spark, d):
    return _rounded(E.readout(_trials(spark, d)), "mean_failures_selected", "mean_failure_risk")


QUERIES = {f.__name__: f for f in (
    pool_assemble, pool_normal, pool_enriched, pool_group, pool_top_uncertainty, pool_replacement,
    policy_topk_metrics, policy_single_trial, policy_deltas, policy_summary, policy_evidence, policy_risk_reduced,
    policy_single_verdict, policy_version_compare, policy_readout)}

_BASE = """
b0 as (
  select event_id as candidate_id, cast(user_id as varchar) as material_id,
    case when event_type = 'error' then 1 else 0 end as true_failure,
    cast(json_extract_string(props, '$.k') as integer) / 100e0 as failure_risk, 0e0 as predicted_value,
    (value - min(value) over ()) / (max(value) over () - min(value) over ()) as uncertainty,
    case when event_type <> 'error' then -value end as known_energy_ev
  from events),
trials as (select cast(range as integer) as trial_id from range(50))"""


def _draw_sql(name, source, offset, size, id_column="candidate_id", where="true"):
    return f"""
{name} as (
  select * from (
    select s.*, t.trial_id, t.trial_id + {42 + offset} as seed, row_number() over (partition by t.trial_id
      order by md5(cast(t.trial_id + {42 + offset} as varchar) || '|' || cast(s.{id_column} as varchar)), s.{id_column}) as draw
    from {source} s, trials t where {where})
  where draw <= {size})"""


_NORMAL = _draw_sql("p_normal", "b0", 0, 150)
_ENRICHED = (
    _draw_sql("p_fail", "b0", 10000, "least(90, (select count(*) from b0 where true_failure = 1))", where="s.true_failure = 1")
    + ","
    + _draw_sql("p_pass", "b0", 10000,
                "150 - least(90, (select count(*) from b0 where true_failure = 1))", where="s.true_failure = 0"))
_GROUP = """
gsize as (select material_id, count(*) as n from b0 group by material_id),""" + _draw_sql(
    "gdraw", "gsize", 20000, 150, "material_id") + """,
gpick as (select * from (select *, coalesce(sum(n) over (partition by trial_id order by draw
  rows between unbounded preceding and 1 preceding), 0) as before from gdraw) where before < 150),
p_group as (select b0.*, g.trial_id, g.seed, g.draw from b0 join gpick g on b0.material_id = g.material_id)"""
_TOPU = """
tops as (select * exclude (r) from (select *, row_number() over (order by uncertainty desc, candidate_id) as r from b0)
  where r <= greatest(1, (select count(*) from b0) // 2)),""" + _draw_sql("p_top", "tops", 30000, 150)

_ALL = f"""{_BASE}, {_NORMAL}, {_ENRICHED}, {_GROUP}, {_TOPU},
pools0 as (
  select 'normal_pool' as pool_mode, * from p_normal
  union all by name select 'failure_enriched_pool' as pool_mode, * from p_fail
  union all by name select 'failure_enriched_pool' as pool_mode, * from p_pass
  union all by name select 'heldout_material_pool' as pool_mode, * from p_group
  union all by name select 'high_uncertainty_pool' as pool_mode, * from p_top),
pools as (select * from (select *, count(*) over (partition by pool_mode, trial_id) as n from pools0) where n >= 20)"""


def _select_sql(source, keys, names):
    values = ", ".join(f"('{n}', {0 if g is None else float(g)}e0, {str(g is None).lower()})" for n, g in names.items())
    part = f"partition by {keys}, policy" if keys else "partition by policy"
    base_part = f"partition by {keys} " if keys else ""
    return f"""
pol as (select * from (values {values}) as t(policy, gamma, is_random)),
s1 as (select *, predicted_value - 2e0 * uncertainty as base_lcb_score from {source}),
s2 as (select *, row_number() over ({base_part}order by base_lcb_score, candidate_id) as base_rank from s1),
s3 as (select *, base_lcb_score + gamma * failure_risk as acquisition_score from s2, pol),
s4 as (select *, row_number() over ({part} order by case when is_random then 0e0 else acquisition_score end,
  case when is_random then md5(cast(seed as varchar) || '|' || cast(candidate_id as varchar)) else '' end, candidate_id) as rank from s3),
sel as (select *, case when is_random then 0 else base_rank - rank end as rank_shift from s4, (values (5), (10), (20)) as kk(top_k)
  where rank <= top_k)"""


_TRIALS = f"""{_ALL}, {_select_sql("pools", "pool_mode, trial_id", K.POLICIES)},
best as (select pool_mode, trial_id, arg_min(candidate_id, (known_energy_ev, candidate_id)) as best_id from pools
  where true_failure = 0 and known_energy_ev is not null group by pool_mode, trial_id),
met as (
  select s.pool_mode, s.trial_id, s.seed, s.policy, s.top_k, cast(sum(true_failure) as bigint) as failures_selected,
    cast(sum(1 - true_failure) as bigint) as successes_selected, sum(true_failure) / cast(s.top_k as double) as failure_fraction,
    max(case when best_id is null then null when candidate_id = best_id then 1 else 0 end) as best_known_candidate_found,
    avg(failure_risk) as mean_failure_risk, avg(acquisition_score) as mean_acquisition_score,
    count(*) filter (where base_rank <= s.top_k) / cast(s.top_k as double) as top_k_overlap_with_lcb,
    avg(abs(rank_shift)) as mean_rank_shift
  from sel s left join best b on s.pool_mode = b.pool_mode and s.trial_id = b.trial_id
  group by s.pool_mode, s.trial_id, s.seed, s.policy, s.top_k),
tr as (select *, failures_selected - max(case when policy = 'lcb_only' then failures_selected end) over w as delta_failures_vs_lcb,
    mean_failure_risk - max(case when policy = 'lcb_only' then mean_failure_risk end) over w as delta_mean_risk_vs_lcb
  from met window w as (partition by pool_mode, trial_id, top_k)),
summ as (
  select pool_mode, top_k, policy, count(*) as n_trials, avg(failures_selected) as mean_failures_selected,
    coalesce(stddev_samp(failures_selected), 0) as std_failures_selected, avg(mean_failure_risk) as mean_failure_risk,
    coalesce(stddev_samp(mean_failure_risk), 0) as std_failure_risk, avg(best_known_candidate_found) as best_known_candidate_found_rate,
    avg(delta_failures_vs_lcb) as mean_delta_failures_vs_lcb, coalesce(stddev_samp(delta_failures_vs_lcb), 0) as std_delta_failures_vs_lcb,
    avg(delta_mean_risk_vs_lcb) as mean_delta_risk_vs_lcb, coalesce(stddev_samp(delta_mean_risk_vs_lcb), 0) as std_delta_risk_vs_lcb
  from tr group by pool_mode, top_k, policy),
evid as (
  select pool_mode, n_trials, case when m < 0 and sem > 0 and abs(m) >= sem then 'clear' when m < 0 then 'noisy' else 'absent' end as evidence,
    case when mean_delta_risk_vs_lcb <= 0 then 1 else 0 end as risk_reduced
  from (select *, mean_delta_failures_vs_lcb as m, std_delta_failures_vs_lcb / sqrt(n_trials) as sem from summ
    where policy = 'failure_aware_aggressive' and top_k = 10))"""

_SINGLE = """
{select},
single as (
  select policy, top_k, cast(sum(true_failure) as bigint) as known_failures_selected,
    cast(sum(1 - true_failure) as bigint) as known_successes_selected,
    sum(1 - true_failure) / cast(count(*) as double) as failure_avoidance_rate, avg(failure_risk) as mean_failure_risk,
    avg(acquisition_score) as mean_acquisition_score,
    count(*) filter (where base_rank <= top_k) / cast(top_k as double) as top_k_overlap_with_lcb,
    avg(abs(rank_shift)) as mean_rank_shift,
    arg_min(candidate_id, (known_energy_ev, candidate_id)) filter (where true_failure = 0) as best_candidate_id,
    arg_min(material_id, (known_energy_ev, candidate_id)) filter (where true_failure = 0) as best_candidate_material_id,
    min(known_energy_ev) filter (where true_failure = 0) as best_candidate_energy_ev
  from sel group by policy, top_k)"""
_SINGLE_ONLY = _BASE + ", seeded as (select *, 42 as seed from b0), " + _SINGLE.format(
    select=_select_sql("seeded", "", E.SINGLE_TRIAL_POLICIES))


def _renamed(sql, suffix):
    """The same CTEs under other names, so both replays fit in one statement."""
    for name in ("pol", "s1", "s2", "s3", "s4", "sel"):
        sql = sql.replace(f"\n{name} as", f"\n{name}{suffix} as").replace(f"from {name} ", f"from {name}{suffix} ")
        sql = sql.replace(f"from {name})", f"from {name}{suffix})").replace(f", {name})", f", {name}{suffix})")
        sql = sql.replace(f"from {name},", f"from {name}{suffix},")
    return sql


def _round_all(names, rounded):
    return ", ".join(f"round({n}, 6) + 0e0 as {n}" if n in rounded else n for n in names)


_METRICS = ["pool_mode", "trial_id", "seed", "policy", "top_k", "failures_selected", "successes_selected",
            "failure_fraction", "best_known_candidate_found", "mean_failure_risk", "mean_acquisition_score",
            "top_k_overlap_with_lcb", "mean_rank_shift"]
_SUMMARY = ["mean_failures_selected", "std_failures_selected", "mean_failure_risk", "std_failure_risk",
            "best_known_candidate_found_rate", "mean_delta_failures_vs_lcb", "std_delta_failures_vs_lcb",
            "mean_delta_risk_vs_lcb", "std_delta_risk_vs_lcb"]
_SINGLE_COLS = ["policy", "top_k", "known_failures_selected", "known_successes_selected", "failure_avoidance_rate",
                "mean_failure_risk", "mean_acquisition_score", "top_k_overlap_with_lcb", "mean_rank_shift",
                "best_candidate_id", "best_candidate_material_id", "best_candidate_energy_ev"]
_PICK = "select pool_mode, trial_id, seed, candidate_id, true_failure from"

ORACLES = {
    "pool_assemble": """
with pred as (
  select event_id as record_id, cast(user_id as varchar) as material_id, event_type as failure_label,
    case when event_type = 'error' then 1 else 0 end as true_failure, s.split_id, t.threshold,
    case when event_id % 17 = 0 then null
      else cast(json_extract_string(props, '$.k') as integer) / 100e0 / (s.split_id + 1) end as risk,
    value * (s.split_id + 1) as ood, value
  from events, lateral (select unnest([event_id % 4, event_id % 4 + 1]) as split_id) s,
    (values (0.05e0), (0.10e0), (0.15e0), (0.20e0), (0.25e0), (0.30e0), (0.40e0), (0.50e0)) as t(threshold)),
f as (select * from (select *, row_number() over (partition by record_id order by split_id) as r from pred
  where abs(threshold - 0.10e0) <= 1e-12) where r = 1)
select record_id as candidate_id, material_id, failure_label, true_failure, coalesce(risk, 0e0) as failure_risk,
  0e0 as predicted_value, (ood - min(ood) over ()) / (max(ood) over () - min(ood) over ()) as uncertainty,
  case when failure_label <> 'error' then -value end as known_energy_ev from f""",
    "pool_normal": f"with {_BASE}, {_NORMAL} {_PICK} (select 'normal_pool' as pool_mode, * from p_normal)",
    "pool_enriched": f"""with {_BASE}, {_ENRICHED} {_PICK} (select 'failure_enriched_pool' as pool_mode, * from
  (select * from p_fail union all select * from p_pass))""",
    "pool_group": f"with {_BASE}, {_GROUP} {_PICK} (select 'heldout_material_pool' as pool_mode, * from p_group)",
    "pool_top_uncertainty": f"with {_BASE}, {_TOPU} {_PICK} (select 'high_uncertainty_pool' as pool_mode, * from p_top)",
    "pool_replacement": """
with draws as (select cast(t.range as integer) as trial_id, d.range as draw from range(50) t, range(1, 2 * (select count(*) from supplier) + 1) d),
picks as (select *, cast('0x' || substr(md5(cast(trial_id + 42 as varchar) || '|' || cast(draw as varchar)), 1, 15) as bigint)
  % (select count(*) from supplier) + 1 as rn from draws),
numbered as (select s_suppkey, s_name, row_number() over (order by s_suppkey) as rn from supplier)
select trial_id, draw, s_suppkey as candidate_id, s_name from picks join numbered using (rn)""",
    "policy_topk_metrics": f"with {_TRIALS} select "
    + _round_all(_METRICS, {"mean_failure_risk", "mean_acquisition_score", "mean_rank_shift"}) + " from met",
    "policy_single_trial": f"with {_SINGLE_ONLY} select " + _round_all(
        _SINGLE_COLS, {"failure_avoidance_rate", "mean_failure_risk", "mean_acquisition_score", "mean_rank_shift"})
    + " from single",
    "policy_deltas": f"""with {_TRIALS} select pool_mode, trial_id, policy, top_k, delta_failures_vs_lcb,
  round(delta_mean_risk_vs_lcb, 6) + 0e0 as delta_mean_risk_vs_lcb from tr""",
    "policy_summary": f"with {_TRIALS} select pool_mode, top_k, policy, n_trials, "
    + _round_all(_SUMMARY, set(_SUMMARY)) + " from summ",
    "policy_evidence": f"with {_TRIALS} select * from evid",
    "policy_risk_reduced": f"""with {_TRIALS} select count(*) as n_modes, cast(sum(risk_reduced) as bigint) as n_reduced,
  case when bool_and(risk_reduced = 1) then 1 else 0 end as reduced_in_every_mode from evid""",
    "policy_single_verdict": f"""with {_SINGLE_ONLY}
select s.policy, s.known_failures_selected, b.known_failures_selected as baseline_failures,
  round(s.mean_failure_risk, 6) as mean_failure_risk, round(b.mean_failure_risk, 6) as baseline_risk,
  case when s.known_failures_selected < b.known_failures_selected then 'fewer'
    when s.known_failures_selected > b.known_failures_selected then 'more' else 'equal' end as verdict
from single s join single b on b.policy = 'lcb_only' and b.top_k = 10
where s.top_k = 10 and s.policy like 'failure_aware_lcb%'""",
    "policy_version_compare": f"""with {_TRIALS}, seeded as (select *, 42 as seed from b0),
{_renamed(_SINGLE.format(select=_select_sql("seeded", "", E.SINGLE_TRIAL_POLICIES)), "x")}
select o.policy as policy_old, n.policy as policy_new, o.known_failures_selected as old_failures,
  round(o.mean_failure_risk, 6) as old_mean_risk, round(n.mean_failures_selected, 6) as mean_failures_selected,
  round(n.std_failures_selected, 6) as std_failures_selected, round(n.mean_failure_risk, 6) as new_mean_risk
from single o join summ n on n.pool_mode = 'normal_pool' and n.top_k = 10
  and n.policy = case o.policy when 'lcb_only' then 'lcb_only' when 'failure_aware_lcb_aggressive' then 'failure_aware_aggressive' end
where o.top_k = 10""",
    "policy_readout": f"""with {_TRIALS} select pool_mode, policy, round(avg(failures_selected), 6) as mean_failures_selected,
  round(avg(mean_failure_risk), 6) as mean_failure_risk from tr where top_k = 10 group by pool_mode, policy""",
}
