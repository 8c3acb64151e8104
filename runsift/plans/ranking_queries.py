"""Ranking family."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsift import constants as K
from runsift.functions.numeric import to_double
from runsift.functions.order import match_keys
from runsift.operators import ranking as R
from runsift.operators.near import drop_near_known
from runsift.plans.inputs import CANDIDATES_SQL, candidates, table

TOP = 25
KERNEL_LENGTH = 5.0


def _ranked_columns(df):
    return df.select(
        "candidate_id", "material_id", "failure_risk", "base_lcb_score", "failure_penalty",
        "acquisition_score", "risk_flag", "selection_reason", "rank", "rank_without_failure_risk", "rank_shift")


def rank_lcb_topk(spark, d):
    top = R.top_candidates(candidates(spark, d), TOP)
    return top.select("candidate_id", "material_id", "failure_risk", "base_lcb_score", "failure_penalty",
                      "acquisition_score", "risk_flag", "selection_reason", "rank")


def rank_soft_penalty_min(spark, d):
    return _ranked_columns(R.rank_candidates(candidates(spark, d)))


def rank_soft_penalty_max(spark, d):
    return _ranked_columns(R.rank_candidates(candidates(spark, d), keys=["failure_label"], objective="maximize",
                                             beta=1.0, gamma=0.5))


def _observed(spark, d):
    return table(spark, d, "part").select(
        F.col("p_brand").alias("system"), F.col("p_partkey").alias("point"),
        F.col("p_size").cast("double").alias("x1"), ((F.col("p_partkey") % 50) / 10.0).alias("x2"),
        (F.col("p_retailprice") / 100.0).alias("y"))


def rank_target_match(spark, d):
    """Reachable target per brand, the observed point nearest to it, and the best observed point."""
    seen = _observed(spark, d)
    target = R.reachable_target(seen, "system", "y", 10.0)
    joined = seen.join(target, "system")
    score = R.target_match(F.col("y"), F.col("x1") / 100.0, F.col("target"))
    best = joined.groupBy("system", "target").agg(
        F.max(F.struct(score.alias("score"), (-F.col("point")).alias("neg"))).alias("b")).select(
        "system", "target", F.col("b.score").alias("best_score"), (-F.col("b.neg")).alias("best_match"))
    return best.join(R.nearest_to_target(joined, "system", "y", "point", "target"), "system").join(
        R.best_observed(seen, "system", "y", "point"), "system")


def rank_weight_sweep(spark, d):
    swept = R.sweep_weights(candidates(spark, d), R.named_weights())
    return swept.select("mode", "gamma", "candidate_id", "rank", "rank_without_failure_risk", "rank_shift",
                        "acquisition_score")


def sweep_readout(spark, d):
    swept = R.sweep_weights(candidates(spark, d), R.penalty_weights())
    out = R.sweep_readout(swept, F.col("true_failure") == 1)
    return out.withColumn("mean_top_risk", F.round("mean_top_risk", 6))


def rank_mode_resolution(spark, d):
    """Weight per candidate: explicit for some rows, by named mode for the rest."""
    modes = F.element_at(F.array(*[F.lit(m) for m in K.GAMMA_MODES]), (F.col("candidate_id") % 3 + 1).cast("int"))
    df = candidates(spark, d).withColumn("gamma_mode", modes).withColumn(
        "gamma", F.when(F.col("candidate_id") % 5 == 0, F.lit(0.75)))
    resolved = R.resolve_gamma(df)
    scored = R.score_candidates(R.clean_candidates(resolved), gamma=F.col("resolved_gamma"))
    return scored.select("candidate_id", "resolved_gamma", "failure_penalty", "acquisition_score")


def rank_zero_weight_equivalence(spark, d):
    return R.zero_weight_check(candidates(spark, d))


def rank_grid_fallback(spark, d):
    return R.rank_with_fallback(candidates(spark, d), "material_id").select(
        "material_id", "candidate_id", F.col("has_risk").cast("int").alias("has_risk"),
        "acquisition_score", "selection_reason", "rank", "rank_without_failure_risk")


def _points(spark, d):
    return candidates(spark, d).select(
        F.col("failure_label").alias("system"), F.col("candidate_id").alias("point"),
        (F.col("predicted_value") / 3.0).alias("p1"), "uncertainty")


def _known_points(spark, d):
    # A third of the known points sits half a tolerance away, a third two tolerances away.
    part = table(spark, d, "part")
    nudge = F.element_at(F.array(F.lit(0.0), F.lit(5e-7), F.lit(2e-6)), (F.col("p_partkey") % 3 + 1).cast("int"))
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("view", "click", "error", "signup")]),
                         (F.col("p_partkey") % 4 + 1).cast("int"))
    return part.select(kinds.alias("system"), ((F.col("p_size") - 25) / 10.0 / 3.0 + nudge).alias("p1"))


def query_high_uncertainty(spark, d):
    return R.high_uncertainty(_points(spark, d), _known_points(spark, d), "system", ["p1"], "point",
                              threshold=0.5, n=40).select("system", "point", "uncertainty", "query_rank")


def tolerance_antijoin(spark, d):
    return drop_near_known(_points(spark, d), _known_points(spark, d), ["p1"], ["system"]).select(
        "system", "point", "p1")


def _systems(spark, d):
    number = F.regexp_extract("system", r"(\d+)", 1).cast("int")
    return _observed(spark, d).groupBy("system").agg(
        F.min("x1").alias("lo1"), F.max("x1").alias("hi1"), F.min("x2").alias("lo2"), F.max("x2").alias("hi2"),
    ).withColumn("dim", F.when(number % 2 == 0, 2).otherwise(1))


def grid_generate(spark, d):
    return R.candidate_grid(_systems(spark, d)).select(
        "system", "dim", "point_id", F.round("p1", 9).alias("p1"), F.round("p2", 9).alias("p2"))


def grid_kernel_score(spark, d):
    return R.grid_kernel_scores(_systems(spark, d), _observed(spark, d), "system", KERNEL_LENGTH).select(
        "system", "point_id", F.round("predicted_value", 6).alias("predicted_value"),
        F.round("uncertainty", 6).alias("uncertainty"))


def grid_proposal(spark, d):
    scored = R.grid_kernel_scores(_systems(spark, d), _observed(spark, d), "system", KERNEL_LENGTH)
    steady = scored.withColumns({c: F.round(c, 6) for c in ("predicted_value", "uncertainty")})
    return R.grid_proposal(steady, "system").select(
        "system", "point_id", F.round("score", 5).alias("score"),
        F.round("predicted_improvement", 5).alias("predicted_improvement"))


def candidate_ids(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", R.parameter_id("p_retailprice", "p_size").alias("candidate_id"))


def candidate_fallback_ids(spark, d):
    """Each quarter of the parts has another identifier, the last none but its position."""
    kind, key = F.col("p_partkey") % 4, F.col("p_partkey")
    rows = table(spark, d, "part").select(
        key.alias("ordinal"), F.when(kind == 0, F.concat(F.lit("c"), key)).alias("candidate_id"),
        F.when(kind <= 1, F.col("p_size")).alias("id"), F.when(kind <= 2, F.col("p_brand")).alias("record_id"))
    return rows.select("ordinal", R.fallback_id(rows, "ordinal").alias("candidate_id"))


def rank_risk_bounds(spark, d):
    """Both penalised bounds of every candidate; without a risk there is no penalised bound."""
    mean, std, risk = F.col("predicted_value"), F.col("uncertainty"), to_double(F.col("failure_risk"))
    known = F.when(~F.isnan(risk), risk)
    return candidates(spark, d).select(
        "candidate_id", R.penalised_minimum(mean, std, known, 2.0, 0.5).alias("lower"),
        R.penalised_maximum(mean, std, known, 1.0, 0.25).alias("upper"))


def rank_external_scorer(spark, d):
    """Risk from a scorer that joins the recorded share of failures of each user on."""
    def scorer(df):
        shares = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("material_id")).agg(
            F.avg((F.col("event_type") == "error").cast("int")).alias("failure_risk"))
        return match_keys(df.drop("failure_risk"), shares, ["material_id"])

    return _ranked_columns(R.rank_candidates(R.apply_risk_scorer(candidates(spark, d), scorer), gamma=0.3))


QUERIES = {f.__name__: f for f in (
    rank_lcb_topk, rank_soft_penalty_min, rank_soft_penalty_max, rank_target_match, rank_weight_sweep,
    sweep_readout, rank_mode_resolution, rank_zero_weight_equivalence, rank_grid_fallback,
    query_high_uncertainty, tolerance_antijoin, grid_generate, grid_kernel_score, grid_proposal, candidate_ids,
    candidate_fallback_ids, rank_risk_bounds, rank_external_scorer)}


def _scored_sql(gamma="1e0", beta="2e0", sign="+"):
    base = f"predicted_value {'-' if sign == '+' else '+'} {beta} * uncertainty"
    return f"""
scored as (
  select *, {base} as base_lcb_score, coalesce({gamma} * failure_risk, 0e0) as failure_penalty,
    {base} {sign} coalesce({gamma} * failure_risk, 0e0) as acquisition_score,
    case when failure_risk is null then 'missing' when failure_risk >= 0.10e0 then 'elevated' else 'low' end as risk_flag,
    case when failure_risk is null then 'ranked by original LCB; failure_risk missing'
      when {gamma} = 0 then 'ranked by original LCB; gamma=0'
      else 'ranked by failure-aware LCB soft penalty' end as selection_reason
  from cand
)"""


def _ranks(keys="", direction="asc"):
    part = f"partition by {keys} " if keys else ""
    return f"""row_number() over ({part}order by acquisition_score {direction}, candidate_id) as rank,
    row_number() over ({part}order by base_lcb_score {direction}, candidate_id) as rank_without_failure_risk"""


_COLS = """candidate_id, material_id, failure_risk, base_lcb_score, failure_penalty, acquisition_score,
  risk_flag, selection_reason, rank, rank_without_failure_risk, rank_without_failure_risk - rank as rank_shift"""

_OBSERVED = """
obs as (select p_brand as system, p_partkey as point, cast(p_size as double) as x1, (p_partkey % 50) / 10e0 as x2,
  p_retailprice / 100e0 as y from part)"""

_POINTS = CANDIDATES_SQL + """,
pts as (select failure_label as system, candidate_id as point, predicted_value / 3e0 as p1, uncertainty from cand),
known as (select list_extract(['view', 'click', 'error', 'signup'], cast(p_partkey % 4 + 1 as integer)) as system,
  (p_size - 25) / 10e0 / 3e0 + list_extract([0e0, 5e-7, 2e-6], cast(p_partkey % 3 + 1 as integer)) as p1 from part),
fresh as (select * from pts where not exists (
  select 1 from known where known.system = pts.system and abs(known.p1 - pts.p1) <= 1e-6))"""

_GRID = _OBSERVED + """,
sys as (select system, min(x1) as lo1, max(x1) as hi1, min(x2) as lo2, max(x2) as hi2,
  case when cast(regexp_extract(system, '(\\d+)', 1) as integer) % 2 = 0 then 2 else 1 end as dim from obs group by system),
grid as (
  select system, dim, i as point_id, case when i = 60 then hi1 else lo1 + i * ((hi1 - lo1) / 60) end as p1,
    cast(null as double) as p2 from sys, (select cast(range as integer) as i from range(61)) where dim = 1
  union all
  select system, dim, j * 7 + i, case when i = 6 then hi1 else lo1 + i * ((hi1 - lo1) / 6) end,
    case when j = 6 then hi2 else lo2 + j * ((hi2 - lo2) / 6) end
  from sys, (select cast(range as integer) as i from range(7)), (select cast(range as integer) as j from range(7)) where dim = 2
)"""

_KERNEL = _GRID + """,
pairs as (
  select g.system, g.point_id, o.y, exp(-((g.p1 - o.x1) * (g.p1 - o.x1)
    + coalesce((g.p2 - o.x2) * (g.p2 - o.x2), 0)) / 50e0) as k
  from grid g join obs o on g.system = o.system),
kern as (
  select system, point_id, round(sum(k * y) / nullif(sum(k), 0), 6) as predicted_value,
    round(1 - max(k), 6) as uncertainty from pairs group by system, point_id)"""

_SWEEP = """
with {cand}, modes as (select * from (values {values}) as t(mode, gamma)),
based as (select *, predicted_value - 2e0 * uncertainty as base_lcb_score from cand),
r1 as (select *, row_number() over (order by base_lcb_score, candidate_id) as rank_without_failure_risk from based),
r2 as (select *, base_lcb_score + coalesce(gamma * failure_risk, 0e0) as acquisition_score from r1, modes),
r3 as (select *, row_number() over (partition by mode order by acquisition_score, candidate_id) as rank from r2)
"""

ORACLES = {
    "rank_lcb_topk": f"""with {CANDIDATES_SQL}, {_scored_sql()}
select candidate_id, material_id, failure_risk, base_lcb_score, failure_penalty, acquisition_score, risk_flag,
  selection_reason, rank from (select *, row_number() over (order by acquisition_score, candidate_id) as rank from scored)
where rank <= {TOP}""",
    "rank_soft_penalty_min": f"""with {CANDIDATES_SQL}, {_scored_sql()}, r as (select *, {_ranks()} from scored)
select {_COLS} from r""",
    "rank_soft_penalty_max": f"""with {CANDIDATES_SQL}, {_scored_sql("0.5e0", "1e0", "-")},
r as (select *, {_ranks("failure_label", "desc")} from scored) select {_COLS} from r""",
    "rank_target_match": f"""with {_OBSERVED},
t as (select system, case when 10e0 between min(y) and max(y) then 10e0 else min(y) end as target from obs group by system),
j as (select obs.*, t.target from obs join t on obs.system = t.system),
m as (select *, row_number() over (partition by system order by -abs(y - target) + x1 / 100e0 desc, point) as r1,
  row_number() over (partition by system order by abs(y - target), point) as r2,
  row_number() over (partition by system order by y, point) as r3 from j)
select system, target, max(-abs(y - target) + x1 / 100e0) as best_score, max(case when r1 = 1 then point end) as best_match,
  max(case when r2 = 1 then point end) as nearest_point, max(case when r2 = 1 then y end) as nearest_value,
  max(case when r3 = 1 then point end) as best_point, max(case when r3 = 1 then y end) as best_value
from m group by system, target""",
    "rank_weight_sweep": _SWEEP.format(
        cand=CANDIDATES_SQL, values="('mild', 0.1e0), ('balanced', 0.3e0), ('aggressive', 1e0)") + """
select mode, gamma, candidate_id, rank, rank_without_failure_risk, rank_without_failure_risk - rank as rank_shift,
  acquisition_score from r3""",
    "sweep_readout": _SWEEP.format(
        cand=CANDIDATES_SQL, values="('0', 0e0), ('0.5', 0.5e0), ('1', 1e0), ('2', 2e0)") + """
select mode, gamma, round(avg(case when rank <= 10 then coalesce(failure_risk, 0e0) end), 6) as mean_top_risk,
  count(*) filter (where rank <= 10 and true_failure = 1) as known_failures,
  count(*) filter (where rank <= 10 and rank_without_failure_risk <> rank) as shifted,
  count(*) filter (where failure_risk >= 0.10e0) as elevated
from r3 group by mode, gamma""",
    "rank_mode_resolution": f"""with {CANDIDATES_SQL},
g as (select *, case when candidate_id % 5 = 0 then 0.75e0
  else list_extract([0.1e0, 0.3e0, 1e0], cast(candidate_id % 3 + 1 as integer)) end as resolved_gamma from cand)
select candidate_id, resolved_gamma, coalesce(resolved_gamma * failure_risk, 0e0) as failure_penalty,
  predicted_value - 2e0 * uncertainty + coalesce(resolved_gamma * failure_risk, 0e0) as acquisition_score from g""",
    "rank_zero_weight_equivalence": f"""with {CANDIDATES_SQL}, {_scored_sql("0e0")}, r as (select *, {_ranks()} from scored)
select count(*) as n_candidates, count(*) filter (where rank <> rank_without_failure_risk) as n_rank_differences,
  count(*) filter (where failure_penalty <> 0) as n_penalised,
  case when bool_and(rank = rank_without_failure_risk and failure_penalty = 0) then 1 else 0 end as equivalent from r""",
    "rank_grid_fallback": f"""with {CANDIDATES_SQL},
h as (select *, bool_or(failure_risk is not null) over (partition by material_id) as hr from cand),
s as (select *, predicted_value - 2e0 * uncertainty as base_lcb_score, predicted_value - 2e0 * uncertainty
  + coalesce(failure_risk, 0e0) as acquisition_score from h),
r as (select *, {_ranks("material_id")} from s)
select material_id, candidate_id, cast(hr as integer) as has_risk, acquisition_score,
  case when failure_risk is null then 'ranked by original LCB; failure_risk missing'
    else 'ranked by failure-aware LCB soft penalty' end as selection_reason, rank, rank_without_failure_risk from r""",
    "query_high_uncertainty": f"""with recursive {_POINTS},
turn as (select *, row_number() over (partition by system order by uncertainty desc, point) as i from fresh where uncertainty > 0.5e0),
walk as (
  select distinct system, cast(0 as bigint) as i, cast([] as double[]) as taken, false as kept from turn
  union all
  select t.system, t.i, case when c.free then list_append(taken, p1) else taken end, c.free
  from walk join turn t on t.system = walk.system and t.i = walk.i + 1,
    lateral (select len(list_filter(taken, lambda x: abs(x - p1) <= 1e-6)) = 0 as free) c
  where len(taken) < 40)
select t.system, point, uncertainty, row_number() over (partition by t.system order by t.i) as query_rank
from walk join turn t on t.system = walk.system and t.i = walk.i where kept""",
    "tolerance_antijoin": f"with {_POINTS} select system, point, p1 from fresh",
    "grid_generate": f"with {_GRID} select system, dim, point_id, round(p1, 9) as p1, round(p2, 9) as p2 from grid",
    "grid_kernel_score": f"""with {_KERNEL} select g.system, g.point_id, k.predicted_value,
  coalesce(k.uncertainty, 1e0) as uncertainty
from grid g left join kern k on g.system = k.system and g.point_id = k.point_id""",
    "grid_proposal": f"""with {_KERNEL},
b as (select *, predicted_value - uncertainty as score, min(predicted_value) over (partition by system) as coarse_min,
  row_number() over (partition by system order by predicted_value - uncertainty, point_id) as r from kern
  where predicted_value is not null)
select system, point_id, round(score, 5) as score, round(greatest(0e0, coarse_min - predicted_value), 5) as predicted_improvement
from b where r = 1""",
    "candidate_ids": """select p_partkey, printf('%.8g', p_retailprice) || '|' || printf('%.8g', cast(p_size as double))
  as candidate_id from part""",
    "candidate_fallback_ids": """select p_partkey as ordinal, case p_partkey % 4 when 0 then 'c' || p_partkey
  when 1 then cast(p_size as varchar) when 2 then p_brand else cast(p_partkey as varchar) end as candidate_id from part""",
    "rank_risk_bounds": f"""with {CANDIDATES_SQL} select candidate_id, predicted_value - 2e0 * uncertainty + 0.5e0 * failure_risk as lower,
  predicted_value + 1e0 * uncertainty - 0.25e0 * failure_risk as upper from cand""",
    "rank_external_scorer": f"""with {CANDIDATES_SQL.replace("cand as (", "cand0 as (")},
cand as (select * replace (avg(true_failure) over (partition by material_id) as failure_risk) from cand0),
{_scored_sql("0.3e0")}, r as (select *, {_ranks()} from scored) select {_COLS} from r""",
}
