"""Result assembly and review batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsift.operators import assemble as A
from runsift.operators import ranking as R
from runsift.operators import review as V
from runsift.plans.inputs import CANDIDATES_SQL, candidates, props_k, table

KINDS = ("view", "click", "error", "signup", "purchase")


def _requests(spark, d):
    key = A.reuse_key("l_partkey", ["l_quantity", "l_discount"], ["l_returnflag"])
    return table(spark, d, "lineitem").withColumn("reuse_key", key)


def asm_reuse(spark, d):
    """Line items ask for values; items already shipped hold them."""
    rows = _requests(spark, d)
    known = rows.where("l_linestatus = 'F'").select("reuse_key", F.col("l_extendedprice").alias("energy"))
    return A.reuse_results(rows, known).select("l_orderkey", "l_linenumber", "reuse_key", "energy", "is_missing")


def asm_missing(spark, d):
    rows = _requests(spark, d)
    known = rows.where("l_linestatus = 'F'").select("reuse_key")
    return A.missing_requests(rows, known).select("l_orderkey", "l_linenumber", "reuse_key")


def asm_referenced(spark, d):
    items = table(spark, d, "lineitem")
    counts = items.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_members"))
    totals = table(spark, d, "orders").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", F.col("o_totalprice").alias("total"), "n_members", F.col("o_orderpriority").startswith("1").alias("per_member"))
    refs = items.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("energy"))
    return A.referenced_values(totals, refs, "o_orderkey").select("o_orderkey", F.round("value", 7).alias("value"))


def _trials(spark, d):
    two = F.col("p_partkey") % 2 == 1
    seeds = table(spark, d, "part").select(
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("p_partkey") % 5 + 1).cast("int")).alias("system"),
        F.col("p_partkey").alias("seed_id"), F.when(two, 2).otherwise(1).alias("dim"),
        (F.col("p_size") / 50.0).alias("p1"), F.lit(0.02).alias("lo1"), F.lit(0.98).alias("hi1"),
        F.when(two, F.lit(0.5)).alias("p2"), F.lit(0.0).alias("lo2"), F.lit(0.52).alias("hi2"))
    return A.seed_trials(seeds)


def _outcomes(spark, d):
    """Every event is one try; errors gave no value."""
    two = F.col("user_id") % 2 == 1
    return table(spark, d, "events").select(
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("user_id") % 5 + 1).cast("int")).alias("system"),
        (props_k() / 100.0).alias("t1"), F.when(two, F.lit(0.5)).alias("t2"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("energy"))


def asm_seed_trials(spark, d):
    return _trials(spark, d).select("seed_id", "trial", F.round("t1", 6).alias("t1"), F.round("t2", 6).alias("t2"))


def asm_first_success(spark, d):
    return A.first_successes(_trials(spark, d), _outcomes(spark, d), "system").select(
        "system", "seed_id", "trial", F.round("t1", 6).alias("t1"), "energy")


def asm_label_gate(spark, d):
    labels = A.first_successes(_trials(spark, d), _outcomes(spark, d), "system")
    return A.label_gate(labels, "system", "dim")


def _members(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("structure"), (F.col("l_quantity") / 10.0).alias("x"), (F.col("l_discount") * 30.0).alias("y"),
        (F.col("l_tax") * 20.0).alias("z"), F.lit(5.0).alias("lx"), F.lit(None).cast("double").alias("ly"), F.lit(1.6).alias("lz"))


def asm_pair_distance(spark, d):
    return A.overlap_screen(_members(spark, d), "structure")


def asm_merge(spark, d):
    """Parts are the labels so far, events the new batch."""
    labels = table(spark, d, "part").select(
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("p_partkey") % 5 + 1).cast("int")).alias("system"),
        (F.col("p_size") / 50.0).alias("p1"), F.col("p_retailprice").alias("energy"))
    batch = table(spark, d, "events").select(
        F.col("event_type").alias("system"), (F.col("value") / 100.0).alias("p1"),
        F.when(props_k() % 4 != 0, F.col("value")).alias("energy"), "event_id")
    return A.merge_batch(labels, batch, ["p1"], ["system"], ["event_id"])


def _plan(spark, d):
    part = table(spark, d, "part")
    category = F.element_at(F.array(*[F.lit(c) for c in (
        "exploitation", "uncertainty_exploration", "low_failure_risk", "failure_risk_challenge", "diversity")]),
        (F.col("p_size") % 5 + 1).cast("int"))
    f = (F.col("p_partkey") % 97) / 100.0 + 0.003
    return part.select(
        F.col("p_partkey").alias("position"), F.col("p_brand").alias("module"), category.alias("category"),
        F.concat(F.lit("reason for "), category).alias("reason"),
        F.when(F.col("p_partkey") % 2 == 0, F.array(f)).otherwise(F.array(f, 1.0 - f)).alias("fractions"))


def _review_systems(spark, d):
    brand = table(spark, d, "part").groupBy(F.col("p_brand").alias("module")).agg(
        F.min("p_size").cast("double").alias("lo"), F.max("p_size").cast("double").alias("hi"))
    b = F.regexp_extract("module", r"(\d+)", 1)
    variable = lambda n, lo, hi: F.struct(
        F.lit(n).alias("name"), lo.alias("lo"), hi.alias("hi"), F.array(lo, hi).alias("seeds"))
    return brand.select(
        "module", F.concat(F.lit("sys"), b).alias("key"), F.when(b.cast("int") % 3 == 0, "").otherwise("metal").alias("family"),
        F.array(variable("a", F.col("lo"), F.col("hi")), variable("c", F.lit(1.0), F.lit(3.0))).alias("variables"),
        F.create_map(F.lit("Si"), F.lit("Si.upf"), F.lit("Mg"), F.concat(F.lit("Mg"), b, F.lit(".upf"))).alias("species"),
        F.concat(F.lit("systems/"), "module").alias("source"), (b.cast("int") + 40).alias("ecutwfc"), F.lit("mv").alias("smearing"))


def review_batch(spark, d):
    return V.build_batch(_plan(spark, d), _review_systems(spark, d), ["ecutwfc", "smearing"])


def review_quota(spark, d):
    return V.quota_batch(R.clean_candidates(candidates(spark, d)))


QUERIES = {f.__name__: f for f in (
    asm_reuse, asm_missing, asm_referenced, asm_seed_trials, asm_first_success, asm_label_gate, asm_pair_distance,
    asm_merge, review_batch, review_quota)}

_REQ = """
req as (select *, l_partkey || ':l_quantity=' || printf('%.6f', l_quantity) || ':l_discount=' || printf('%.6f', l_discount)
  || ':' || l_returnflag as reuse_key from lineitem),
known as (select reuse_key as rk, min(l_extendedprice) as energy from req where l_linestatus = 'F' group by 1)"""
_KIND = "list_extract(['view', 'click', 'error', 'signup', 'purchase'], cast(p_partkey % 5 + 1 as integer))"
_TRIALS = f"""
seeds as (select {_KIND} as system, p_partkey as seed_id, p_partkey % 2 + 1 as dim, p_size / 50e0 as p1, case when p_partkey % 2 = 1 then 0.5e0 end as p2 from part),
tr as (select system, seed_id, dim, t as trial,
    round(case t when 1 then least(greatest(p1 - 0.03e0, 0.02e0), 0.98e0) when 2 then least(greatest(p1 + 0.03e0, 0.02e0), 0.98e0) else p1 end, 6) as t1,
    round(case t when 3 then least(greatest(p2 - 0.03e0, 0e0), 0.52e0) when 4 then least(greatest(p2 + 0.03e0, 0e0), 0.52e0) else p2 end, 6) as t2
  from seeds, (values (0), (1), (2), (3), (4)) as v(t) where dim = 2 or t <= 2),
outc as (select list_extract(['view', 'click', 'error', 'signup', 'purchase'], cast(user_id % 5 + 1 as integer)) as system,
  cast(json_extract_string(props, '$.k') as integer) / 100e0 as t1, case when user_id % 2 = 1 then 0.5e0 else 0e0 end as t2,
  min(value) as energy from events where event_type <> 'error' group by 1, 2, 3),
tried as (
  select system, seed_id, row_number() over (partition by system order by seed_id) as i, list(o order by o.trial) as options
  from (select tr.system, seed_id, {{'trial': trial, 'x': tr.t1, 'y': coalesce(tr.t2, 0), 't1': tr.t1, 't2': tr.t2, 'dim': dim, 'energy': o.energy}} as o
    from tr join outc o on o.system = tr.system and abs(o.t1 - tr.t1) <= 1e-6 and abs(o.t2 - coalesce(tr.t2, 0)) <= 1e-6)
  group by system, seed_id),
walk as (
  select distinct system, cast(0 as bigint) as i, cast(null as bigint) as seed_id,
    list_filter([options[1]], lambda o: false) as taken, list_filter([options[1]], lambda o: false)[1] as pick
  from tried where i = 1
  union all
  select t.system, t.i, t.seed_id, case when c.pick is null then taken else list_append(taken, c.pick) end, c.pick
  from walk join tried t on t.system = walk.system and t.i = walk.i + 1,
    lateral (select list_filter(options, lambda o: len(list_filter(
      taken, lambda x: abs(x.x - o.x) <= 1e-6 and abs(x.y - o.y) <= 1e-6)) = 0)[1] as pick) c),
succ as (select system, seed_id, pick.trial as trial, pick.t1 as t1, pick.t2 as t2, pick.dim as dim, pick.energy as energy
  from walk where pick is not null)"""

ORACLES = {
    "asm_reuse": f"""with {_REQ} select l_orderkey, l_linenumber, reuse_key, energy, case when energy is null then 1 else 0 end as is_missing
from req left join known on rk = reuse_key""",
    "asm_missing": f"""with {_REQ} select l_orderkey, l_linenumber, reuse_key from req
where not exists (select 1 from known where rk = reuse_key)""",
    "asm_referenced": """with s as (select l_orderkey, sum(l_extendedprice) as ref, count(*) as n from lineitem group by 1)
select o_orderkey, round(case when o_orderpriority like '1%' then (o_totalprice - coalesce(ref, 0)) / n
  else o_totalprice - coalesce(ref, 0) end, 7) as value from orders left join s on l_orderkey = o_orderkey""",
    "asm_seed_trials": f"with recursive {_TRIALS} select seed_id, trial, t1, t2 from tr",
    "asm_first_success": f"with recursive {_TRIALS} select system, seed_id, trial, t1, energy from succ",
    "asm_label_gate": f"""with recursive {_TRIALS}, l as (select distinct system, dim, t1, coalesce(t2, 0) as t2 from succ)
select system, cast(dim as integer) as dim, count(*) as n_labels, case when count(*) >= case when dim = 1 then 3 else 5 end then 1 else 0 end as enough
from l group by system, dim""",
    "asm_pair_distance": """
with m as (select l_orderkey as structure, row_number() over () as i, l_quantity / 10e0 as x, l_discount * 30e0 as y, l_tax * 20e0 as z from lineitem),
p as (select a.structure, min(sqrt(
    power(a.x - b.x - 5e0 * round((a.x - b.x) / 5e0), 2) + power(a.y - b.y, 2) + power(a.z - b.z - 1.6e0 * round((a.z - b.z) / 1.6e0), 2))) as d
  from m a join m b on a.structure = b.structure and a.i < b.i group by 1),
c as (select structure, count(*) as n_members from m group by 1)
select c.structure, n_members, case when d < 0.25e0 then 0 else 1 end as valid from c left join p on p.structure = c.structure""",
    "asm_merge": f"""with recursive lab as (select {_KIND} as system, p_size / 50e0 as p1, p_retailprice as energy from part),
b as (select event_type as system, value / 100e0 as p1, value as energy, row_number() over (partition by event_type order by event_id) as i
  from events where cast(json_extract_string(props, '$.k') as integer) % 4 <> 0
  and not exists (select 1 from lab where lab.system = event_type and abs(lab.p1 - value / 100e0) <= 1e-6)),
walk as (
  select distinct system, cast(0 as bigint) as i, cast([] as double[]) as taken, false as kept from b
  union all
  select b.system, b.i, case when c.free then list_append(taken, p1) else taken end, c.free
  from walk join b on b.system = walk.system and b.i = walk.i + 1,
    lateral (select len(list_filter(taken, lambda x: abs(x - p1) <= 1e-6)) = 0 as free) c)
select * from lab union all
select b.system, p1, energy from walk join b on b.system = walk.system and b.i = walk.i where kept""",
    "review_batch": """
with s as (select p_brand, regexp_extract(p_brand, '(\\d+)', 1) as b, cast(min(p_size) as double) as lo, cast(max(p_size) as double) as hi from part group by 1),
p as (select p.*, s.*, (p_partkey % 97) / 100e0 + 0.003e0 as f, row_number() over (partition by p.p_brand order by p_partkey) as n,
  list_extract(['exploitation', 'uncertainty_exploration', 'low_failure_risk', 'failure_risk_challenge', 'diversity'], p_size % 5 + 1) as cat
  from part p join s on s.p_brand = p.p_brand)
select 'dryrun_' || p_brand || '_' || n as candidate_id, 'sys' || b as material_id,
  case when cast(b as integer) % 3 = 0 then 'not_computed' else 'metal' end as material_family, 'Mg,Si' as formula_composition,
  'systems/' || p_brand as structure_source,
  'a=' || printf('%.4f', lo + f * (hi - lo)) || case when p_partkey % 2 = 1 then '; c=' || printf('%.4f', 1e0 + (1e0 - f) * 2e0) else '' end as candidate_variables,
  'not_computed' as predicted_value, 'not_computed' as uncertainty_lcb_score, 'not_computed' as failure_risk, 'not_computed' as acquisition_score,
  'reason for ' || cat as selection_reason, cat as selection_category, 'ecutwfc=' || (cast(b as integer) + 40) || ';smearing=mv' as "DFT_settings_profile",
  'Mg:Mg' || b || '.upf;Si:Si.upf' as pseudopotential_family, 'not_computed' as expected_runtime_risk, 'dry_run_only' as status,
  'Proposal-review artifact only; not selected for QE/PBE execution; requires human review before QE/PBE.' as notes
from p""",
    "review_quota": f"""with {CANDIDATES_SQL},
q1 as (select *, 'exploitation' as category from cand order by predicted_value, uncertainty, candidate_id limit 2),
q2 as (select *, 'uncertainty_exploration' as category from cand where candidate_id not in (select candidate_id from q1)
  order by uncertainty desc, candidate_id limit 2),
q3 as (select *, 'low_failure_risk' as category from cand where failure_risk < 0.1e0
  and candidate_id not in (select candidate_id from q1 union all select candidate_id from q2) order by failure_risk, candidate_id limit 2),
q4 as (select *, 'failure_risk_challenge' as category from cand where failure_risk >= 0.1e0 and candidate_id not in
  (select candidate_id from q1 union all select candidate_id from q2 union all select candidate_id from q3)
  order by failure_risk desc, candidate_id limit 2),
u as (select * from q1 union all select * from q2 union all select * from q3 union all select * from q4),
o as (select *, row_number() over (partition by material_id order by predicted_value, candidate_id) as r from cand
  where material_id not in (select material_id from u)),
q5 as (select * exclude (r), 'diversity' as category from o where r = 1 order by predicted_value, candidate_id limit 2)
select candidate_id, material_id, predicted_value, uncertainty, failure_risk, category from (select * from u union all select * from q5)""",
}
