"""Reference comparison, grid validation and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsift.functions.order import rank_within
from runsift.operators import compare as C
from runsift.operators import grids as G
from runsift.operators import quality as Q
from runsift.plans.inputs import table
from runsift.sources.sinks import public_subset
from runsift.sources.tables import grid_rows

CONVENTIONAL = ("Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5")
NAMED_CASES = ("Brand#11", "Brand#15", "Brand#23")


def _dimension(spark, d):
    """Parts as reference systems; some references are null or zero."""
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    return table(spark, d, "part").select(
        k.alias("key"), F.col("p_brand").alias("category"), (F.col("p_size") % 2 + 1).alias("dim"),
        F.when(k % 13 == 0, None).when(k % 29 == 0, 0.0).otherwise(price).alias("lit_param1"),
        F.when(F.col("p_size") % 2 == 1, price / 2.0).alias("lit_param2"),
        F.when(k % 7 != 0, price * 1.02).alias("exp_param1"))


def _results(spark, d):
    """Line items as results: one row per part; a part without items has no report."""
    items = table(spark, d, "lineitem")
    return items.groupBy(F.col("l_partkey").alias("key")).agg(
        F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("best_param1"),
        F.round(F.avg("l_quantity") * 20.0, 6).alias("best_param2"),
        F.count(F.lit(1)).alias("n_calls"), F.max("l_linenumber").alias("n_iterations"),
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("c"),
        F.round(F.avg("l_discount"), 6).alias("gp_uncertainty")).withColumn(
        "converged", F.col("c") == 1).drop("c")


def _rows(spark, d):
    return C.add_errors(C.join_references(_dimension(spark, d), _results(spark, d)))


def _rounded(df, digits=6):
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def cmp_left_dimension(spark, d):
    return C.join_references(_dimension(spark, d), _results(spark, d)).select(
        "key", "category", "dim", "best_param1", "n_calls", "n_iterations", F.col("converged").cast("int").alias("converged"))


def cmp_errors(spark, d):
    return _rounded(_rows(spark, d).select(
        "key", "abs_error_param1", "pct_error_param1", "abs_error_param2", "pct_error_param2"))


def cmp_category_stats(spark, d):
    return _rounded(C.category_statistics(_rows(spark, d)), 5)


def cmp_high_errors(spark, d):
    return _rounded(C.high_errors(_rows(spark, d)).select("category", "key", "pct_error_param1"))


def cmp_savings(spark, d):
    return _rounded(C.call_savings(_rows(spark, d)).select("key", "dim", "grid_size", "savings_abs", "savings_pct"))


def cmp_mean_savings(spark, d):
    return _rounded(C.mean_savings(C.call_savings(_rows(spark, d))))


def cmp_first_hit(spark, d):
    """Points are numbered from 1 in the order of the part keys of a brand."""
    scan = table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_retailprice") / 1e5).alias("y"))
    return C.first_hit(rank_within(scan, [F.col("p_partkey")], "position", ["p_brand"]), "p_brand", "position", "y")


def cmp_category_counts(spark, d):
    return C.category_counts(_dimension(spark, d))


def cmp_bands(spark, d):
    """Parity against twenty times the mean quantity, which lies near the second reference."""
    rows = _rows(spark, d).withColumn("best_param1", F.col("best_param2")).withColumn("lit_param1", F.col("lit_param2"))
    return C.parity_bands(rows).select("key", "category", "band")


def cmp_category_errors(spark, d):
    return _rounded(C.category_errors(_rows(spark, d)), 5)


def _number(c="p_brand"):
    return F.regexp_extract(c, r"(\d+)", 1).cast("int")


def _cells(spark, d):
    """Brands as cases: brand number mod 3 sets the grid width, mod 4 the variables."""
    part = table(spark, d, "part").withColumn("b", _number())
    m = F.when(F.col("b") % 3 == 1, 5).otherwise(50)
    return part.withColumn("m", m).select(
        F.col("p_brand").alias("case_id"), "b", "m", (F.col("p_size") % m).cast("double").alias("x"),
        (F.col("p_partkey") % m).cast("double").alias("y"), (F.col("p_retailprice") / 1000.0).alias("energy"), "p_partkey")


def _cases(spark, d):
    brands = _cells(spark, d).select("case_id", "b", "m").distinct()
    both = F.array(F.lit("x"), F.lit("y"))
    return brands.select(
        "case_id", "b", F.when(F.col("b") % 4 == 0, both).otherwise(F.array(F.lit("x"))).alias("scan_variables"),
        F.col("m").alias("points_per_variable"), (F.col("b") % 5 != 0).alias("public"))


def _variables(spark, d):
    brands = _cells(spark, d).select("case_id", "b", "m").distinct()
    names = F.when(F.col("b") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x")))
    return brands.select("case_id", F.explode(names).alias("name"), F.lit(0.0).alias("lo"),
                         (F.col("m") - 1).cast("double").alias("hi"), F.lit(False).alias("spin"))


def _references(spark, d):
    """Reference run of each brand: its cheapest part, out of bounds or with another spin for some brands."""
    best = _cells(spark, d).groupBy("case_id", "b").agg(F.min(F.struct("energy", "p_partkey", "x", "y")).alias("r"))
    x = F.when(F.col("b") % 5 == 0, 1000.0).otherwise(F.col("r.x"))
    params = F.when(F.col("b") % 7 == 0, F.create_map(F.lit("x"), x)).otherwise(
        F.create_map(F.lit("x"), x, F.lit("y"), F.col("r.y")))
    return best.select(
        "case_id", params.alias("best_params"), (F.col("r.energy") + (F.col("b") % 3) * 0.0007).alias("best_energy"),
        F.col("b").alias("n_calls"), (F.col("b") % 11 == 0).alias("spin"))


def _existing(spark, d):
    """Recorded points in two layouts: new rows with a status, old rows without."""
    cells = _cells(spark, d)
    params = F.when(F.col("b") % 2 == 0, F.create_map(F.lit("x"), F.col("x"), F.lit("y"), F.col("y"))).otherwise(
        F.create_map(F.lit("x"), F.col("x")))
    tagged = cells.select("case_id", params.alias("params"), "p_partkey", "energy")
    new = tagged.where("p_partkey % 2 = 0").select(
        "case_id", "params", F.col("energy").cast("string").alias("energy"),
        F.when(F.col("p_partkey") % 8 == 0, "failed").otherwise("ok").alias("status"))
    old = tagged.where("p_partkey % 2 = 1").select("case_id", "params", F.col("energy").cast("string").alias("energy_eV_per_atom"))
    return grid_rows(new, old)


def _expected(spark, d):
    return G.expected_points(_cases(spark, d), _variables(spark, d), _references(spark, d))


def _layout(spark, d):
    return G.layouts(_cases(spark, d), _variables(spark, d), _references(spark, d))


def _xy(df):
    get = lambda n: F.round(F.try_element_at("params", F.lit(n)), 9).alias(n)
    return df.select("case_id", "point_id", get("x"), get("y"), *[c for c in df.columns if c not in ("case_id", "point_id", "params")])


def grid_expected(spark, d):
    return _xy(_expected(spark, d))


def grid_resume(spark, d):
    return _xy(G.resume(_expected(spark, d), _existing(spark, d), _layout(spark, d), 10))


def _summary(spark, d):
    done = G.resume(_expected(spark, d), _existing(spark, d), _layout(spark, d))
    return G.summarise(_cases(spark, d), done, _variables(spark, d), _references(spark, d))


def grid_summary(spark, d):
    return _rounded(_summary(spark, d), 9)


def grid_public(spark, d):
    return public_subset(_summary(spark, d)).select("case_id", "grid_points", "pass_fail")


def grid_enrich(spark, d):
    brands = _cases(spark, d)
    results = brands.select(F.concat(F.lit("key_"), "case_id").alias("key"), "b")
    key_map = brands.select("case_id", F.concat(F.lit("key_"), "case_id").alias("key"))
    return _rounded(G.enrich(results, _summary(spark, d), key_map), 9)


def grid_cases(spark, d):
    return G.select_cases(_cases(spark, d)).select("case_id", "points_per_variable")


def grid_cases_named(spark, d):
    """Brands by name, one that is not public among them."""
    return G.select_cases(_cases(spark, d), NAMED_CASES).select("case_id", "points_per_variable")


def grid_gate(spark, d):
    return G.gate(_summary(spark, d))


def grid_preview(spark, d):
    out = G.preview(_expected(spark, d), _variables(spark, d), _references(spark, d))
    get = lambda c, n: F.round(F.try_element_at(c, F.lit(n)), 9)
    return out.select("case_id", "n_points", get("first_point", "x").alias("first_x"), get("last_point", "x").alias("last_x"),
                      get("last_point", "y").alias("last_y"), F.col("compatible").cast("int").alias("compatible"))


def gate_checks(spark, d):
    t = lambda n: table(spark, d, n)
    out = Q.verdict([
        (C.call_savings(_rows(spark, d)), [
            Q.row_count("result_rows", t("part")), Q.required_columns("result_columns", ["key", "category", "dim"]),
            Q.enough_savings("two_dimensional_savings"), Q.category_error("category_error", CONVENTIONAL)]),
        (t("nation"), [Q.row_count("nation_rows", 25)]),
        (t("customer"), [Q.required_columns("customer_columns", ["c_custkey", "c_name", "c_mktsegment"])]),
        (t("supplier"), [Q.required_columns("supplier_columns", ["s_suppkey", "s_name"])])])
    return _rounded(out)


QUERIES = {f.__name__: f for f in (
    cmp_left_dimension, cmp_errors, cmp_category_stats, cmp_high_errors, cmp_savings, cmp_mean_savings, cmp_first_hit,
    cmp_category_counts, cmp_bands, cmp_category_errors, grid_expected, grid_resume, grid_summary, grid_public,
    grid_enrich, grid_cases, grid_cases_named, grid_gate, grid_preview, gate_checks)}

_ROWS = """
dim as (select p_partkey as key, p_brand as category, p_size % 2 + 1 as dim,
  case when p_partkey % 13 = 0 then null when p_partkey % 29 = 0 then 0e0 else p_retailprice end as lit1,
  case when p_size % 2 = 1 then p_retailprice / 2e0 end as lit2, case when p_partkey % 7 <> 0 then p_retailprice * 1.02e0 end as exp1 from part),
res as (select l_partkey as key, round(avg(l_extendedprice / l_quantity), 6) as b1, round(avg(l_quantity) * 20e0, 6) as b2, count(*) as n_calls,
  max(l_linenumber) as n_iterations, max(case when l_returnflag = 'R' then 1 else 0 end) as converged, round(avg(l_discount), 6) as gp
  from lineitem group by 1),
rows0 as (select dim.*, b1, b2, n_calls, coalesce(n_iterations, 0) as n_iterations, coalesce(converged, 0) as converged, gp,
  abs(b1 - lit1) as a1, abs(b1 - lit1) / nullif(abs(lit1), 0) * 100e0 as e1, abs(b2 - lit2) as a2,
  abs(b2 - lit2) / nullif(abs(lit2), 0) * 100e0 as e2, abs(b1 - exp1) / nullif(abs(exp1), 0) * 100e0 as x1
  from dim left join res on dim.key = res.key),
sav as (select *, case when dim = 1 then 20 else 49 end as grid_size, case when dim = 1 then 20 else 49 end - n_calls as savings_abs,
  (case when dim = 1 then 20 else 49 end - n_calls) / (case when dim = 1 then 20e0 else 49e0 end) * 100e0 as savings_pct from rows0)"""
_STD = "round(case when count({0}) > 1 then stddev_samp({0}) when count({0}) = 1 then 0e0 end, 5)"
_GRID = """
cells as (select p_brand as case_id, b, m, cast(p_size % m as double) as x, cast(p_partkey % m as double) as y,
    p_retailprice / 1000e0 as energy, p_partkey
  from (select *, cast(regexp_extract(p_brand, '(\\d+)', 1) as integer) as b,
    case when cast(regexp_extract(p_brand, '(\\d+)', 1) as integer) % 3 = 1 then 5 else 50 end as m from part)),
cases as (select distinct case_id, b, m, case when b % 4 = 0 then 2 else 1 end as dim from cells),
ref as (select case_id, b, case when b % 5 = 0 then 1000e0 else x end as rx, case when b % 7 = 0 then null else y end as ry,
    energy + (b % 3) * 0.0007e0 as best_energy from (select *, row_number() over (partition by case_id order by energy, p_partkey) as r from cells) where r = 1),
comp as (select c.case_id, case when c.b % 11 <> 0 and rx between 0 and m - 1 and (c.b % 2 = 1 or coalesce(ry between 0 and m - 1, false)) then 1 else 0 end as ok
  from cases c join ref on c.case_id = ref.case_id),
steps as (select range as i from range(50)),
expd as (
  select c.case_id, cast(i.i as bigint) as point_id, cast(i.i as double) as x,
    case when c.b % 2 = 0 then case when k.ok = 1 then r.ry else (m - 1) * 0.5e0 end end as y
  from cases c join comp k on k.case_id = c.case_id join ref r on r.case_id = c.case_id, steps i where dim = 1 and i.i < m
  union all
  select c.case_id, cast(j.i * m + i.i as bigint), cast(i.i as double), cast(j.i as double) from cases c, steps i, steps j
  where dim = 2 and i.i < m and j.i < m),
done as (select case_id, x, case when b % 2 = 0 then y end as y, min(energy) as energy from cells where p_partkey % 8 <> 0 group by 1, 2, 3),
res as (select e.*, d.energy from expd e left join done d on d.case_id = e.case_id and d.x = e.x and d.y is not distinct from e.y),
summ as (
  select c.case_id, c.dim, cast(power(m, c.dim) as bigint) as grid_points, coalesce(n, 0) as completed_grid_points, c.b as n_calls,
    ge as grid_min_energy, gp as grid_min_point, case when ok = 1 then best_energy end as reference_energy,
    case when ok = 1 then abs(ge - best_energy) end as delta,
    case when n is null and ok = 0 then 'no_compatible_al_reference' when n is null then 'not_run' when n < power(m, c.dim) then 'incomplete'
      when ok = 0 then 'no_compatible_al_reference' when abs(ge - best_energy) < 0.001e0 then 'pass' else 'review' end as pass_fail
  from cases c join ref on ref.case_id = c.case_id join comp on comp.case_id = c.case_id
  left join (select case_id, count(*) as n, min(energy) as ge, arg_min(point_id, (energy, point_id)) as gp from res where energy is not null group by 1) g
    on g.case_id = c.case_id)"""

ORACLES = {
    "cmp_left_dimension": f"""with {_ROWS} select key, category, dim, b1 as best_param1, n_calls, n_iterations, converged from rows0""",
    "cmp_errors": f"""with {_ROWS} select key, round(a1, 6) as abs_error_param1, round(e1, 6) as pct_error_param1,
  round(a2, 6) as abs_error_param2, round(e2, 6) as pct_error_param2 from rows0""",
    "cmp_category_stats": f"""with {_ROWS}
select case when grouping(category) = 0 then category when grouping(dim) = 0 then 'Overall ' || dim || 'D' else 'Overall' end as category,
  count(*) as n_systems, round(avg(e1), 5) as mean_abs_error_pbe, {_STD.format('e1')} as std_abs_error_pbe, round(max(e1), 5) as max_abs_error_pbe,
  round(avg(x1), 5) as mean_abs_error_exp, {_STD.format('x1')} as std_abs_error_exp, round(avg(n_calls), 5) as mean_n_calls,
  {_STD.format('n_calls')} as std_n_calls, min(n_calls) as min_n_calls, max(n_calls) as max_n_calls,
  round(avg(converged) * 100, 5) as pct_converged, round(avg(gp), 5) as mean_gp_uncertainty
from rows0 group by grouping sets ((category), (dim), ())""",
    "cmp_high_errors": f"with {_ROWS} select category, key, round(e1, 6) as pct_error_param1 from rows0 where e1 > 3",
    "cmp_savings": f"with {_ROWS} select key, dim, grid_size, savings_abs, round(savings_pct, 6) as savings_pct from sav",
    "cmp_mean_savings": f"""with {_ROWS} select dim, round(avg(savings_pct), 6) as mean_savings_pct, count(savings_pct) as n_systems
from sav group by rollup (dim)""",
    "cmp_first_hit": """with s as (select p_brand, row_number() over (partition by p_brand order by p_partkey) as position, p_retailprice / 1e5 as y,
  min(p_retailprice / 1e5) over (partition by p_brand) as lo from part)
select p_brand, count(*) as grid_size, coalesce(min(case when y <= lo + 0.001e0 then position end), count(*)) as n_to_minimum from s group by p_brand""",
    "cmp_category_counts": "select p_brand as category, count(*) as n_systems from part group by 1",
    "cmp_bands": f"""with {_ROWS} select key, category, case when abs(b2 / lit2 - 1) <= 0.01e0 then 'within_1_percent'
  when abs(b2 / lit2 - 1) <= 0.02e0 then 'within_2_percent' else 'outside' end as band from rows0 where b2 / nullif(lit2, 0) is not null""",
    "cmp_category_errors": f"""with {_ROWS} select category, round(coalesce(avg(e1), 0), 5) as mean_error,
  round(coalesce(stddev_pop(e1), 0), 5) as std_error from rows0 group by 1""",
    "grid_expected": f"with {_GRID} select case_id, point_id, x, y from expd",
    "grid_resume": f"""with {_GRID}, n as (select *, row_number() over (partition by case_id, energy is null order by point_id) as r from res)
select case_id, point_id, x, y, energy, case when energy is not null then 'ok' when r <= 10 then 'due' else 'not_run' end as status from n""",
    "grid_summary": f"""with {_GRID} select case_id, dim, grid_points, completed_grid_points, n_calls, round(grid_min_energy, 9) as grid_min_energy,
  grid_min_point, round(reference_energy, 9) as reference_energy, round(delta, 9) as delta, pass_fail from summ""",
    "grid_public": f"with {_GRID} select case_id, grid_points, pass_fail from summ where pass_fail = 'pass' and completed_grid_points = grid_points",
    "grid_enrich": f"""with {_GRID}, p as (select * from summ where pass_fail = 'pass' and completed_grid_points = grid_points)
select 'key_' || c.case_id as key, c.b, p.pass_fail as direct_grid_status, p.grid_points as direct_grid_points,
  p.completed_grid_points as direct_grid_completed_points, round(p.grid_min_energy, 9) as direct_grid_min_energy,
  round(p.delta, 9) as direct_grid_delta from cases c left join p on p.case_id = c.case_id""",
    "grid_cases": f"with {_GRID} select case_id, m as points_per_variable from cases where b % 5 <> 0",
    "grid_cases_named": f"with {_GRID} select case_id, m as points_per_variable from cases where case_id in {NAMED_CASES}",
    "grid_gate": f"""with {_GRID} select count(*) as n_rows, count(*) filter (where pass_fail <> 'pass') as n_not_passed,
  case when count(*) > 0 and count(*) filter (where pass_fail <> 'pass') = 0 then 1 else 0 end as passed from summ""",
    "grid_preview": f"""with {_GRID} select e.case_id, count(*) as n_points, arg_min(x, point_id) as first_x, arg_max(x, point_id) as last_x,
  max(case when point_id = mx then y end) as last_y, max(ok) as compatible
from (select *, max(point_id) over (partition by case_id) as mx from expd) e join comp on comp.case_id = e.case_id group by e.case_id""",
    "gate_checks": f"""with {_ROWS}, c as (
  select 'result_rows' as check_name, case when (select count(*) from rows0) = (select count(*) from part) then 1 else 0 end as passed,
    cast((select count(*) from rows0) as double) as measured
  union all select 'nation_rows', case when count(*) = 25 then 1 else 0 end, count(*) from nation
  union all select 'result_columns', case when count(*) = 0 then 1 else 0 end, count(*) from rows0 where key is null or coalesce(category, '') = '' or dim is null
  union all select 'customer_columns', case when count(*) = 0 then 1 else 0 end, count(*) from customer
    where c_custkey is null or coalesce(c_name, '') = '' or coalesce(c_mktsegment, '') = ''
  union all select 'supplier_columns', case when count(*) = 0 then 1 else 0 end, count(*) from supplier where s_suppkey is null or coalesce(s_name, '') = ''
  union all select 'two_dimensional_savings', case when coalesce(avg(case when savings_abs > 0 then 1 else 0 end) >= 0.8, true) then 1 else 0 end,
    avg(case when savings_abs > 0 then 1 else 0 end) from sav where dim = 2 and savings_abs is not null
  union all select 'category_error', case when coalesce(avg(e1) <= 5, true) then 1 else 0 end, avg(e1) from rows0 where category in {CONVENTIONAL})
select check_name, passed, round(measured, 6) as measured from c
union all select 'overall', min(passed), cast(count(*) filter (where passed = 0) as double) from c""",
}
