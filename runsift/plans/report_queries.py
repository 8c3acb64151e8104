"""Report extraction and iteration traces over composed reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsift.operators import reports as P
from runsift.plans.inputs import props_k, table


def composed_reports(spark, d):
    """One report per event, in the layouts old and new reports use."""
    e = table(spark, d, "events").withColumn("k", props_k())
    k, eid = F.col("k"), F.col("event_id")
    text = lambda c: c.cast("string")
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    v1, v2 = say(text(k % 90 + 1), ".25"), say(text(k % 7), ".5")
    layout = eid % 6
    params = (
        F.when(layout == 0, say("  Best parameters : a=9.5  a=", v1, "  c=", v2))
        .when(layout == 1, say("  Best: bond=", v1, "  E=-1.5 eV  GP std=0.5 eV  QE labels=3"))
        .when(layout == 2, say("Best observed: height=", v1, ", layer_half_thickness=", v2))
        .when(layout == 3, say("Best lattice constant: ", v1, " A"))
        .when(layout == 4, say("best distance  ", v1))
        .otherwise(say("  Best parameters : b=", v1, "  c_over_a=1.5")))
    energy = (
        F.when(eid % 3 == 0, say("  Best first objective: -1.0 eV\n  Best Structure-search QE objective: -", text(k), ".5 eV/atom"))
        .when(eid % 3 == 1, say("Best QE energy per atom: -", text(k), ".25 eV"))
        .otherwise(say("Best point E=-", text(k), ".75 eV")))
    std = F.when(eid % 2 == 0, say("  GP uncertainty  : 0.0", text(k), " eV")).otherwise(say("GP std=0.", text(k)))
    calls = F.when(eid % 3 == 1, say("Successful QE evaluations: ", text(k + 5))).otherwise(
        say("  Total QE calls  : ", text(k + 4)))
    rounds = F.array_join(F.transform(F.sequence(F.lit(0), k % 4), lambda i: F.when(i > 0, say("Iteration ", text(i)))), "\n")
    history = F.array_join(F.transform(F.sequence(F.lit(1), k % 3 + 1), lambda i: say(
        "    Added AL:  x=", text(i), ".5  y=", text(k), " -> E=-", text(i), ".125 eV\n",
        "  Best: w=", text(i), ".5  v=", text(k), "  E=-", text(i), ".25e1 eV  GP std=0.0", text(i), " eV  QE labels=", text(i * 3))), "\n")
    name = F.when(eid % 5 == 0, "_report.txt").otherwise("_qe_run_report.txt")
    key_line = F.when(eid % 4 == 1, say("Key: old", text(F.col("user_id")), "   Category: x")).when(
        eid % 4 == 2, say("Key: sys", text(F.col("user_id")), "_4_qe_report"))
    body = F.concat_ws(
        "\n", F.lit("====="), key_line, say("Variables: {'a': (", text(k), ".5, ", text(k + 1), ".5), 'c': (1.0, 2e1)}"),
        F.when(k % 2 == 0, F.lit("Computed quantity: energy")),
        say("spin_polarized: ", F.when(k % 5 == 0, "True").otherwise("False"), "   relax: False"),
        rounds, F.when(k % 3 != 0, F.lit("FINAL RESULT")), params, energy, std, calls,
        F.when(k % 2 == 1, F.lit("  ✓ Converged.")))
    return e.select(
        "event_id", "user_id", F.col("ts").alias("modified"), F.when(k % 3 == 0, 1).otherwise(2).alias("dim"),
        say("/reports/sys", text(F.col("user_id")), name).alias("file"), history.alias("history"), body.alias("text"),
    ).withColumn("path", F.concat(F.lit("/reports/"), text(eid), F.substr("file", F.lit(9))))


def _dimension(spark, d):
    """Systems with at least 65 events are known."""
    users = table(spark, d, "events").groupBy("user_id").count()
    return users.select(F.concat(F.lit("sys"), F.col("user_id").cast("string")).alias("key"))


def _aliases(spark, d):
    users = table(spark, d, "events").select("user_id").distinct()
    n = F.col("user_id").cast("string")
    return users.select(F.concat(F.lit("old"), n).alias("raw_key"), F.concat(F.lit("sys"), n).alias("key"))


def report_best_version(spark, d):
    reports = composed_reports(spark, d).withColumn("shown", F.col("path")).withColumn("path", F.col("file"))
    scored = reports.withColumn("score", P.content_score(F.col("path"), F.col("text")))
    keyed = P.attach_keys(scored, _aliases(spark, d), _dimension(spark, d))
    narrow = keyed.select("key", F.col("shown").alias("path"), "modified", "event_id", "score")
    return P.best_version(narrow).select("key", "event_id", "score")


def report_params(spark, d):
    rows = P.report_rows(composed_reports(spark, d))
    return rows.select("event_id", "best_param1", "best_param2")


def report_scalars(spark, d):
    rows = P.report_rows(composed_reports(spark, d))
    return rows.select("event_id", "best_energy", "gp_uncertainty", "n_calls", "n_iterations",
                       F.col("converged").cast("int").alias("converged"))


def report_variables(spark, d):
    return composed_reports(spark, d).withColumn("v", P.variable_ranges(F.col("text"))).select(
        "event_id", F.size("v").alias("n_variables"), F.col("v")["a"]["lo"].alias("a_lo"), F.col("v")["a"]["hi"].alias("a_hi"),
        F.col("v")["c"]["hi"].alias("c_hi"))


def report_reference(spark, d):
    out = P.reference_summary(composed_reports(spark, d), "event_id")
    return out.select("event_id", F.try_element_at("best_params", F.lit("a")).alias("best_a"), "best_energy", "n_calls",
                      F.col("spin").cast("int").alias("spin"))


def trace_history(spark, d):
    reports = composed_reports(spark, d).withColumn("text", F.col("history"))
    return P.history_rows(reports, "event_id")


def trace_explode(spark, d):
    reports = composed_reports(spark, d).withColumn("text", F.col("history"))
    points = P.labelled_points(reports, "event_id")
    return points.select("event_id", "pos", F.get("params", F.lit(0)).alias("x"), F.get("params", F.lit(1)).alias("y"), "energy")


def _trace(spark, d):
    return table(spark, d, "events").withColumn("k", props_k()).select(
        "user_id", "event_id", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("energy"),
        (F.col("value") / 100.0).alias("std"), (F.col("k") / 1000.0).alias("improvement"))


ORDER = ("ts", "event_id")


def trace_running_best(spark, d):
    out = P.running_best(_trace(spark, d), "user_id", [F.col(c) for c in ORDER], "energy")
    return out.select("user_id", "event_id", "best_so_far", "n_calls", "n_labels")


def trace_convergence(spark, d):
    return P.convergence_points(_trace(spark, d), "user_id", [F.col(c) for c in ORDER], "std", "improvement",
                                max_std=0.3, max_improvement=0.06)


QUERIES = {f.__name__: f for f in (
    report_best_version, report_params, report_scalars, report_variables, report_reference, trace_history,
    trace_explode, trace_running_best, trace_convergence)}

_E = "e as (select *, cast(json_extract_string(props, '$.k') as integer) as k from events)"

ORACLES = {
    "report_best_version": f"""with {_E}, r as (
  select 'sys' || user_id as key, event_id, (case when k % 2 = 0 then 10 else 0 end) + 2 + (case when k % 3 <> 0 then 2 else 0 end) as score,
    ts, '/reports/' || event_id || '/sys' || user_id || case when event_id % 5 = 0 then '_report.txt' else '_qe_run_report.txt' end as path
  from e)
select key, event_id, score from (select *, row_number() over (partition by key order by score desc, ts desc, path) as rn from r) where rn = 1""",
    "report_params": f"""with {_E}, r as (select event_id, k, event_id % 6 as layout, (k % 90 + 1) + 0.25e0 as v1, k % 7 + 0.5e0 as v2,
  case when k % 3 = 0 then 1 else 2 end as dim from e)
select event_id, v1 as best_param1, case when dim = 1 then null when layout in (0, 2) then v2 when layout = 5 then v1 * 1.5e0 end as best_param2
from r""",
    "report_scalars": f"""with {_E}
select event_id, -(k + case event_id % 3 when 0 then 0.5e0 when 1 then 0.25e0 else 0.75e0 end) as best_energy,
  cast(case when event_id % 2 = 0 then '0.0' || k else '0.' || k end as double) as gp_uncertainty,
  case when event_id % 3 = 1 then k + 5 else k + 4 end as n_calls, k % 4 as n_iterations, k % 2 as converged from e""",
    "report_variables": f"""with {_E} select event_id, 2 as n_variables, k + 0.5e0 as a_lo, k + 1.5e0 as a_hi, 20e0 as c_hi from e""",
    "report_reference": f"""with {_E} select event_id, case when event_id % 6 = 0 then k % 90 + 1.25e0 end as best_a,
  case when event_id % 3 = 0 then -(k + 0.5e0) end as best_energy, case when event_id % 3 <> 1 then k + 4 end as n_calls,
  case when k % 5 = 0 then 1 else 0 end as spin from e""",
    "trace_history": f"""with {_E} select event_id, cast(i as integer) as iteration, 'w=' || i || '.5  v=' || k as params,
  -(i + 0.25e0) * 10 as energy, cast('0.0' || i as double) as std, cast(i * 3 as integer) as n_labels
from e, lateral (select unnest(range(1, k % 3 + 2)) as i)""",
    "trace_explode": f"""with {_E} select event_id, cast(i - 1 as integer) as pos, i + 0.5e0 as x, cast(k as double) as y, -(i + 0.125e0) as energy
from e, lateral (select unnest(range(1, k % 3 + 2)) as i)""",
    "trace_running_best": """select user_id, event_id, min(case when event_type <> 'error' then value end) over w as best_so_far,
  count(*) over w as n_calls, count(case when event_type <> 'error' then 1 end) over w as n_labels
from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)""",
    "trace_convergence": f"""with {_E}, n as (select user_id, value / 100e0 as std, k / 1000e0 as imp,
  row_number() over (partition by user_id order by ts, event_id) as it from e),
s as (select user_id, min(case when std < 0.3e0 and imp < 0.06e0 then it end) as s, max(it) as m from n group by user_id)
select user_id, coalesce(s, m) as stop_iteration, case when s is null then 0 else 1 end as converged from s""",
}
