"""Profiling, features and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsift import elements as EL
from runsift.operators import features as X
from runsift.operators import profile as P
from runsift.operators import splits as S
from runsift.plans.inputs import table
from runsift.plans.log_queries import LABELLED_SQL, labelled_records
from runsift.plans.model_inputs import RECORDS_SQL, run_records
from runsift.sources.sinks import split_quarantine

HELD = {"scf_not_converged"}


def profile_counts(spark, d):
    rows = labelled_records(spark, d).withColumns({
        "converged": F.col("failure_reason").isNull(),
        "job_done": F.coalesce(F.col("failure_reason"), F.lit("")) != "job_not_completed"})
    return P.flag_counts(rows, ["converged", "job_done"])


def profile_values(spark, d):
    rows = run_records(spark, d)
    return P.many_value_counts(rows, {
        "failure_reason": P.label_column("failure_reason", "success"), "material_id": P.label_column("material_id", "unknown"),
        "smearing": P.label_column("smearing", "unknown"), "ecutwfc": P.numeric_bucket("ecutwfc"),
        "ecutrho": P.numeric_bucket("ecutrho"), "mixing_beta": P.numeric_bucket("mixing_beta")})


def profile_missing(spark, d):
    return P.missing_counts(run_records(spark, d), [
        "material_id", "failure_reason", "ecutwfc", "ecutrho", "kpoints", "smearing", "mixing_beta", "pseudopotentials"])


def profile_coverage(spark, d):
    return P.key_coverage(run_records(spark, d), "pseudopotentials")


def profile_distribution(spark, d):
    rows = run_records(spark, d).withColumn("taxonomy", X.failure_taxonomy(X.failure_label(F.col("failure_reason"))))
    return P.class_distribution(rows, "material_id", "taxonomy")


def profile_top(spark, d):
    return P.top_values(P.value_counts(table(spark, d, "events").withColumn("u", F.col("user_id").cast("string")), "u"), 15)


def profile_quarantine(spark, d):
    kept, held = split_quarantine(labelled_records(spark, d), HELD)
    return P.quarantine_totals(kept, held, F.col("failure_reason").isNull())


def feat_casts(spark, d):
    return X.build_features(run_records(spark, d)).select(
        "record_id", "failure_label", "failure_taxonomy", "success", "material_id", "ecutwfc", "ecutrho", "k1", "k2", "k3",
        "kpoint_product", "smearing", "mixing_beta", "pseudo_family", "n_species", "elements")


def feat_dimension_moments(spark, d):
    return X.build_features(run_records(spark, d)).select(
        "record_id", *[F.round(c, 6).alias(c) for c in X.MOMENT_COLUMNS])


def feat_flags(spark, d):
    return X.build_features(run_records(spark, d)).select(
        "record_id", *[F.round(c, 9).alias(c) if c.endswith("fraction") else F.col(c) for c in X.FLAG_COLUMNS])


def feat_onehot(spark, d):
    rows = X.build_features(run_records(spark, d))
    return rows.select("record_id", *X.COUNT_COLUMNS, *[F.round(c, 9).alias(c) for c in X.FRACTION_COLUMNS])


def feat_ratios(spark, d):
    return X.build_features(run_records(spark, d)).select(
        "record_id", F.round("ecutrho_over_ecutwfc", 9).alias("ecutrho_over_ecutwfc"), *X.ABSENT_COLUMNS)


def feat_record_ids(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return X.number_records(docs, "path")


def split_stratified(spark, d):
    rows = run_records(spark, d).select("record_id", X.failure_label(F.col("failure_reason")).alias("label"))
    return S.stratified_split(rows, "label", "record_id")


def split_group(spark, d):
    return S.group_split(table(spark, d, "embeddings").select("vec_id", "label"), "label")


def split_repeated(spark, d):
    sizes = run_records(spark, d).groupBy("material_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return S.group_splits(sizes, "material_id").join(sizes, "material_id")


def split_row_membership(spark, d):
    rows = run_records(spark, d).select("record_id", "material_id")
    return S.with_test_splits(rows, "material_id").select("record_id", F.array_join("test_splits", ",").alias("test_splits"))


QUERIES = {f.__name__: f for f in (
    profile_counts, profile_values, profile_missing, profile_coverage, profile_distribution, profile_top,
    profile_quarantine, feat_casts, feat_dimension_moments, feat_flags, feat_onehot, feat_ratios, feat_record_ids,
    split_stratified, split_group, split_repeated, split_row_membership)}

_TAXONOMY = """case label when 'success' then 'success' when 'qe_error' then 'setup_error' when 'scf_not_converged' then
  'scf_not_converged' when 'job_not_completed' then 'runtime_incomplete' else 'unknown_failure' end"""
_ELEMENT_ROWS = ", ".join(
    f"('{s}', {r[0]}, {r[1]}e0, {r[2]}e0, {r[3]}e0, {int(s in EL.METALS)}, {int(s in EL.TRANSITION_METALS)})"
    for s, r in EL.ELEMENTS.items())
_MEMBERS = RECORDS_SQL + f""",
el as (select * from (values {_ELEMENT_ROWS}) as t(s, num, mass, en, rad, metal, trans)),
mem as (select record_id, unnest(symbols) as s from rr),
moments as (
  select record_id, avg(num) as atomic_number_mean, stddev_pop(num) as atomic_number_std, cast(min(num) as double) as atomic_number_min,
    cast(max(num) as double) as atomic_number_max, avg(mass) as atomic_mass_mean, stddev_pop(mass) as atomic_mass_std,
    avg(en) as electronegativity_mean, stddev_pop(en) as electronegativity_std, avg(rad) as atomic_radius_mean,
    stddev_pop(rad) as atomic_radius_std, count(*) as n_known, max(num) as heaviest
  from mem join el on mem.s = el.s group by record_id),
groups as (
  select record_id, count(*) filter (where s in {EL.METALS}) as n_metal, count(*) filter (where s in {EL.TRANSITION_METALS}) as n_trans
  from mem group by record_id)"""
_GROUP_SPLITS = """
gs as (select distinct material_id from rr),
sp as (select material_id, cast(range as integer) as split_id, row_number() over (partition by range
    order by md5((range + 42) || '|' || material_id), material_id) as r from gs, range(20)),
spl as (select split_id, material_id, case when r <= ceil((select count(*) from gs) * 0.2e0) then 1 else 0 end as is_test from sp)"""
_VALUES = lambda name, expr: f"select '{name}' as column_name, {expr} as value from rr"

ORACLES = {
    "profile_counts": f"""with {LABELLED_SQL} select count(*) as total, count(*) filter (where failure_reason is null) as converged,
  count(*) filter (where failure_reason is not null) as not_converged,
  count(*) filter (where coalesce(failure_reason, '') <> 'job_not_completed') as job_done,
  count(*) filter (where failure_reason = 'job_not_completed') as not_job_done from rec""",
    "profile_values": f"with {RECORDS_SQL}, v as (" + " union all ".join([
        _VALUES("failure_reason", "coalesce(failure_reason, 'success')"),
        _VALUES("material_id", "case when material_id = '' then 'unknown' else material_id end"),
        _VALUES("smearing", "smearing"), _VALUES("ecutwfc", "coalesce(printf('%g', ecutwfc), 'unknown')"),
        _VALUES("ecutrho", "coalesce(printf('%g', ecutrho), 'unknown')"), _VALUES("mixing_beta", "printf('%g', mixing_beta)"),
    ]) + ") select column_name, value, count(*) as n from v group by column_name, value",
    "profile_missing": f"""with {RECORDS_SQL}, c as (select
  count(*) filter (where material_id = '') as material_id, count(*) filter (where failure_reason is null) as failure_reason,
  count(*) filter (where record_id % 6 = 0) as ecutwfc, count(*) filter (where ecutrho is null) as ecutrho,
  count(*) filter (where record_id % 4 = 2) as kpoints, count(*) filter (where smearing = 'unknown') as smearing,
  0::bigint as mixing_beta, count(*) filter (where record_id % 25 = 1 and record_id % 10 <> 0) as pseudopotentials from rr)
unpivot c on columns(*) into name column_name value n_missing""",
    "profile_coverage": f"with {_MEMBERS} select s as key, count(*) as n from mem group by s",
    "profile_distribution": f"""with {RECORDS_SQL}, l as (select material_id, coalesce(failure_reason, 'success') as label from rr),
t as (select material_id, {_TAXONOMY} as c, count(*) as n from l group by 1, 2)
select material_id, cast(sum(n) as bigint) as total, string_agg(c || '=' || n, ', ' order by c) as distribution from t group by material_id""",
    "profile_top": """select cast(user_id as varchar) as value, count(*) as n from events group by 1
order by n desc, value limit 15""",
    "profile_quarantine": f"""with {LABELLED_SQL}
select count(*) filter (where coalesce(failure_reason, '') <> 'scf_not_converged') as n_main,
  count(*) filter (where failure_reason = 'scf_not_converged') as n_quarantined, count(*) as n_all,
  count(*) filter (where failure_reason is null) as n_main_success from rec""",
    "feat_casts": f"""with {RECORDS_SQL}, l as (select *, coalesce(failure_reason, 'success') as label from rr)
select record_id, label as failure_label, {_TAXONOMY} as failure_taxonomy, case when label = 'success' then 1 else 0 end as success,
  case when material_id = '' then 'unknown' else material_id end as material_id, ecutwfc, ecutrho, k1, k2, k3,
  k1 * k2 * k3 as kpoint_product, smearing, mixing_beta, lang as pseudo_family, cast(len(symbols) as integer) as n_species,
  case when len(symbols) = 0 then 'unknown' else array_to_string(symbols, ' ') end as elements from l""",
    "feat_dimension_moments": f"with {_MEMBERS} select rr.record_id, "
    + ", ".join(f"round({c}, 6) as {c}" for c in X.MOMENT_COLUMNS)
    + " from rr left join moments m on rr.record_id = m.record_id",
    "feat_flags": f"""with {_MEMBERS} select rr.record_id, round(n_metal / cast(n_known as double), 9) as metal_fraction,
  round(n_trans / cast(n_known as double), 9) as transition_metal_fraction, case when n_trans > 0 then 1 else 0 end as has_transition_metal,
  case when list_contains(symbols, 'O') then 1 else 0 end as has_oxygen, case when list_contains(symbols, 'H') then 1 else 0 end as has_hydrogen,
  case when list_contains(symbols, 'F') then 1 else 0 end as has_fluorine, case when list_contains(symbols, 'S') then 1 else 0 end as has_sulfur,
  case when heaviest >= 56 then 1 else 0 end as has_heavy_element
from rr left join moments m on rr.record_id = m.record_id left join groups g on rr.record_id = g.record_id""",
    "feat_onehot": f"with {RECORDS_SQL} select record_id, " + ", ".join(
        f"case when list_contains(symbols, '{s}') then 1 else 0 end as element_count_{s}, "
        f"case when list_contains(symbols, '{s}') then round(1e0 / len(symbols), 9) else 0e0 end as element_fraction_{s}"
        for s in EL.SYMBOLS) + " from rr",
    "feat_ratios": f"""with {RECORDS_SQL} select record_id, case when ecutwfc > 0 then round(ecutrho / ecutwfc, 9) end as ecutrho_over_ecutwfc,
  null::double as n_atoms, null::double as natoms_times_kpoints, null::double as natoms_times_ecutwfc, null::double as volume_per_atom from rr""",
    "feat_record_ids": """with p as (select doc_id, source || '/' || lang || '/' || doc_id as path from documents)
select doc_id, path, row_number() over (order by path) - 1 as record_id from p""",
    "split_stratified": f"""with {RECORDS_SQL}, l as (select record_id, coalesce(failure_reason, 'success') as label from rr),
r as (select *, row_number() over (partition by label order by md5('42|' || record_id), record_id) as r,
  count(*) over (partition by label) as n from l)
select label, record_id, case when r <= floor(n * 0.2e0 + 0.5e0) then 1 else 0 end as is_test from r""",
    "split_group": """with g as (select distinct label from embeddings),
r as (select label, row_number() over (order by md5('42|' || label), label) as r from g)
select e.label, e.vec_id, case when r <= ceil((select count(*) from g) * 0.2e0) then 1 else 0 end as is_test
from embeddings e join r on e.label = r.label""",
    "split_repeated": f"""with {RECORDS_SQL}, {_GROUP_SPLITS}, n as (select material_id, count(*) as n_rows from rr group by 1)
select split_id, spl.material_id, is_test, n_rows from spl join n on n.material_id = spl.material_id""",
    "split_row_membership": f"""with {RECORDS_SQL}, {_GROUP_SPLITS},
h as (select material_id, string_agg(cast(split_id as varchar), ',' order by split_id) filter (where is_test = 1) as t from spl group by 1)
select record_id, coalesce(t, '') as test_splits from rr join h on h.material_id = rr.material_id""",
}
