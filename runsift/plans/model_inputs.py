"""Run records and scored rows derived from documents, labels and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsift import elements as EL
from runsift.plans.inputs import props_k, table
from runsift.plans.log_queries import LABELLED_SQL, labelled_records

# One known transition metal outside the element table and one unknown name.
DRAWN_SYMBOLS = (*EL.SYMBOLS, "Zr", "Xx")


def run_records(spark, d):
    """Run records with text columns, as read from a record file."""
    r = labelled_records(spark, d)
    n, i = F.col("n_chars"), F.col("doc_id")
    names = F.array(*[F.lit(s) for s in DRAWN_SYMBOLS])
    pick = lambda x: F.element_at(names, (x % len(DRAWN_SYMBOLS) + 1).cast("int"))
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    text = lambda c: c.cast("string")
    species = say('{"', pick(n), '":"a.UPF","', pick(F.floor(n / 33)), '":"b.UPF","', pick(i), '":"c.UPF"}')
    return r.select(
        F.col("doc_id").alias("record_id"), "lang", "failure_reason",
        F.when(i % 11 == 0, "").otherwise(F.col("source")).alias("material_id"),
        F.when(i % 6 == 0, "").when(i % 6 == 1, "bad").when(i % 6 == 2, "0.0").otherwise(text(n % 50 + 20)).alias("ecutwfc"),
        F.when(i % 7 != 0, say(text(n % 400), ".5")).alias("ecutrho"),
        F.when(i % 4 == 0, say("4 ", text(n % 5 + 1), " 2 0 0 0")).when(i % 4 == 1, say(text(n % 90), " k-points"))
        .when(i % 4 == 2, "").otherwise("x 3").alias("kpoints"),
        F.when(i % 5 == 0, "").otherwise("mp").alias("smearing"),
        say("0.", text(n % 9)).alias("mixing_beta"), F.col("lang").alias("pseudo_family"),
        F.when(i % 10 == 0, "{oops").when(i % 25 == 1, "").otherwise(species).alias("pseudopotentials"))


RECORDS_SQL = LABELLED_SQL + f""",
names as (select {list(DRAWN_SYMBOLS)} as names),
rr as (
  select doc_id as record_id, lang, failure_reason, n_chars as n, case when doc_id % 11 = 0 then '' else source end as material_id,
    case when doc_id % 6 in (0, 1) then null when doc_id % 6 = 2 then 0e0 else cast(n_chars % 50 + 20 as double) end as ecutwfc,
    case when doc_id % 7 <> 0 then n_chars % 400 + 0.5e0 end as ecutrho,
    case when doc_id % 4 = 0 then 4 when doc_id % 4 = 1 then cast(n_chars % 90 as integer) else 0 end as k1,
    case when doc_id % 4 = 0 then cast(n_chars % 5 + 1 as integer) when doc_id % 4 = 3 then 3 else 0 end as k2,
    case when doc_id % 4 = 0 then 2 else 0 end as k3, case when doc_id % 5 = 0 then 'unknown' else 'mp' end as smearing,
    cast('0.' || (n_chars % 9) as double) as mixing_beta,
    case when doc_id % 10 = 0 or doc_id % 25 = 1 then [] else list_sort(list_distinct([
      list_extract(names, cast(n_chars % 33 + 1 as integer)), list_extract(names, cast((n_chars // 33) % 33 + 1 as integer)),
      list_extract(names, cast(doc_id % 33 + 1 as integer))])) end as symbols
  from rec, names)"""


def scored(spark, d):
    """Scored rows: true failure and a risk that leans towards it; split 7 holds failures only."""
    failed = (F.col("event_type") == "error").cast("int")
    return table(spark, d, "events").select(
        F.col("event_id").alias("record_id"), failed.alias("true_failure"), (1 - failed).alias("success"),
        F.when((failed == 1) & (F.col("value") > 200), 7).otherwise(F.col("event_id") % 7).cast("int").alias("split_id"), F.col("user_id").cast("string").alias("material_id"),
        F.round((props_k() / 100.0) * 0.6 + failed * 0.15, 4).alias("risk"))


SCORED_SQL = """
sc as (
  select event_id as record_id, f as true_failure, 1 - f as success, cast(case when f = 1 and value > 200 then 7 else event_id % 7 end as integer) as split_id,
    cast(user_id as varchar) as material_id, round((k / 100e0) * 0.6e0 + f * 0.15e0, 4) as risk
  from (select *, case when event_type = 'error' then 1 else 0 end as f,
    cast(json_extract_string(props, '$.k') as integer) as k from events))"""
