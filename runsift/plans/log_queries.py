"""Run-log extraction: logs are composed from event rows, then parsed back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from runsift.constants import RY_TO_EV
from runsift.functions.text import canonical_json
from runsift.operators import run_logs as L
from runsift.plans.inputs import dealt, props_k, table
from runsift.schemas import RUN_RECORD
from runsift.session import ensure_checkpoint_dir
from runsift.sources.runs import assemble_runs
from runsift.sources.sinks import split_quarantine, write_fixed
from runsift.sources.tables import text_columns, typed_records

SYMBOLS = ("H", "Li", "O", "Mg", "Si", "Cu", "Mo")
SUFFIXES = ("pbe-n-kjpaw_psl.1.0.0.UPF", "ONCV_PBE.upf", "sssp.UPF", "paw.upf", "rrkjus.UPF", "gth.UPF", "pbe-uspp.UPF")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _lines(*parts):
    return F.concat_ws("\n", *[p if not isinstance(p, str) else F.lit(p) for p in parts])


def composed_logs(spark, d):
    """One log per event: input with settings and species, output with energies, markers and messages."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", props_k().alias("k"))
    e = dealt(events, "event_id")
    k, eid, v = F.col("k"), F.col("event_id"), F.col("value").cast("string")
    text = lambda c: c.cast("string")
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    s1, s2 = _pick(SYMBOLS, eid % 7), _pick(SYMBOLS, (eid + 1 + k % 5) % 7)
    f1, f2 = _pick(SUFFIXES, k % 7), _pick(SUFFIXES, (k + eid) % 7)
    block = F.when(eid % 4 != 0, _lines(
        "ATOMIC_SPECIES", say("  ", s1, "  1.0  stale.UPF"), say("  ", s1, "  1.0  ", s1, ".", f1),
        say("  ", s2, "  2.0  ", s2, ".", f2), "  short line", "ATOMIC_POSITIONS angstrom",
        say("  ", s1, "  0.0  0.0  0.0")))
    mesh = F.when(eid % 3 == 0, _lines("K_POINTS automatic", say(" ", text(k % 8 + 1), "  4   ", text(eid % 5 + 1), " 0 0 0"),
                                       "K_POINTS automatic", " 9 9 9 0 0 0"))
    settings = _lines("&SYSTEM", "  ecutwfc = 10", say("  ECUTWFC = ", text(k + 20)), say("  ecutrho = ", text(8 * (k + 20)), ".5"),
                      say("  smearing = '", _pick(("mp", "gaussian", "m-v"), k % 3), "'"), say("  mixing_beta=0.", text(k % 9 + 1)))
    steps = F.array_join(F.transform(F.sequence(F.lit(1), k % 6 + 1),
                                     lambda i: say("     iteration #  ", text(i), "     ecut=    60.00 Ry")), "\n")
    listed = F.when(eid % 8 != 0, say("     PseudoPot. # 1 for ", s1, " read from file:\n     ./pseudo/", s1, ".", f1))
    c = eid % 9
    message = (
        F.when(c == 1, "     convergence NOT achieved after 80 iterations: stopping\n     JOB DONE.")
        .when(c == 2, " could not find namelist &electrons\n Error in routine read_namelists (1):")
        .when(c == 3, " atoms #   1 and #   2 overlap!\n Error in routine check_atoms (1):")
        .when(c == 4, " atoms too close\n")
        .when(c == 5, " Error in routine davcio (10):")
        .when(c == 6, " from readpp : error #         2")
        .when(c == 7, " stopped by the scheduler")
        .when(c == 8, " from cdiaghg : no message")
        .otherwise("     JOB DONE."))
    output = _lines(
        listed, steps, say("     total energy              =     -", v, " Ry"),
        F.when(eid % 2 == 0, say("!    total energy              =     -", text(k + 1), ".25 Ry\n!    total energy  =  -",
                                 text(k + 2), ".5 Ry")),
        F.when(eid % 5 != 0, say("     Total force =     0.0", text(k), "     Total SCF correction =     0.000001")),
        F.when(k % 2 == 0, say("          total   stress  (Ry/bohr**3)     P=     -", text(k), ".5")),
        F.when(eid % 6 == 0, say("     convergence has been achieved in  ", text(k % 6 + 1), " iterations")),
        F.when(eid % 3 != 0, say("     number of k points=    ", text(k + 1))),
        message,
        F.when(k % 4 != 0, say("     PWSCF        :   ", text(k), ".10s CPU     1m  ", text(k), ".00s  WALL")))
    return e.select(
        "event_id",
        say("/data/qe_runs_", text(F.col("user_id")), "/run", text(eid), "/espresso.pwo").alias("output_path"),
        F.lit(None).cast("string").alias("input_path"),
        _lines(settings, block, mesh).alias("input_text"), output.alias("output_text"))


def log_parse_core(spark, d):
    logs = composed_logs(spark, d)
    out, whole = F.col("output_text"), L.settings_text(F.col("input_text"), F.col("output_text"))
    energy = L.final_energy(out)
    return logs.select(
        "event_id", energy.alias("final_energy_ry"), F.round(energy * RY_TO_EV, 9).alias("energy_ev"),
        L.last_double(out, L.FORCE).alias("max_force"), L.last_double(out, L.PRESSURE).alias("pressure_kbar"),
        L.wall_time(out).alias("wall_time"), L.number_setting(whole, "ecutwfc").alias("ecutwfc"),
        L.number_setting(whole, "ecutrho").alias("ecutrho"), L.text_setting(whole, "smearing").alias("smearing"),
        L.number_setting(whole, "mixing_beta").alias("mixing_beta"))


def log_failure_reason(spark, d):
    out = F.col("output_text")
    return composed_logs(spark, d).select(
        "event_id", L.job_done(out).cast("int").alias("job_done"), L.converged(out).cast("int").alias("converged"),
        L.failure_reason(out).alias("failure_reason"))


def log_iterations(spark, d):
    return composed_logs(spark, d).select("event_id", L.iterations(F.col("output_text")).alias("scf_iterations"))


def log_species_map(spark, d):
    logs = composed_logs(spark, d)
    species = L.species_files(L.settings_text(F.col("input_text"), F.col("output_text")))
    return logs.withColumn("m", species).select(
        "event_id", F.size("m").alias("n_species"), F.array_join(F.array_sort(F.map_keys("m")), " ").alias("species"),
        canonical_json(F.col("m")).alias("files"), L.family_label(F.col("m")).alias("pseudo_family"))


def log_grid_setting(spark, d):
    return composed_logs(spark, d).select(
        "event_id", L.mesh_setting(L.settings_text(F.col("input_text"), F.col("output_text"))).alias("kpoints"))


def log_records(spark, d):
    """The whole run record of every log; the map as canonical text."""
    return _shown(L.parse_runs(composed_logs(spark, d), "/data"))


def _shown(records):
    flags = {c: F.col(c).cast("int") for c in ("converged", "job_done")}
    return records.withColumns({**flags, "energy_ev": F.round("energy_ev", 9), "pseudopotentials": canonical_json(F.col("pseudopotentials"))})


def log_records_csv(spark, d):
    """The run records, written as text columns and read back to their types."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    write_fixed(L.parse_runs(composed_logs(spark, d), "/data"), RUN_RECORD.names, path, "csv")
    records = typed_records(text_columns(spark, path, RUN_RECORD.names))
    return _shown(records)


def log_hash(spark, d):
    source = F.when(F.col("doc_id") % 3 != 0, F.concat_ws("/", "lang", "source"))
    return table(spark, d, "documents").select(
        "doc_id", L.content_hash(source, F.col("text")).alias("calculation_hash"))


def path_ids(spark, d):
    run = F.col("doc_id").cast("string")
    path = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("/data/qe_runs_"), "source", F.lit("/run"), run, F.lit("/espresso.pwo")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("/data/qe_runs/"), "source", F.lit("_"), "lang", F.lit("_pid"), run,
                                                 F.lit("_attempt1/espresso.pwo")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("/data/qe_runs/"), "source", F.lit("_attempt2/espresso.pwo")))
        .otherwise(F.concat(F.lit("/else/"), "lang", F.lit("/run"), run, F.lit("/espresso.pwo"))))
    docs = table(spark, d, "documents").withColumn("path", path)
    return docs.select("doc_id", L.group_from_path(F.col("path")).alias("material_id"),
                       L.display_path(F.col("path"), "/data").alias("shown"))


def log_sidecars(spark, d):
    """Orders are outputs, line items one and two are the optional diagnostics, other items are other files."""
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    folder = lambda c: F.concat(F.lit("/runs/"), F.col(c).cast("string"))
    outputs = orders.select(
        folder("o_orderkey").alias("run_dir"), F.lit("espresso.pwo").alias("file_name"),
        F.when(F.col("o_orderstatus") == "F", "JOB DONE.").when(F.col("o_orderstatus") == "O", "").otherwise("running")
        .alias("text"))
    inputs = orders.where("o_totalprice > 200000").select(
        folder("o_orderkey").alias("run_dir"), F.lit("espresso.pwi").alias("file_name"), F.lit("&control").alias("text"))
    notes = items.select(
        folder("l_orderkey").alias("run_dir"),
        F.when(F.col("l_linenumber") == 1, "espresso.err").when(F.col("l_linenumber") == 2, "CRASH").otherwise("notes.txt")
        .alias("file_name"),
        F.when(F.col("l_returnflag") == "R", "atoms # 1 and # 2 overlap")
        .when(F.col("l_returnflag") == "A", "").otherwise("Error in routine x").alias("text"))
    runs = assemble_runs(outputs.unionByName(inputs).unionByName(notes))
    return runs.select("output_path", "input_path", "output_text", L.failure_reason(F.col("output_text")).alias("failure_reason"))


def labelled_records(spark, d):
    """Run records from documents and labels: group = source, family = lang, cause from the label pair."""
    docs, labels = table(spark, d, "documents").drop("text"), table(spark, d, "labels")
    reason = (
        F.when(F.col("quality") == 1, F.lit(None).cast("string"))
        .when(F.col("toxic") == 1, "job_not_completed").when(F.col("toxic") == 0, "qe_error")
        .otherwise("scf_not_converged"))
    return docs.join(labels, "doc_id", "left").withColumn("failure_reason", reason)


def quarantine_split(spark, d):
    kept, held = split_quarantine(labelled_records(spark, d), {"job_not_completed", "scf_not_converged"})
    both = kept.withColumn("quarantined", F.lit(0)).unionByName(held.withColumn("quarantined", F.lit(1)))
    return both.select("doc_id", "source", "failure_reason", "quarantined")


QUERIES = {f.__name__: f for f in (
    log_parse_core, log_failure_reason, log_iterations, log_species_map, log_grid_setting, log_records, log_records_csv, log_hash, path_ids,
    log_sidecars, quarantine_split)}

_E = "e as (select *, cast(json_extract_string(props, '$.k') as integer) as k from events)"
_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"

LABELLED_SQL = """
rec as (select d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic,
  case when quality = 1 then null when toxic = 1 then 'job_not_completed' when toxic = 0 then 'qe_error'
    else 'scf_not_converged' end as failure_reason
  from documents d left join labels l on d.doc_id = l.doc_id)"""

ORACLES = {
    "log_parse_core": f"""with {_E}, f as (select *, case when event_id % 2 = 0 then -(k + 2.5e0) else -value end as en from e)
select event_id, en as final_energy_ry, round(en * {RY_TO_EV}e0, 9) as energy_ev,
  case when event_id % 5 <> 0 then cast('0.0' || k as double) end as max_force,
  case when k % 2 = 0 then -(k + 0.5e0) end as pressure_kbar,
  case when k % 4 <> 0 then '1m ' || k || '.00s WALL' end as wall_time,
  cast(k + 20 as double) as ecutwfc, 8 * (k + 20) + 0.5e0 as ecutrho,
  list_extract(['mp', 'gaussian', 'm-v'], k % 3 + 1) as smearing, cast('0.' || (k % 9 + 1) as double) as mixing_beta
from f""",
    "log_failure_reason": """select event_id, case when event_id % 9 in (0, 1) then 1 else 0 end as job_done,
  case when event_id % 9 = 0 then 1 else 0 end as converged,
  list_extract([null, 'scf_not_converged', 'invalid_input_namelist', 'geometry_overlap', 'geometry_instability', 'qe_error',
    'qe_error', 'job_not_completed', 'job_not_completed'], cast(event_id % 9 + 1 as integer)) as failure_reason from events""",
    "log_iterations": f"with {_E} select event_id, k % 6 + 1 as scf_iterations from e",
    "log_species_map": f"""with {_E},
p as (select event_id, list_extract({_LIST(SYMBOLS)}, cast(event_id % 7 + 1 as integer)) as s1,
  list_extract({_LIST(SYMBOLS)}, cast((event_id + 1 + k % 5) % 7 + 1 as integer)) as s2,
  list_extract({_LIST(SUFFIXES)}, k % 7 + 1) as f1, list_extract({_LIST(SUFFIXES)}, cast((k + event_id) % 7 + 1 as integer)) as f2 from e),
r as (
  select event_id, s1 as s, s1 || '.' || f1 as f, 1 as pos from p where event_id % 4 <> 0 or event_id % 8 <> 0
  union all select event_id, s2, s2 || '.' || f2, 2 from p where event_id % 4 <> 0),
q as (select event_id, count(*) as n, string_agg(s, ' ' order by s) as species,
    '{{' || string_agg('"' || s || '":"' || f || '"', ',' order by s) || '}}' as files, lower(string_agg(f, ' ' order by pos)) as names
  from r group by event_id)
select p.event_id, cast(coalesce(n, 0) as integer) as n_species, coalesce(species, '') as species, coalesce(files, '{{}}') as files,
  case when n is null then null when names like '%sssp%' then 'SSSP' when names like '%psl%' then 'PSLibrary'
    when names like '%oncv%' then 'ONCV' when names like '%paw%' then 'PAW'
    when names like '%uspp%' or names like '%rrkjus%' then 'USPP' else 'mixed_or_unknown' end as pseudo_family
from p left join q on p.event_id = q.event_id""",
    "log_grid_setting": f"""with {_E} select event_id, case when event_id % 3 = 0
  then (k % 8 + 1) || ' 4 ' || (event_id % 5 + 1) || ' 0 0 0' else (k + 1) || ' k-points' end as kpoints from e""",
    "log_hash": """select doc_id, sha256(case when doc_id % 3 <> 0 then lang || '/' || source else '' end || text)
  as calculation_hash from documents""",
    "path_ids": """select doc_id, case doc_id % 4 when 0 then source when 1 then source || '_' || lang when 2 then source else lang end as material_id,
  case doc_id % 4 when 0 then 'qe_runs_' || source || '/run' || doc_id || '/espresso.pwo'
    when 1 then 'qe_runs/' || source || '_' || lang || '_pid' || doc_id || '_attempt1/espresso.pwo'
    when 2 then 'qe_runs/' || source || '_attempt2/espresso.pwo'
    else '/else/' || lang || '/run' || doc_id || '/espresso.pwo' end as shown from documents""",
    "log_sidecars": """
with n as (select l_orderkey, l_linenumber, max(case l_returnflag when 'R' then 'atoms # 1 and # 2 overlap' when 'A' then ''
    else 'Error in routine x' end) as t from lineitem where l_linenumber <= 2 group by 1, 2),
r as (select o_orderkey, o_totalprice, case o_orderstatus when 'F' then 'JOB DONE.' when 'O' then '' else 'running' end as o, a.t as a, b.t as b
  from orders left join n a on a.l_orderkey = o_orderkey and a.l_linenumber = 1
  left join n b on b.l_orderkey = o_orderkey and b.l_linenumber = 2),
x as (select *, concat_ws(chr(10), nullif(o, ''), nullif(a, ''), nullif(b, '')) as output_text from r)
select '/runs/' || o_orderkey || '/espresso.pwo' as output_path,
  case when o_totalprice > 200000 then '/runs/' || o_orderkey || '/espresso.pwi' end as input_path, output_text,
  case when output_text like '%JOB DONE%' then null when output_text like '%overlap%' then 'geometry_overlap'
    when output_text like '%Error in routine%' then 'qe_error' else 'job_not_completed' end as failure_reason from x""",
    "quarantine_split": f"""with {LABELLED_SQL} select doc_id, source, failure_reason,
  case when coalesce(failure_reason, '') in ('job_not_completed', 'scf_not_converged') then 1 else 0 end as quarantined from rec""",
}

_TEXTS = f"""t as (
  select *, list_extract({_LIST(SYMBOLS)}, cast(event_id % 7 + 1 as integer)) as s1,
    list_extract({_LIST(SYMBOLS)}, cast((event_id + 1 + k % 5) % 7 + 1 as integer)) as s2,
    list_extract({_LIST(SUFFIXES)}, k % 7 + 1) as f1, list_extract({_LIST(SUFFIXES)}, cast((k + event_id) % 7 + 1 as integer)) as f2 from e),
texts as (
  select event_id, user_id,
    concat_ws(chr(10), '&SYSTEM', '  ecutwfc = 10', '  ECUTWFC = ' || (k + 20), '  ecutrho = ' || (8 * (k + 20)) || '.5',
      '  smearing = ''' || list_extract(['mp', 'gaussian', 'm-v'], k % 3 + 1) || '''', '  mixing_beta=0.' || (k % 9 + 1),
      case when event_id % 4 <> 0 then concat_ws(chr(10), 'ATOMIC_SPECIES', '  ' || s1 || '  1.0  stale.UPF', '  ' || s1 || '  1.0  ' || s1 || '.' || f1,
        '  ' || s2 || '  2.0  ' || s2 || '.' || f2, '  short line', 'ATOMIC_POSITIONS angstrom', '  ' || s1 || '  0.0  0.0  0.0') end,
      case when event_id % 3 = 0 then concat_ws(chr(10), 'K_POINTS automatic', ' ' || (k % 8 + 1) || '  4   ' || (event_id % 5 + 1) || ' 0 0 0',
        'K_POINTS automatic', ' 9 9 9 0 0 0') end) as input_text,
    concat_ws(chr(10),
      case when event_id % 8 <> 0 then '     PseudoPot. # 1 for ' || s1 || ' read from file:' || chr(10) || '     ./pseudo/' || s1 || '.' || f1 end,
      array_to_string(list_transform(range(1, k % 6 + 2), lambda i: '     iteration #  ' || i || '     ecut=    60.00 Ry'), chr(10)),
      '     total energy              =     -' || value || ' Ry',
      case when event_id % 2 = 0 then '!    total energy              =     -' || (k + 1) || '.25 Ry' || chr(10) || '!    total energy  =  -' || (k + 2) || '.5 Ry' end,
      case when event_id % 5 <> 0 then '     Total force =     0.0' || k || '     Total SCF correction =     0.000001' end,
      case when k % 2 = 0 then '          total   stress  (Ry/bohr**3)     P=     -' || k || '.5' end,
      case when event_id % 6 = 0 then '     convergence has been achieved in  ' || (k % 6 + 1) || ' iterations' end,
      case when event_id % 3 <> 0 then '     number of k points=    ' || (k + 1) end,
      case event_id % 9
        when 1 then '     convergence NOT achieved after 80 iterations: stopping' || chr(10) || '     JOB DONE.'
        when 2 then ' could not find namelist &electrons' || chr(10) || ' Error in routine read_namelists (1):'
        when 3 then ' atoms #   1 and #   2 overlap!' || chr(10) || ' Error in routine check_atoms (1):'
        when 4 then ' atoms too close' || chr(10) when 5 then ' Error in routine davcio (10):'
        when 6 then ' from readpp : error #         2' when 7 then ' stopped by the scheduler'
        when 8 then ' from cdiaghg : no message' else '     JOB DONE.' end,
      case when k % 4 <> 0 then '     PWSCF        :   ' || k || '.10s CPU     1m  ' || k || '.00s  WALL' end) as output_text
  from t)"""

ORACLES["log_records"] = f"""with {_E}, {_TEXTS}
select cast(user_id as varchar) as material_id, cast(null as varchar) as qe_input_path,
  'qe_runs_' || user_id || '/run' || texts.event_id || '/espresso.pwo' as qe_output_path, f.converged, f.job_done, i.scf_iterations,
  c.final_energy_ry, c.energy_ev, c.max_force, c.pressure_kbar, c.wall_time, f.failure_reason, c.ecutwfc, c.ecutrho, g.kpoints, c.smearing,
  c.mixing_beta, s.pseudo_family, s.files as pseudopotentials, sha256(input_text || output_text) as calculation_hash
from texts join ({ORACLES["log_parse_core"]}) c on c.event_id = texts.event_id
join ({ORACLES["log_failure_reason"]}) f on f.event_id = texts.event_id
join ({ORACLES["log_iterations"]}) i on i.event_id = texts.event_id
join ({ORACLES["log_species_map"]}) s on s.event_id = texts.event_id
join ({ORACLES["log_grid_setting"]}) g on g.event_id = texts.event_id"""
ORACLES["log_records_csv"] = ORACLES["log_records"]
