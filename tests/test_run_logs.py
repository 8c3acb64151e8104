"""Log facts on written fixtures."""

import hashlib

import pytest
from pyspark.sql import functions as F

from runsift.functions.text import plain_spaces
from runsift.operators import run_logs as L
from runsift.plans import log_queries
from runsift.schemas import RUN_RECORD
from runsift.sources.sinks import split_quarantine

INPUT = """&SYSTEM
  ecutwfc = 20
  ecutwfc = 45.0
  ecutrho = 360
  smearing = 'mp'
  mixing_beta = 0.4
/
ATOMIC_SPECIES
 Mg 24.305 Mg.pbe-spnl-kjpaw_psl.1.0.0.UPF
 O  15.999 O.old.UPF
 O  15.999 O.pbe-n-kjpaw_psl.1.0.0.UPF
 short line
K_POINTS automatic
 6 6   4 0 0 0
K_POINTS automatic
 1 1 1 0 0 0
"""
GOOD = """     iteration #  1
     iteration #  2
!    total energy              =     -40.0 Ry
!    total energy              =     -42.5 Ry
     convergence has been achieved in   2 iterations
     Total force =     0.000123
     total stress  P=        1.23
     PWSCF        :   1m  2.00s CPU     1m   3.00s WALL
     JOB DONE.
"""
CASES = {
    "good": (INPUT, GOOD),
    "namelist": (None, "Error in routine read_namelists (1):\n could not find namelist &control"),
    "unconverged": (None, "iteration # 79\niteration # 80\n total energy = -1.5 Ry\nconvergence NOT achieved\nJOB DONE."),
    "overlap": (None, "atoms # 1 and # 2 overlap!\nError in routine check_atoms"),
    "unstable": (None, "S matrix not positive definite"),
    "error_pair": (None, "from readpp : error # 2"),
    "from_only": (None, "from readpp"),
    "empty": (None, ""),
    "listing": (None, "number of k points=   12\nPseudoPot. # 1 for Si read from file:\n ./pseudo/Si_ONCV.upf"),
    "override": ("ecutwfc = 30", "ecutwfc=50\nK_POINTS automatic\n2 2 2"),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(f"/w/qe_runs/{k}_pid7_attempt2/espresso.pwo", None, i, o) for k, (i, o) in CASES.items()]
    runs = spark.createDataFrame(rows, "output_path string, input_path string, input_text string, output_text string")
    frame = L.parse_runs(runs, "/w")
    assert [f.name for f in frame.schema.fields] == [f.name for f in RUN_RECORD.fields]
    return {r["material_id"]: r for r in frame.collect()}


def test_good_run(parsed):
    r = parsed["good"]
    assert r["converged"] and r["job_done"] and r["failure_reason"] is None
    assert r["scf_iterations"] == 2 and r["final_energy_ry"] == -42.5
    assert r["energy_ev"] == pytest.approx(-42.5 * 13.605693122994)
    assert (r["max_force"], r["pressure_kbar"], r["wall_time"]) == (0.000123, 1.23, "1m 3.00s WALL")
    assert (r["ecutwfc"], r["ecutrho"], r["smearing"], r["mixing_beta"]) == (45.0, 360.0, "mp", 0.4)
    assert r["kpoints"] == "6 6 4 0 0 0"
    assert r["pseudopotentials"] == {"Mg": "Mg.pbe-spnl-kjpaw_psl.1.0.0.UPF", "O": "O.pbe-n-kjpaw_psl.1.0.0.UPF"}
    assert r["pseudo_family"] == "PSLibrary" and len(r["calculation_hash"]) == 64
    assert r["qe_output_path"] == "qe_runs/good_pid7_attempt2/espresso.pwo"


@pytest.mark.parametrize("name, reason", [
    ("namelist", "invalid_input_namelist"), ("unconverged", "scf_not_converged"), ("overlap", "geometry_overlap"),
    ("unstable", "geometry_instability"), ("error_pair", "qe_error"), ("from_only", "job_not_completed"),
    ("empty", "job_not_completed")])
def test_reasons(parsed, name, reason):
    assert parsed[name]["failure_reason"] == reason and not parsed[name]["converged"]


def test_failed_runs_keep_their_facts(parsed):
    r = parsed["unconverged"]
    assert (r["job_done"], r["scf_iterations"], r["final_energy_ry"]) == (True, 80, -1.5)
    assert parsed["namelist"]["final_energy_ry"] is None


def test_fallbacks(parsed):
    r = parsed["listing"]
    assert r["kpoints"] == "12 k-points" and r["pseudopotentials"] == {"Si": "Si_ONCV.upf"} and r["pseudo_family"] == "ONCV"
    assert parsed["empty"]["pseudopotentials"] == {} and parsed["empty"]["pseudo_family"] is None
    assert parsed["override"]["ecutwfc"] == 50.0 and parsed["override"]["kpoints"] == "2 2 2"


def test_parse_needs_no_exchange(spark):
    runs = spark.createDataFrame([("a/b/c", None, None, "x")],
                                 "output_path string, input_path string, input_text string, output_text string")
    plan = L.parse_runs(runs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_quarantine_keeps_null_reasons(spark):
    rows = spark.createDataFrame([("a", None), ("b", "qe_error")], "id string, failure_reason string")
    kept, held = split_quarantine(rows, {"qe_error"})
    assert [r["id"] for r in kept.collect()] == ["a"] and [r["id"] for r in held.collect()] == ["b"]


def test_group_ids(spark):
    paths = ["/x/qe_runs_bulk_li2/run1/espresso.pwo", "/x/qe_runs/h2_r0p9_pid3_attempt1/espresso.pwo", "run/espresso.pwo", "/x/mat/run/espresso.pwo"]
    frame = spark.createDataFrame([(p,) for p in paths], "p string").select(L.group_from_path(F.col("p")).alias("g"))
    assert [r["g"] for r in frame.collect()] == ["bulk_li2", "h2_r0p9", "run", "mat"]


def test_unicode_white_space(spark):
    """Pages and no-break spaces: white space to the patterns, line ends to the species block, kept by hash and flags."""
    source = "ATOMIC_SPECIES\x0c\xa0Mg\u20031.0 Mg.paw.UPF\x85 O 2.0\xa0O.paw.UPF\u2028\u2028 H 1.0 H.UPF\n ecutwfc\xa0=\u2009" + "30"
    output = "!\xa0 total energy\u2003=\xa0-4.5\xa0Ry\n PWSCF : a\x85b CPU 1m\xa0" + "3.0s WALL\n atoms\xa0#\xa01 overlap JOB DONE"
    runs = spark.createDataFrame([("/a/run/espresso.pwo", None, source, output)],
                                 "output_path string, input_path string, input_text string, output_text string")
    row = L.parse_runs(runs).first()
    assert row["pseudopotentials"] == {"Mg": "Mg.paw.UPF", "O": "O.paw.UPF"}
    assert (row["ecutwfc"], row["final_energy_ry"], row["wall_time"]) == (30.0, -4.5, "1m 3.0s WALL")
    assert row["failure_reason"] is None and row["calculation_hash"] == hashlib.sha256((source + output).encode()).hexdigest()


def test_odd_white_space_in_ascii_and_other_texts(spark):
    texts = ["a\x0bb\x0cc\x1cd\x1de\x1ef\x1fg", "plain text\nonly\t\r", "é\x0b x", " a　b\x85c", "", None, "naïve"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(plain_spaces(F.col("t"))).collect()]
    assert got == ["a\x0bb\x0bc\x0bd\x0be\x0bf g", "plain text\nonly\t\r", "é\x0b x", "\x0ba b\x0bc", "", None, "naïve"]


def test_logs_of_one_row_group_are_parsed_by_all_cores(spark, tmp_path):
    spark.range(400).selectExpr(
        "id as event_id", "id % 9 as user_id", "'view' as event_type", "cast(id as double) as value", "'{\"k\": 3}' as props"
    ).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    logs = log_queries.composed_logs(spark, str(tmp_path))
    sizes = [r["count"] for r in logs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 400 and len(sizes) >= min(4, spark.sparkContext.defaultParallelism)
