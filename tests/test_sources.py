"""Readers and writers on temporary folders."""

import os

import pytest
from pyspark.sql import functions as F

from runsift.operators import run_logs as L
from runsift.schemas import RUN_RECORD
from runsift.sources.runs import scan_runs
from runsift.sources.sinks import public_subset, write_fixed, write_quarantined, write_summary
from runsift.sources.tables import grid_rows, text_columns, typed_records

COLUMNS = [f.name for f in RUN_RECORD.fields]


@pytest.fixture
def tree(tmp_path):
    def write(path, text):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text if isinstance(text, bytes) else text.encode())

    write("qe_runs/h2_r0p900000_pid1_attempt1/espresso.pwo", "JOB DONE.\n! total energy = -2.0 Ry")
    write("qe_runs/h2_r0p900000_pid1_attempt1/espresso.pwi", "ecutwfc = 40\nATOMIC_SPECIES\n H 1.0 H.paw.upf\n")
    write("qe_runs_bulk_li2nav2po43/run1/espresso.pwo", b"starting \xff\xfe\n")
    write("qe_runs_bulk_li2nav2po43/run1/espresso.err", "first")
    write("qe_runs_bulk_li2nav2po43/run1/CRASH", "atoms # 1 and # 2 overlap")
    write("other/notes.txt", "JOB DONE.")
    return str(tmp_path)


def test_scan_attach_and_parse(spark, tree):
    runs = scan_runs(spark, [tree])
    rows = {r["material_id"]: r for r in L.parse_runs(runs, tree).collect()}
    assert set(rows) == {"h2_r0p900000", "bulk_li2nav2po43"}
    good, bad = rows["h2_r0p900000"], rows["bulk_li2nav2po43"]
    assert good["converged"] and good["ecutwfc"] == 40.0 and good["qe_input_path"].endswith("espresso.pwi")
    assert good["qe_output_path"] == "qe_runs/h2_r0p900000_pid1_attempt1/espresso.pwo"
    assert bad["failure_reason"] == "geometry_overlap" and bad["qe_input_path"] is None
    texts = {r["output_path"]: r["output_text"] for r in runs.collect()}
    crashed = texts[os.path.join(tree, "qe_runs_bulk_li2nav2po43/run1/espresso.pwo")]
    assert crashed.index("starting") < crashed.index("first") < crashed.index("overlap")


def test_overlapping_roots_and_file_roots_give_one_run(spark, tree):
    single = os.path.join(tree, "qe_runs/h2_r0p900000_pid1_attempt1/espresso.pwo")
    assert scan_runs(spark, [tree, os.path.join(tree, "qe_runs")]).count() == 2
    assert scan_runs(spark, [single]).count() == 1
    assert scan_runs(spark, [single, tree]).count() == 2


def test_file_roots_equal_folder_roots(spark, tree):
    """A named output brings its input and its diagnostics."""
    outputs = [r["output_path"] for r in scan_runs(spark, [tree]).collect()]
    by_folder, by_file = (sorted(map(str, L.parse_runs(scan_runs(spark, roots), tree).collect())) for roots in ([tree], outputs))
    assert by_folder == by_file and len(by_file) == 2


def test_outputs_of_other_names_take_the_input_of_their_stem(spark, tree, tmp_path):
    run = tmp_path / "qe_runs" / "mixed_pid2"
    run.mkdir(parents=True)
    for name, text in (("a.b.out", "JOB DONE."), ("log", "running"), ("a.b.pwi", "ecutwfc = 30"), ("log.pwi", ""), ("espresso.pwi", "ecutwfc = 99"),
                       ("CRASH", "note")):
        (run / name).write_text(text)
    rows = {r["output_path"].rsplit("/", 1)[1]: r for r in scan_runs(spark, [str(run / "a.b.out"), str(run / "log")]).collect()}
    assert set(rows) == {"a.b.out", "log"}
    assert rows["a.b.out"]["input_text"] == "ecutwfc = 30" and rows["a.b.out"]["input_path"].endswith("/a.b.pwi")
    assert rows["log"]["input_text"] is None and rows["log"]["output_text"] == "running\nnote"


def test_line_ends_do_not_change_a_record(spark, tmp_path):
    source = "&SYSTEM\n ecutwfc = 30\n/\nATOMIC_SPECIES\n Mg 24.3 Mg.paw.UPF\n O 16.0 O.paw.UPF\n\nK_POINTS automatic\n 2 2 2 0 0 0\n"
    output = "!    total energy   =   -4.5 Ry\n     PWSCF        :  1m 2.0s CPU   1m 3.0s WALL\nJOB DONE.\n"
    for name, end in (("unix", "\n"), ("dos", "\r\n"), ("old", "\r")):
        run = tmp_path / "qe_runs" / f"{name}_pid1"
        run.mkdir(parents=True)
        (run / "espresso.pwi").write_bytes(source.replace("\n", end).encode())
        (run / "espresso.pwo").write_bytes(output.replace("\n", end).encode())
    rows = L.parse_runs(scan_runs(spark, [str(tmp_path)])).drop("material_id", "qe_input_path", "qe_output_path").collect()
    assert len(rows) == 3 and rows[0] == rows[1] == rows[2]
    row = rows[0].asDict()
    assert row["pseudopotentials"] == {"Mg": "Mg.paw.UPF", "O": "O.paw.UPF"} and row["kpoints"] == "2 2 2 0 0 0"
    assert (row["wall_time"], row["ecutwfc"], row["final_energy_ry"]) == ("1m 3.0s WALL", 30.0, -4.5)


def test_empty_outputs_are_runs(spark, tree, tmp_path):
    empty = tmp_path / "qe_runs" / "mg_pid1" / "espresso.pwo"
    empty.parent.mkdir(parents=True)
    empty.write_text("")
    (empty.parent / "CRASH").write_text("Error in routine x")
    rows = {r["material_id"]: r for r in L.parse_runs(scan_runs(spark, [tree])).collect()}
    assert rows["mg"]["failure_reason"] == "qe_error" and len(rows) == 3
    assert L.parse_runs(scan_runs(spark, [str(empty)])).first()["failure_reason"] == "qe_error"
    named = spark.createDataFrame([(str(empty),), ("/elsewhere/qe_runs/ca_pid1/espresso.pwo",)], "path string")
    rows = {r["material_id"]: r for r in L.parse_runs(scan_runs(spark, [tree], named)).collect()}
    assert rows["ca"]["failure_reason"] == "job_not_completed" and len(rows) == 4


def test_csv_round_trip(spark, tree, tmp_path):
    records = L.parse_runs(scan_runs(spark, [tree]), tree).withColumn("extra", F.lit("dropped"))
    out = str(tmp_path / "records_csv")
    write_fixed(records, COLUMNS, out, "csv")
    raw = text_columns(spark, out, COLUMNS)
    assert {r["converged"] for r in raw.collect()} == {"True", "False"}
    assert '{"H":"H.paw.upf"}' in {r["pseudopotentials"] for r in raw.collect()}
    back = typed_records(raw)
    assert back.columns == COLUMNS
    keep = [c for c in COLUMNS if c != "pseudopotentials"]
    assert sorted(map(str, back.select(keep).collect())) == sorted(map(str, records.select(keep).collect()))


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "r.csv").write_text('smearing,material_id,extra\nmp,"a,b",1\n,c,2\n')
    rows = text_columns(spark, str(tmp_path / "r.csv"), ["material_id", "smearing", "kpoints"]).collect()
    assert [tuple(r) for r in rows] == [("a,b", "mp", None), ("c", None, None)]


def test_paths_with_special_characters(spark, tmp_path):
    run = tmp_path / "a+b %41 c" / "qe_runs_x y" / "run1"
    run.mkdir(parents=True)
    (run / "espresso.pwo").write_text("JOB DONE.")
    row = L.parse_runs(scan_runs(spark, [str(tmp_path)]), str(tmp_path)).first()
    assert row["material_id"] == "x y" and row["qe_output_path"] == "a+b %41 c/qe_runs_x y/run1/espresso.pwo"


def test_bad_map_text_is_an_empty_map(spark):
    rows = spark.createDataFrame([tuple("{oops" if c == "pseudopotentials" else "" for c in COLUMNS)], COLUMNS)
    assert typed_records(rows).first()["pseudopotentials"] == {}


def test_parquet_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("b", "qe_error")], "material_id string, failure_reason string")
    write_fixed(rows, ["failure_reason", "missing", "material_id"], str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["failure_reason", "missing", "material_id"]
    write_quarantined(rows, {"qe_error"}, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).where("quarantined = 'true'").count() == 1
    summary = spark.createDataFrame([("a", "pass", 5, 5), ("b", "pass", 4, 5), ("c", "review", 5, 5)],
                                    "case_id string, pass_fail string, completed_grid_points long, grid_points long")
    write_summary(summary, str(tmp_path / "pub"), str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "pub")).count() == public_subset(summary).count() == 1
    assert spark.read.parquet(str(tmp_path / "all")).count() == 3


def test_legacy_grid_layout(spark):
    new = spark.createDataFrame([("c", "1.5", "failed"), ("c", "", "ok")], "case_id string, energy string, status string")
    old = spark.createDataFrame([("c", "2.5")], "case_id string, energy_eV_per_atom string")
    got = {(r["energy"], r["status"]) for r in grid_rows(new, old).collect()}
    assert got == {(1.5, "failed"), (None, "ok"), (2.5, "ok")}
