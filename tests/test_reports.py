"""Report facts on written samples."""

from pyspark.sql import functions as F

from runsift.operators import reports as P

ONE = """Bulk sample
Key: bulk_xx   Category: metals
Variables: {'a': (3.9, 4.3)}
spin_polarized: False   relax: False
Computed quantity: energy

Iteration 1
    Added AL:  a=4.300000 -> E=-39.25 eV
    Added ID:  a=4.100000 -> E=-39.50 eV
  Best: a=4.100000  E=-39.50 eV  GP std=0.01 eV  QE labels=6
  ✓ Converged.
FINAL RESULT
  Best parameters : a=4.149480
  Best Total energy per atom objective: -39.75 eV/atom
  GP uncertainty  : 0.00000195 eV/atom
  Total QE calls  : 6
"""
TWO = """Iteration 1
Iteration 12
  Best: height=1.8  shift=0.5  E=-58.5 eV  GP std=4.5e-2 eV  QE labels=8
  Best: height=1.3  shift=0.8  E=-59.5 eV  GP std=0.02 eV  QE labels=11
Best observed: height=1.3, layer_half_thickness=0.8
"""


def test_rows(spark):
    df = spark.createDataFrame([("/r/bulk_xx_report.txt", 1, ONE), ("/r/y_run_report.txt", 2, TWO), ("/r/z.txt", 2, "")],
                               "path string, dim int, text string")
    one, two, none = P.report_rows(df).orderBy("path").collect()
    assert (one["best_param1"], one["best_param2"], one["best_energy"], one["gp_uncertainty"]) == (4.14948, None, -39.75, 1.95e-6)
    assert (one["n_calls"], one["n_iterations"], one["converged"], one["score"]) == (6, 1, True, 14)
    # The iteration line comes before the observed line, and its last repetition counts.
    assert (two["best_param1"], two["best_param2"], two["n_calls"], two["n_iterations"]) == (1.8, None, 11, 12)
    assert (none["best_param1"], none["n_iterations"], none["converged"], none["score"]) == (None, 0, False, 0)
    history = P.history_rows(df, "path").where("path like '%y_run%'").orderBy("iteration").collect()
    assert [(h["energy"], h["std"], h["n_labels"]) for h in history] == [(-58.5, 0.045, 8), (-59.5, 0.02, 11)]
    assert sorted(r["energy"] for r in P.labelled_points(df, "path").collect()) == [-39.5, -39.25]
    ranges = df.select(P.variable_ranges(F.col("text")).alias("v")).first()["v"]
    assert (ranges["a"]["lo"], ranges["a"]["hi"]) == (3.9, 4.3)
    assert P.reference_summary(df, "path").orderBy("path").first()["spin"] is False


def test_old_labels_and_scaled_second(spark):
    df = spark.createDataFrame([("p", 2, "best LATTICE constant: 3.5"), ("q", 2, "Best parameters : a=2.0  c_over_a=1.5")],
                               "path string, dim int, text string")
    got = {r["path"]: (r["best_param1"], r["best_param2"]) for r in P.report_rows(df).collect()}
    assert got == {"p": (3.5, None), "q": (2.0, 3.0)}


def test_keys_and_best_version(spark):
    rows = [("/r/a_report.txt", 1, "Key: bulk_a"), ("/r/a2_report.txt", 2, "Key: old_a\nFINAL RESULT"),
            ("/r/a3_report.txt", 2, "Key: bulk_a_8_qe_report\nFINAL RESULT"), ("/r/bulk_b_qe_run_report.txt", 1, "Key: unknown"),
            ("/r/none.txt", 9, "")]
    df = spark.createDataFrame(rows, "path string, modified int, text string")
    aliases = spark.createDataFrame([("old_a", "bulk_a")], "raw_key string, key string")
    dimension = spark.createDataFrame([("bulk_a",), ("bulk_b",)], "key string")
    keyed = P.attach_keys(df.withColumn("score", P.content_score(F.col("path"), F.col("text"))), aliases, dimension)
    assert keyed.count() == 4
    best = {r["key"]: r["path"] for r in P.best_version(keyed).collect()}
    assert best == {"bulk_a": "/r/a2_report.txt", "bulk_b": "/r/bulk_b_qe_run_report.txt"}


def test_convergence_at_the_cap(spark):
    trace = spark.createDataFrame([("s", i, 0.5, 0.5) for i in range(20)] + [("t", 0, 0.5, 0.0), ("t", 1, 0.01, 0.0), ("t", 2, 0.0, 0.0)],
                                  "system string, i int, std double, improvement double")
    got = {r["system"]: (r["stop_iteration"], r["converged"]) for r in P.convergence_points(
        trace, "system", [F.col("i")], "std", "improvement", cap=12).collect()}
    assert got == {"s": (12, 0), "t": (2, 1)}
