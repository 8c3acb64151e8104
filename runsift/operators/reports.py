"""Facts from report text, best report per key, and iteration traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift import constants as K
from runsift.functions.order import rank_within, running_within, top_rows
from runsift.functions.text import all_matches, base_name, bind, first_match, first_of, last_match, last_wins_map

# Report patterns (fixed values).
SIGNED = r"[-+]?\d+(?:\.\d+)?"
SIGNED_EXP = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
KEY_LINE = r"(?m)^Key:\s*([A-Za-z0-9_]+)"
NAME_VALUE = r"([A-Za-z_][A-Za-z0-9_]*)=([-+]?\d+(?:\.\d+)?)"
PARAM_LINES = (
    r"Best parameters\s*:\s*([^\n]+)",
    r"Best:\s*([A-Za-z_][^\n]*?)\s+E=",
    r"Best observed:\s*([^,\n]+(?:,\s*[^,\n]+)*)",
)
OLD_LABELS = (("Best lattice constant", "a"), ("Best distance", "bond"))
ENERGY_LINES = (
    rf"Best .*?objective:\s*({SIGNED_EXP})\s*eV",
    rf"Best QE energy per atom[:\s]+({SIGNED_EXP})\s*eV",
    rf"Best .*?E=({SIGNED_EXP})\s*eV",
)
STD_LINES = (
    rf"GP uncertainty\s*:\s*({SIGNED_EXP})\s*eV",
    rf"GP std=({SIGNED_EXP})",
    r"GP uncertainty at best[^:]*:[:\s]+([\d.eE+-]+)\s*eV",
)
CALL_LINES = (
    r"Total QE calls\s*:\s*(\d+)",
    r"Successful QE evaluations[:\s]+(\d+)",
    r"QE labels=(\d+)",
)
ITERATION_LINE = r"(?m)^Iteration\s+(\d+)\s*$"
SPIN_LINE = r"spin_polarized:\s*(True|False)"
VARIABLES_LINE = r"(?m)^Variables:\s*(\{.*\})"
VARIABLE_RANGE = r"'(\w+)':\s*\(\s*([-+.\deE]+)\s*,\s*([-+.\deE]+)\s*\)"
HISTORY = rf"Best:\s*(.*?)\s+E=({SIGNED_EXP})\s*eV\s+GP std=([\d.eE+-]+)\s*eV\s+QE labels=(\d+)"
LABELLED = rf"Added (?:AL|ID|inverse)[:\s]+(.*?)\s*->\s*E(?:/atom)?=({SIGNED_EXP})\s*eV"
KEY_SUFFIXES = (
    "_qe_active_inverse_report", "_active_inverse_report", "_qe_run_report",
    "_run_report", "_report", "_energy_curve", "_convergence",
)
KEY_MARKS = ("_4_qe", "_8_qe")
FIRST_PARAM = ("a", "b", "bond", "height", "distance")


def stripped_key(raw: Column) -> Column:
    key = F.trim(raw)
    for suffix in KEY_SUFFIXES:
        key = F.regexp_replace(key, suffix + "$", "")
    for mark in KEY_MARKS:
        key = F.replace(key, F.lit(mark), F.lit(""))
    return key


def file_stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def attach_keys(reports: DataFrame, aliases: DataFrame, dimension: DataFrame) -> DataFrame:
    """Key from the key line, else from the file name; reports of unknown keys are dropped.

    ``aliases`` has (raw_key, key); ``dimension`` has key.
    """
    stem = file_stem(F.col("path"))
    staged = reports.withColumns({
        "__k1": stripped_key(F.coalesce(F.nullif(F.regexp_extract("text", KEY_LINE, 1), F.lit("")), stem)),
        "__k2": stripped_key(stem)})
    known = dimension.select("key").distinct()
    for i in ("1", "2"):
        names = aliases.select(F.col("raw_key").alias(f"__k{i}"), F.col("key").alias(f"__a{i}"))
        staged = staged.join(names, f"__k{i}", "left").withColumn(f"__f{i}", F.coalesce(f"__a{i}", f"__k{i}"))
        hits = known.select(F.col("key").alias(f"__f{i}"), F.lit(True).alias(f"__h{i}"))
        staged = staged.join(hits, f"__f{i}", "left")
    key = F.when(F.col("__h1"), F.col("__f1")).when(F.col("__h2"), F.col("__f2"))
    inner = [c for c in staged.columns if c.startswith("__")]
    return staged.withColumn("key", key).where(F.col("key").isNotNull()).drop(*inner)


def content_score(path: Column, text: Column) -> Column:
    return (
        F.when(text.contains("Computed quantity:"), 10).otherwise(0)
        + F.when(path.endswith("_report.txt"), 2).otherwise(0)
        + F.when(text.contains("FINAL RESULT"), 2).otherwise(0)
    )


def best_version(reports: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Best report per key by score, then newest, then first path. Only one row per key and task moves."""
    order = [F.col("score").desc(), F.col("modified").desc(), F.col("path").asc()]
    return top_rows(reports, order, 1, "__v", keys).drop("__v")


def _pairs(chunk: Column) -> Column:
    return F.zip_with(
        all_matches(chunk, NAME_VALUE, 1, ignore_case=False), all_matches(chunk, NAME_VALUE, 2, ignore_case=False),
        lambda n, v: F.struct(n.alias("name"), v.try_cast("double").alias("value")))


def best_params(text: Column) -> Column:
    """Name to value; the first level that yields anything wins, the last of a repeated name is kept."""
    levels = [F.nullif(_pairs(first_match(text, p, ignore_case=False)), F.array().cast("array<struct<name:string,value:double>>"))
              for p in PARAM_LINES]
    old = F.filter(F.array(*[
        F.struct(F.lit(name).alias("name"),
                 first_match(text, label + rf"[:\s]+({SIGNED})").try_cast("double").alias("value"))
        for label, name in OLD_LABELS]), lambda p: p["value"].isNotNull())
    return last_wins_map(F.coalesce(*levels, old), "name", "value")


def canonical_params(params: Column, dim: Column) -> tuple[Column, Column]:
    """First and second parameter; the second exists for two-dimensional systems only."""
    get = lambda name: F.try_element_at(params, F.lit(name))
    first = F.coalesce(*[get(n) for n in FIRST_PARAM])
    second = F.coalesce(get("c"), first * get("c_over_a"), get("layer_half_thickness"))
    return first, F.when(dim == 2, second)


def best_energy(text: Column) -> Column:
    return first_of(*[last_match(text, p).try_cast("double") for p in ENERGY_LINES])


def best_std(text: Column) -> Column:
    return first_of(*[last_match(text, p).try_cast("double") for p in STD_LINES])


def call_count(text: Column) -> Column:
    return first_of(*[last_match(text, p).try_cast("int") for p in CALL_LINES])


def iteration_count(text: Column) -> Column:
    found = F.transform(all_matches(text, ITERATION_LINE, 1, ignore_case=False), lambda m: m.try_cast("int"))
    return F.coalesce(F.array_max(found), F.lit(0))


def says_converged(text: Column) -> Column:
    return text.rlike("(?i)converged")


def spin_flag(text: Column) -> Column:
    return first_match(text, SPIN_LINE, ignore_case=False) == "True"


def reference_summary(reports: DataFrame, key: str = "key") -> DataFrame:
    """Best parameters, energy, calls and spin flag of reference runs; only the newest labels count here."""
    text = F.col("text")
    params = last_wins_map(
        F.coalesce(_pairs(first_match(text, PARAM_LINES[0], ignore_case=False)),
                   F.array().cast("array<struct<name:string,value:double>>")), "name", "value")
    return reports.select(
        key, params.alias("best_params"),
        last_match(text, rf"Best .*?objective:\s*({SIGNED_EXP})", ignore_case=False).try_cast("double").alias("best_energy"),
        first_match(text, CALL_LINES[0], ignore_case=False).try_cast("int").alias("n_calls"),
        spin_flag(text).alias("spin"))


def variable_ranges(text: Column) -> Column:
    """Declared search ranges: name to (lo, hi)."""
    line = F.regexp_extract(text, VARIABLES_LINE, 1)
    get = lambda g: F.regexp_extract_all(line, F.lit(VARIABLE_RANGE), F.lit(g))
    rows = F.zip_with(get(1), F.arrays_zip(get(2).alias("lo"), get(3).alias("hi")), lambda n, r: F.struct(
        n.alias("name"), F.struct(r["lo"].try_cast("double").alias("lo"), r["hi"].try_cast("double").alias("hi")).alias("range")))
    return last_wins_map(rows, "name", "range")


def report_rows(reports: DataFrame, dim: str = "dim") -> DataFrame:
    """All facts of each report as narrow columns, so the text itself never enters an exchange."""
    text = F.col("text")
    staged = reports.withColumn("__p", best_params(text))
    first, second = canonical_params(F.col("__p"), F.col(dim))
    return staged.select(
        *[c for c in reports.columns if c != "text"],
        first.alias("best_param1"), second.alias("best_param2"), best_energy(text).alias("best_energy"),
        best_std(text).alias("gp_uncertainty"), call_count(text).alias("n_calls"),
        iteration_count(text).alias("n_iterations"), says_converged(text).alias("converged"),
        content_score(F.col("path"), text).alias("score"))


def history_rows(reports: DataFrame, key: str) -> DataFrame:
    """One row per reported iteration."""
    get = lambda g: all_matches(F.col("text"), HISTORY, g, ignore_case=False)
    zipped = F.arrays_zip(get(1).alias("params"), get(2).alias("energy"), get(3).alias("std"), get(4).alias("n"))
    return reports.select(key, F.posexplode(zipped).alias("pos", "h")).select(
        key, (F.col("pos") + 1).alias("iteration"), F.col("h.params").alias("params"),
        F.col("h.energy").try_cast("double").alias("energy"), F.col("h.std").try_cast("double").alias("std"),
        F.col("h.n").try_cast("int").alias("n_labels"))


def labelled_points(reports: DataFrame, key: str) -> DataFrame:
    """One row per added point that states parameters."""
    get = lambda g: all_matches(F.col("text"), LABELLED, g, ignore_case=False)
    zipped = F.arrays_zip(get(1).alias("params"), get(2).alias("energy"))
    rows = reports.select(key, F.posexplode(zipped).alias("pos", "p")).select(
        key, "pos",
        F.transform(all_matches(F.col("p.params"), NAME_VALUE, 2, ignore_case=False),
                    lambda v: v.try_cast("double")).alias("params"),
        F.col("p.energy").try_cast("double").alias("energy"))
    return rows.where(F.size("params") > 0)


def running_best(trace: DataFrame, key: str, order: Sequence[Column], value: str) -> DataFrame:
    """Best value so far and running totals of calls and of labels (calls that gave a value)."""
    return running_within(trace, order, {
        "best_so_far": ("min", F.col(value)),
        "n_calls": ("sum", F.lit(1)),
        "n_labels": ("sum", F.when(F.col(value).isNotNull(), 1).otherwise(0)),
    }, [key])


def convergence_points(trace: DataFrame, key: str, order: Sequence[Column], std: str, improvement: str,
                       cap: int | None = None, max_std: float = K.STOP_STD, max_improvement: float = K.STOP_IMPROVEMENT) -> DataFrame:
    """First iteration within both limits, or the last one when there is none; ``cap`` leaves out later iterations."""
    numbered = rank_within(trace, order, "iteration", [key])
    numbered = numbered if cap is None else numbered.where(F.col("iteration") <= cap)
    stop = F.min(F.when((F.col(std) < max_std) & (F.col(improvement) < max_improvement), F.col("iteration")))
    return numbered.groupBy(key).agg(stop.alias("s"), F.max("iteration").alias("m")).select(
        key, F.coalesce("s", "m").alias("stop_iteration"), F.col("s").isNotNull().cast("int").alias("converged"))
