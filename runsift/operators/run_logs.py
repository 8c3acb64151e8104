"""Run records from log text, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.constants import RY_TO_EV
from runsift.functions.numeric import blank_to_null
from runsift.functions.text import (
    NUMBER, all_matches, base_name, bind, first_match, first_of, join_parts, last_double, last_int, last_match,
    last_wins_map, max_int, plain_spaces, single_spaces,
)

# Log patterns (fixed values).
FLAGGED_ENERGY = rf"!\s+total energy\s+=\s*({NUMBER})\s+Ry"
PLAIN_ENERGY = rf"\btotal energy\s+=\s*({NUMBER})\s+Ry"
FORCE = rf"Total force\s+=\s*({NUMBER})"
PRESSURE = rf"P=\s*({NUMBER})"
ACHIEVED = r"convergence has been achieved in\s+(\d+)\s+iterations"
ITERATION = r"iteration\s+#\s*(\d+)"
WALL = r"PWSCF\s*:\s*[^\n]*?CPU\s+([^\n]+?WALL)"
MESH = r"K_POINTS\s+automatic\s*\n\s*([0-9]+\s+[0-9]+\s+[0-9]+(?:\s+[0-9]+\s+[0-9]+\s+[0-9]+)?)"
MESH_COUNT = r"number of k points=\s*(\d+)"
SPECIES_LINE = r"PseudoPot\.\s+#\s*\d+\s+for\s+([A-Za-z][a-z]?)\s+read from file:\s+(\S+)"
SPECIES_BLOCK = (
    r"(?im)^[^\S\n]*ATOMIC_SPECIES[^\n]*\n"
    r"((?:(?![^\S\n]*(?:ATOMIC_SPECIES|ATOMIC_POSITIONS|K_POINTS|CELL_PARAMETERS))[^\S\n]*\S[^\n]*(?:\n|\z))*+)"
)
SPECIES_ROW = r"(?m)^[^\S\n]*(\S+)[^\S\n]+\S+[^\S\n]+(\S+)"


def settings_text(input_text: Column, output_text: Column) -> Column:
    """Input first, so a setting repeated in the output is the last match."""
    return join_parts(input_text, output_text)


def number_setting(text: Column, name: str) -> Column:
    return last_double(text, rf"\b{name}\s*=\s*({NUMBER})")


def text_setting(text: Column, name: str) -> Column:
    return last_match(text, rf"\b{name}\s*=\s*['\"]?([A-Za-z0-9_.+-]+)['\"]?")


def final_energy(text: Column) -> Column:
    return first_of(last_double(text, FLAGGED_ENERGY), last_double(text, PLAIN_ENERGY))


def job_done(text: Column) -> Column:
    return text.contains("JOB DONE")


def converged(text: Column) -> Column:
    return job_done(text) & ~text.contains("convergence NOT achieved")


def iterations(text: Column) -> Column:
    return first_of(last_int(text, ACHIEVED), max_int(text, ITERATION))


def wall_time(text: Column) -> Column:
    return single_spaces(last_match(text, WALL))


def failure_reason(text: Column) -> Column:
    """First rule that holds wins; a converged run has no reason."""
    has = text.contains
    return (
        F.when(converged(text), F.lit(None).cast("string"))
        .when(has("convergence NOT achieved"), "scf_not_converged")
        .when(has("could not find namelist"), "invalid_input_namelist")
        .when(has("atoms #") & has("overlap"), "geometry_overlap")
        .when(has("S matrix not positive definite") | has("atoms too close"), "geometry_instability")
        .when(has("Error in routine") | (has("from ") & has("error #")), "qe_error")
        .when(~job_done(text), "job_not_completed")
        .otherwise("unknown_failure")
    )


def _block_species(text: Column) -> Column:
    """Rows of the species blocks. A block ends at a blank line or the next card; rows need three tokens."""
    lines = F.replace(text, F.lit("\x0b"), F.lit("\n"))
    body = F.array_join(F.regexp_extract_all(lines, F.lit(SPECIES_BLOCK), F.lit(1)), "\n")
    return bind(body, lambda b: F.zip_with(
        all_matches(b, SPECIES_ROW, 1, ignore_case=False), all_matches(b, SPECIES_ROW, 2, ignore_case=False),
        lambda s, f: F.struct(s.alias("symbol"), f.alias("file"))))


def _listed_species(text: Column) -> Column:
    symbols = all_matches(text, SPECIES_LINE, 1, ignore_case=False)
    files = all_matches(text, SPECIES_LINE, 2, ignore_case=False)
    return F.zip_with(symbols, files, lambda s, f: F.struct(s.alias("symbol"), base_name(f).alias("file")))


def species_files(text: Column) -> Column:
    """Map from species to file, from the input block, else from the output listing."""
    pairs = bind(_block_species(text), lambda rows: F.when(F.size(rows) > 0, rows).otherwise(_listed_species(text)))
    return last_wins_map(pairs, "symbol", "file")


def mesh_setting(text: Column) -> Column:
    count = first_match(text, MESH_COUNT)
    return first_of(single_spaces(first_match(text, MESH)), F.concat(count, F.lit(" k-points")))


def family_label(species: Column) -> Column:
    names = F.lower(F.array_join(F.map_values(species), " "))
    return (
        F.when(F.size(species) == 0, F.lit(None).cast("string"))
        .when(names.contains("sssp"), "SSSP")
        .when(names.contains("psl"), "PSLibrary")
        .when(names.contains("oncv"), "ONCV")
        .when(names.contains("paw"), "PAW")
        .when(names.contains("uspp") | names.contains("rrkjus"), "USPP")
        .otherwise("mixed_or_unknown")
    )


def content_hash(input_text: Column, output_text: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(input_text, F.lit("")), output_text).cast("binary"), 256)


def group_from_path(path: Column) -> Column:
    """Group id from the run folder and its parent."""
    parts = F.split(path, "/")
    run_dir = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    parent = F.coalesce(F.try_element_at(parts, F.lit(-3)), F.lit(""))
    cut = F.substring_index(F.substring_index(run_dir, "_pid", 1), "_attempt", 1)
    return (
        F.when(parent.startswith("qe_runs_"), F.substr(parent, F.lit(len("qe_runs_") + 1)))
        .when(parent == "qe_runs", cut)
        .when(parent != "", parent)
        .otherwise(run_dir)
    )


def display_path(path: Column, base: str | None) -> Column:
    """Path relative to the base folder when it lies inside."""
    if base is None:
        return path
    prefix = base.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def parse_runs(runs: DataFrame, base: str | None = None) -> DataFrame:
    """Run records from (output_path, input_path, input_text, output_text); no exchange.

    Flags and hash look at the text as it is, the patterns at its white space made plain.
    """
    raw, out, whole = F.col("output_text"), F.col("__out"), F.col("__settings")
    species = F.col("__species")
    staged = runs.withColumn("__out", plain_spaces(raw)).withColumn(
        "__settings", settings_text(plain_spaces(F.col("input_text")), out)).withColumn("__species", species_files(whole))
    energy = final_energy(out)
    return staged.select(
        blank_to_null(group_from_path(F.col("output_path"))).alias("material_id"),
        display_path(F.col("input_path"), base).alias("qe_input_path"),
        display_path(F.col("output_path"), base).alias("qe_output_path"),
        converged(raw).alias("converged"),
        job_done(raw).alias("job_done"),
        iterations(out).alias("scf_iterations"),
        energy.alias("final_energy_ry"),
        (energy * RY_TO_EV).alias("energy_ev"),
        last_double(out, FORCE).alias("max_force"),
        last_double(out, PRESSURE).alias("pressure_kbar"),
        wall_time(out).alias("wall_time"),
        failure_reason(raw).alias("failure_reason"),
        number_setting(whole, "ecutwfc").alias("ecutwfc"),
        number_setting(whole, "ecutrho").alias("ecutrho"),
        mesh_setting(whole).alias("kpoints"),
        text_setting(whole, "smearing").alias("smearing"),
        number_setting(whole, "mixing_beta").alias("mixing_beta"),
        family_label(species).alias("pseudo_family"),
        species.alias("pseudopotentials"),
        content_hash(F.col("input_text"), raw).alias("calculation_hash"),
    )
