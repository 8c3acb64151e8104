"""Feature rows that use only what is known before a run. Every step is narrow: no exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift import elements as EL
from runsift.constants import POST_RUN_COLUMNS
from runsift.functions.numeric import blank_to_null, ratio, to_double
from runsift.functions.order import rank_within

MESH_COLUMNS = ("k1", "k2", "k3", "kpoint_product")
MOMENT_COLUMNS = (
    "atomic_number_mean", "atomic_number_std", "atomic_number_min", "atomic_number_max", "atomic_mass_mean",
    "atomic_mass_std", "electronegativity_mean", "electronegativity_std", "atomic_radius_mean", "atomic_radius_std")
FLAG_COLUMNS = (
    "metal_fraction", "transition_metal_fraction", "has_transition_metal", "has_oxygen", "has_hydrogen",
    "has_fluorine", "has_sulfur", "has_heavy_element")
ABSENT_COLUMNS = ("n_atoms", "natoms_times_kpoints", "natoms_times_ecutwfc", "volume_per_atom")
COUNT_COLUMNS = tuple(f"element_count_{s}" for s in EL.SYMBOLS)
FRACTION_COLUMNS = tuple(f"element_fraction_{s}" for s in EL.SYMBOLS)
CATEGORICAL_FEATURES = ("material_id", "smearing", "pseudo_family", "elements")
NUMERIC_FEATURES = (
    "ecutwfc", "ecutrho", *MESH_COLUMNS, "mixing_beta", "n_species", *MOMENT_COLUMNS, *FLAG_COLUMNS,
    "ecutrho_over_ecutwfc", *ABSENT_COLUMNS, *COUNT_COLUMNS, *FRACTION_COLUMNS)
FEATURES = (*CATEGORICAL_FEATURES, *NUMERIC_FEATURES)
LABEL_COLUMNS = ("record_id", "failure_label", "failure_taxonomy", "success")


def failure_label(reason: Column) -> Column:
    return F.coalesce(blank_to_null(reason), F.lit("success"))


def failure_taxonomy(label: Column) -> Column:
    return (
        F.when(label == "success", "success")
        .when(label == "qe_error", "setup_error")
        .when(label == "scf_not_converged", "scf_not_converged")
        .when(label == "job_not_completed", "runtime_incomplete")
        .when(label.isin("invalid_geometry", "geometry_overlap", "overlap"), "invalid_geometry")
        .otherwise("unknown_failure")
    )


def mesh_numbers(text: Column) -> tuple[Column, Column, Column]:
    """First three tokens as ints; a bad or absent token is 0."""
    tokens = F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+")
    return tuple(F.coalesce(F.get(tokens, F.lit(i)).try_cast("int"), F.lit(0)) for i in range(3))


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return ratio(total, F.size(values))


def _deviation(values: Column, mean: Column) -> Column:
    """Population deviation."""
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.sqrt(ratio(squares, F.size(values)))


def _properties(symbols: Column, position: int) -> Column:
    table = EL.lookup(position)
    return F.filter(F.transform(symbols, lambda s: F.try_element_at(table, s)), lambda v: v.isNotNull())


def element_features(rows: DataFrame, symbols: str = "symbols") -> DataFrame:
    """Moments, fractions, flags and one-hot columns of a sorted, distinct symbol array."""
    s = F.col(symbols)
    staged = rows.withColumns({f"__v_{n}": _properties(s, i) for i, n in enumerate(EL.PROPERTIES)})
    staged = staged.withColumns({f"__m_{n}": _mean(F.col(f"__v_{n}")) for n in EL.PROPERTIES})
    names = {"number": "atomic_number", "mass": "atomic_mass", "electronegativity": "electronegativity", "radius": "atomic_radius"}
    out: dict[str, Column] = {}
    for n, label in names.items():
        out[f"{label}_mean"] = F.col(f"__m_{n}")
        out[f"{label}_std"] = _deviation(F.col(f"__v_{n}"), F.col(f"__m_{n}"))
    numbers = F.col("__v_number")
    out["atomic_number_min"], out["atomic_number_max"] = F.array_min(numbers), F.array_max(numbers)
    members = lambda group: F.array_intersect(s, F.array(*[F.lit(x) for x in group]))
    # The numerator counts all members, the denominator only those in the element table.
    out["metal_fraction"] = ratio(F.size(members(EL.METALS)), F.size(numbers))
    out["transition_metal_fraction"] = ratio(F.size(members(EL.TRANSITION_METALS)), F.size(numbers))
    out["has_transition_metal"] = (F.size(members(EL.TRANSITION_METALS)) > 0).cast("int")
    for name, symbol in (("oxygen", "O"), ("hydrogen", "H"), ("fluorine", "F"), ("sulfur", "S")):
        out[f"has_{name}"] = F.array_contains(s, symbol).cast("int")
    out["has_heavy_element"] = F.coalesce((F.array_max(numbers) >= EL.HEAVY_FROM).cast("int"), F.lit(0))
    share = ratio(F.lit(1.0), F.size(s))
    for symbol in EL.SYMBOLS:
        present = F.array_contains(s, symbol)
        out[f"element_count_{symbol}"] = present.cast("int")
        out[f"element_fraction_{symbol}"] = F.when(present, share).otherwise(0.0)
    inner = [c for c in staged.columns if c.startswith("__")]
    return staged.withColumns(out).drop(*inner)


def build_features(records: DataFrame, record_id: str = "record_id") -> DataFrame:
    """Feature rows from run records whose columns are text; ``pseudopotentials`` is JSON text."""
    k1, k2, k3 = mesh_numbers(F.col("kpoints"))
    parsed = F.map_keys(F.from_json("pseudopotentials", "map<string,string>"))
    species = F.array_distinct(F.coalesce(parsed, F.array().cast("array<string>")))
    unknown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    base = records.select(
        F.col(record_id).alias("record_id"), failure_label(F.col("failure_reason")).alias("failure_label"),
        unknown("material_id").alias("material_id"), to_double(F.col("ecutwfc")).alias("ecutwfc"),
        to_double(F.col("ecutrho")).alias("ecutrho"), k1.alias("k1"), k2.alias("k2"), k3.alias("k3"),
        unknown("smearing").alias("smearing"), to_double(F.col("mixing_beta")).alias("mixing_beta"),
        unknown("pseudo_family").alias("pseudo_family"), F.array_sort(species).alias("__species"),
        F.array_sort(F.array_distinct(F.filter(species, lambda s: s != ""))).alias("symbols"))
    guarded = F.when(F.col("ecutwfc") > 0, F.try_divide("ecutrho", "ecutwfc"))
    named = base.withColumns({
        "failure_taxonomy": failure_taxonomy(F.col("failure_label")),
        "success": (F.col("failure_label") == "success").cast("int"),
        "kpoint_product": F.col("k1") * F.col("k2") * F.col("k3"),
        "n_species": F.size("__species"),
        "elements": F.coalesce(F.nullif(F.array_join("__species", " "), F.lit("")), F.lit("unknown")),
        "ecutrho_over_ecutwfc": guarded,
        **{c: F.lit(None).cast("double") for c in ABSENT_COLUMNS},
    })
    features = element_features(named).select(*LABEL_COLUMNS, *FEATURES)
    assert_no_leakage(FEATURES)
    return features


def assert_no_leakage(columns: Sequence[str]) -> None:
    leaked = sorted(set(columns) & set(POST_RUN_COLUMNS))
    if leaked:
        raise ValueError(f"post-run columns used as features: {', '.join(leaked)}")


def feature_sets() -> dict[str, tuple[str, tuple[str, ...]]]:
    """Experiment name to (split kind, features)."""
    without_group = tuple(c for c in FEATURES if c != "material_id")
    return {
        "baseline_random_split": ("random", FEATURES),
        "no_material_id_random_split": ("random", without_group),
        "material_group_split": ("group", FEATURES),
    }


def number_records(records: DataFrame, path: str) -> DataFrame:
    """Record id 0, 1, 2, ... by path."""
    return rank_within(records, [F.col(path)], "__r").withColumn("record_id", F.col("__r") - 1).drop("__r")
