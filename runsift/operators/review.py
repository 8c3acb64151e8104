"""Batches of proposed candidates for human review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift import constants as K
from runsift.functions.order import rank_within
from runsift.schemas import REVIEW_BATCH
from runsift.session import materialize

STATUS = "dry_run_only"
# Texts of the review table (fixed values).
REVIEW_NOTE = "Proposal-review artifact only; not selected for QE/PBE execution; requires human review before QE/PBE."
OUTCOME_COLUMNS = ("true_failure", "known_energy_ev", "failure_label", "converged", "job_done", "failure_reason")


def plan_values(plan: DataFrame, systems: DataFrame) -> DataFrame:
    """Values lo + fraction * (hi - lo) per variable; a value at a known seed fails the job.

    ``plan``: position, module, category, fractions. ``systems``: module and variables, an array of
    struct(name, lo, hi, seeds).
    """
    def value(v: Column, f: Column) -> Column:
        return v["lo"] + f * (v["hi"] - v["lo"])

    pairs = F.filter(F.arrays_zip(F.col("variables").alias("v"), F.col("fractions").alias("f")),
                     lambda p: p["v"].isNotNull() & p["f"].isNotNull())
    joined = plan.join(systems, "module").withColumn("__pairs", pairs)
    at_seed = F.exists("__pairs", lambda p: F.exists(
        p["v"]["seeds"], lambda s: F.abs(value(p["v"], p["f"]) - s) < K.DUPLICATE_TOLERANCE))
    text = F.array_join(F.transform("__pairs", lambda p: F.concat(
        p["v"]["name"], F.lit("="), F.format_string("%.4f", value(p["v"], p["f"])))), "; ")
    stop = F.raise_error(F.concat(F.lit("value at a known seed in plan row "), F.col("position").cast("string"))).cast("string")
    return joined.withColumn("candidate_variables", F.when(at_seed, stop).otherwise(text)).drop("__pairs")


def settings_profile(columns: Sequence[str]) -> Column:
    return F.concat_ws(";", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns])


def species_profile(species: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(species)),
                                    lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ";")


def build_batch(plan: DataFrame, systems: DataFrame, settings: Sequence[str]) -> DataFrame:
    """The fixed review columns; nothing that only a run could know, and a sentinel for what was not computed.

    ``systems`` also has key, family, source and species (map); reason texts come from ``plan.reason``.
    """
    valued = plan_values(plan, systems)
    numbered = rank_within(valued, [F.col("position")], "__n", ["module"])
    blank = F.lit(K.NOT_COMPUTED)
    rows = numbered.select(
        F.concat_ws("_", F.lit("dryrun"), "module", F.col("__n").cast("string")).alias("candidate_id"),
        F.col("key").alias("material_id"), F.coalesce(F.nullif("family", F.lit("")), blank).alias("material_family"),
        F.array_join(F.array_sort(F.map_keys("species")), ",").alias("formula_composition"),
        F.col("source").alias("structure_source"),
        "candidate_variables", blank.alias("predicted_value"), blank.alias("uncertainty_lcb_score"),
        blank.alias("failure_risk"), blank.alias("acquisition_score"), F.col("reason").alias("selection_reason"),
        F.col("category").alias("selection_category"), settings_profile(settings).alias("DFT_settings_profile"),
        species_profile("species").alias("pseudopotential_family"), blank.alias("expected_runtime_risk"),
        F.lit(STATUS).alias("status"), F.lit(REVIEW_NOTE).alias("notes"))
    check_columns(rows.columns)
    return rows


def check_columns(columns: Sequence[str]) -> None:
    if tuple(columns) != REVIEW_BATCH or set(columns) & set(OUTCOME_COLUMNS):
        raise ValueError("review batch must have exactly the review columns and no outcome")


def quota_batch(candidates: DataFrame, per_category: int = 2, diverse: int = 2,
                threshold: float = K.RISK_THRESHOLD) -> DataFrame:
    """Best values, most uncertain, low risk, elevated risk, and candidates of other groups.

    A candidate is taken once, by the first category that wants it. Each step is a top-k over the
    table without the few rows already taken.
    """
    key = F.col("candidate_id")
    wanted = (
        ("exploitation", F.lit(True), [F.col("predicted_value").asc(), F.col("uncertainty").asc()]),
        ("uncertainty_exploration", F.lit(True), [F.col("uncertainty").desc()]),
        ("low_failure_risk", F.col("failure_risk") < threshold, [F.col("failure_risk").asc()]),
        ("failure_risk_challenge", F.col("failure_risk") >= threshold, [F.col("failure_risk").desc()]),
    )
    columns = ["candidate_id", "material_id", "predicted_value", "uncertainty", "failure_risk"]
    taken = None
    for name, condition, order in wanted:
        rest = candidates if taken is None else candidates.join(taken.select("candidate_id"), "candidate_id", "left_anti")
        picked = rest.where(condition).orderBy(*order, key).limit(per_category).select(
            *columns, F.lit(name).alias("category"))
        taken = materialize(picked if taken is None else taken.unionByName(picked))
    others = candidates.join(taken.select("material_id").distinct(), "material_id", "left_anti")
    one_each = others.groupBy("material_id").agg(F.min_by(F.struct(*[c for c in columns if c != "material_id"]),
                                                         F.struct("predicted_value", "candidate_id")).alias("__b"))
    spread = one_each.select("material_id", "__b.*").orderBy("predicted_value", "candidate_id").limit(diverse).select(
        *columns, F.lit("diversity").alias("category"))
    return taken.unionByName(spread)
