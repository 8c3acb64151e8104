"""Column layouts of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

RUN_RECORD = T.StructType([
    T.StructField("material_id", T.StringType()),
    T.StructField("qe_input_path", T.StringType()),
    T.StructField("qe_output_path", T.StringType()),
    T.StructField("converged", T.BooleanType()),
    T.StructField("job_done", T.BooleanType()),
    T.StructField("scf_iterations", T.IntegerType()),
    T.StructField("final_energy_ry", T.DoubleType()),
    T.StructField("energy_ev", T.DoubleType()),
    T.StructField("max_force", T.DoubleType()),
    T.StructField("pressure_kbar", T.DoubleType()),
    T.StructField("wall_time", T.StringType()),
    T.StructField("failure_reason", T.StringType()),
    T.StructField("ecutwfc", T.DoubleType()),
    T.StructField("ecutrho", T.DoubleType()),
    T.StructField("kpoints", T.StringType()),
    T.StructField("smearing", T.StringType()),
    T.StructField("mixing_beta", T.DoubleType()),
    T.StructField("pseudo_family", T.StringType()),
    T.StructField("pseudopotentials", T.MapType(T.StringType(), T.StringType())),
    T.StructField("calculation_hash", T.StringType()),
])

RANKED_CANDIDATE = (
    "candidate_id", "material_id", "predicted_value", "uncertainty", "failure_risk", "base_lcb_score",
    "failure_penalty", "acquisition_score", "rank_without_failure_risk", "rank_with_failure_risk", "rank_shift",
    "risk_flag", "selection_reason",
)

PREDICTION = (
    "experiment", "model", "threshold", "record_id", "material_id", "failure_label", "true_success",
    "predicted_success", "success_probability", "predicted_failure_risk", "split",
)

RISK_PREDICTION = (
    "split_id", "threshold", "record_id", "material_id", "failure_label", "failure_taxonomy", "true_failure",
    "setup_error_risk", "scf_failure_risk", "runtime_incomplete_risk", "total_failure_risk", "predicted_failure",
    "ood_distance", "ood_flag",
)

POLICY_TRIAL = (
    "policy", "pool_mode", "trial_id", "seed", "top_k", "failures_selected", "successes_selected",
    "failure_fraction", "mean_failure_risk", "mean_acquisition_score", "best_known_candidate_found",
    "top_k_overlap_with_lcb", "mean_rank_shift", "delta_failures_vs_lcb", "delta_mean_risk_vs_lcb",
)

REVIEW_BATCH = (
    "candidate_id", "material_id", "material_family", "formula_composition", "structure_source",
    "candidate_variables", "predicted_value", "uncertainty_lcb_score", "failure_risk", "acquisition_score",
    "selection_reason", "selection_category", "DFT_settings_profile", "pseudopotential_family",
    "expected_runtime_risk", "status", "notes",
)
