"""Thresholds, weights, word lists and patterns that results depend on."""

from __future__ import annotations

# Ranking defaults (fixed values).
BETA = 2.0
GAMMA = 1.0
RISK_THRESHOLD = 0.10
GAMMA_MODES = {"mild": 0.1, "balanced": 0.3, "aggressive": 1.0}
PENALTY_SWEEP = (0.0, 0.5, 1.0, 2.0)

# Decision thresholds (fixed values).
SUCCESS_THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7)
RISK_THRESHOLDS = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50)
DIAGNOSIS_EDGES = (0.05, 0.20)

# Policy replay (fixed values).
TRIALS = 50
BASE_SEED = 42
TOP_K = (5, 10, 20)
POOL_SIZE = 150
ENRICHED_FRACTION = 0.60
GROUP_TARGET = 150
TOP_FRACTION = 0.5
SEED_OFFSETS = {
    "normal_pool": 0,
    "failure_enriched_pool": 10_000,
    "heldout_material_pool": 20_000,
    "high_uncertainty_pool": 30_000,
}
POLICIES = {
    "random_selection": None,
    "lcb_only": 0.0,
    "failure_aware_mild": 0.1,
    "failure_aware_balanced": 0.3,
    "failure_aware_aggressive": 1.0,
}
BASELINE_POLICY = "lcb_only"
RANDOM_POLICY = "random_selection"

# Splits and distance (fixed values).
TEST_SHARE = 0.2
GROUP_SPLITS = 20
OOD_QUANTILE = 0.95

# Search loop tables (fixed values).
GRID_CANDIDATES = 61
GRID_SIDE_MIN = 7
QUERY_THRESHOLD = 0.03
QUERY_LABELS = 2
STOP_STD = 0.03
STOP_IMPROVEMENT = 0.001
DUPLICATE_TOLERANCE = 1e-6
SEED_OFFSET_STEP = 0.03
MIN_LABELS = {1: 3, 2: 5}
MIN_PAIR_DISTANCE = 0.25

# Comparison and gates (fixed values).
FULL_GRID_1D = 20
FULL_GRID_2D = 49
SURROGATE_TOLERANCE = 0.001
GRID_PASS_DELTA = 0.001
HIGH_ERROR_PERCENT = 3.0
CATEGORY_ERROR_LIMIT = 5.0
SAVINGS_SHARE = 0.80

RY_TO_EV = 13.605693122994
NOT_COMPUTED = "not_computed"

# Columns known only after a run (fixed values); they may never become features.
POST_RUN_COLUMNS = (
    "converged", "job_done", "scf_iterations", "final_energy_ry", "energy_ev",
    "max_force", "pressure_kbar", "wall_time", "failure_reason", "calculation_hash",
)

# Failure causes with a risk model of their own (fixed values).
RISK_TARGETS = {
    "setup_error_risk": "setup_error",
    "scf_failure_risk": "scf_not_converged",
    "runtime_incomplete_risk": "runtime_incomplete",
}
