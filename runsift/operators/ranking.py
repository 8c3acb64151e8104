"""Candidate scores, ranks and queries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift import constants as K
from runsift.functions.numeric import clean_risk, clip01, general_text
from runsift.functions.order import BROADCAST_BYTES, match_keys, rank_measures, small_side, top_rows
from runsift.operators.claims import first_at_point, settle_claims
from runsift.operators.near import drop_near_known


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def lower_bound(mean: Column, std: Column, beta: Column | float = K.BETA) -> Column:
    return mean - _col(beta) * std


def penalised_minimum(mean: Column, std: Column, risk: Column, weight: Column | float = 1.0,
                      penalty: Column | float = 1.0) -> Column:
    return mean - _col(weight) * std + _col(penalty) * clip01(risk)


def penalised_maximum(mean: Column, std: Column, risk: Column, weight: Column | float = 1.0,
                      penalty: Column | float = 1.0) -> Column:
    return mean + _col(weight) * std - _col(penalty) * clip01(risk)


def target_match(mean: Column, std: Column, target: Column | float, kappa: Column | float = 1.0) -> Column:
    return -F.abs(mean - _col(target)) + _col(kappa) * std


def checked_uncertainty(std: Column) -> Column:
    """Fail the job on missing, NaN or negative uncertainty."""
    return (
        F.when(std.isNull() | F.isnan(std), F.raise_error(F.lit("uncertainty must not be missing or NaN")).cast("double"))
        .when(std < 0, F.raise_error(F.lit("uncertainty must be non-negative")).cast("double"))
        .otherwise(std)
    )


def checked_mean(mean: Column) -> Column:
    """Fail the job on a missing or NaN mean."""
    return F.when(mean.isNull() | F.isnan(mean), F.raise_error(F.lit("predicted_value must be a number")).cast("double")
                  ).otherwise(mean)


def risk_flag(risk: Column, threshold: float = K.RISK_THRESHOLD) -> Column:
    return (F.when(risk.isNull(), "missing").when(risk >= threshold, "elevated").otherwise("low"))


def selection_reason(risk: Column, gamma: Column | float) -> Column:
    return (
        F.when(risk.isNull(), "ranked by original LCB; failure_risk missing")
        .when(_col(gamma) == 0, "ranked by original LCB; gamma=0")
        .otherwise("ranked by failure-aware LCB soft penalty")
    )


def fallback_id(df: DataFrame, ordinal: str) -> Column:
    """candidate_id, else id, else record_id, else the input position."""
    named = [F.col(c).cast("string") for c in ("candidate_id", "id", "record_id") if c in df.columns]
    return F.coalesce(*named, F.col(ordinal).cast("string"))


def clean_candidates(df: DataFrame) -> DataFrame:
    """Checked mean and uncertainty, risk cleaned to [0, 1] or null. Other columns pass through."""
    return df.withColumns({
        "predicted_value": checked_mean(F.col("predicted_value").cast("double")),
        "uncertainty": checked_uncertainty(F.col("uncertainty").cast("double")),
        "failure_risk": clean_risk(F.col("failure_risk")) if "failure_risk" in df.columns
        else F.lit(None).cast("double"),
    })


def base_score(objective: str, beta: Column | float) -> Column:
    if objective not in ("minimize", "maximize"):
        raise ValueError("objective must be 'minimize' or 'maximize'")
    mean, std = F.col("predicted_value"), F.col("uncertainty")
    return lower_bound(mean, std, beta) if objective == "minimize" else mean + _col(beta) * std


def soft_penalty(gamma: Column | float) -> Column:
    return F.coalesce(_col(gamma) * F.col("failure_risk"), F.lit(0.0))


def soft_total(base: Column, gamma: Column | float, objective: str = "minimize") -> Column:
    """The base score made worse by the penalty."""
    return base + soft_penalty(gamma) if objective == "minimize" else base - soft_penalty(gamma)


def score_candidates(df: DataFrame, objective: str = "minimize", beta: Column | float = K.BETA,
                     gamma: Column | float = K.GAMMA, threshold: float = K.RISK_THRESHOLD) -> DataFrame:
    """Add the base score, penalty, total score, flag and reason to clean candidates."""
    base, risk = base_score(objective, beta), F.col("failure_risk")
    penalty = soft_penalty(gamma)
    total = soft_total(base, gamma, objective)
    return df.withColumns({
        "base_lcb_score": base,
        "failure_penalty": penalty,
        "acquisition_score": total,
        "failure_aware_score": total,
        "risk_flag": risk_flag(risk, threshold),
        "selection_reason": selection_reason(risk, gamma),
    })


def score_order(column: str, ordinal: str, objective: str) -> list[Column]:
    """Score order with the input position as tie-break, as a stable sort gives."""
    return [rising(F.col(column), objective), F.col(ordinal).asc()]


def rising(score: Column, objective: str) -> Column:
    """The score so that the best comes first in rising order."""
    return score if objective == "minimize" else -score


def rank_candidates(df: DataFrame, keys: Sequence[str] = (), ordinal: str = "ordinal",
                    objective: str = "minimize", beta: Column | float = K.BETA,
                    gamma: Column | float = K.GAMMA, threshold: float = K.RISK_THRESHOLD) -> DataFrame:
    """Rank every candidate with and without the risk penalty; no row is dropped."""
    scored = score_candidates(clean_candidates(df), objective, beta, gamma, threshold)
    return add_ranks(scored, keys, ordinal, objective)


def add_ranks(scored: DataFrame, keys: Sequence[str], ordinal: str, objective: str = "minimize") -> DataFrame:
    """Both ranks from one narrow sort, joined to the rows once. ``ordinal`` is unique within the keys."""
    ranks = rank_measures(scored, {
        "rank_without_failure_risk": rising(F.col("base_lcb_score"), objective),
        "rank": rising(F.col("acquisition_score"), objective)}, ordinal, keys)
    return with_shift(match_keys(scored.drop("rank_without_failure_risk", "rank"), ranks, [*keys, ordinal]))


def with_shift(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "rank_with_failure_risk": F.col("rank"),
        "rank_shift": F.col("rank_without_failure_risk") - F.col("rank"),
    })


def top_candidates(df: DataFrame, k: int, ordinal: str = "ordinal", objective: str = "minimize",
                   beta: float = K.BETA, gamma: float = K.GAMMA) -> DataFrame:
    """Only the best k of the whole pool, without ranking the rest."""
    scored = score_candidates(clean_candidates(df), objective, beta, gamma)
    order = score_order("acquisition_score", ordinal, objective)
    best = scored.orderBy(*order).limit(k)
    return top_rows(best.withColumn("__all", F.lit(1)), order, k, "rank", ["__all"]).drop("__all")


def resolve_gamma(df: DataFrame, weight: str = "gamma", mode: str = "gamma_mode") -> DataFrame:
    """An explicit weight wins over a named mode; an unknown mode fails the job."""
    named = F.create_map(*[F.lit(x) for pair in K.GAMMA_MODES.items() for x in pair])
    known = F.try_element_at(named, F.col(mode))
    unknown = F.raise_error(F.concat(F.lit("unknown gamma mode: "), F.coalesce(F.col(mode), F.lit("null"))))
    return df.withColumn("resolved_gamma", F.coalesce(F.col(weight), known, unknown.cast("double")))


def sweep_weights(df: DataFrame, weights: Sequence[tuple[str, float]], keys: Sequence[str] = (),
                  ordinal: str = "ordinal", beta: float = K.BETA) -> DataFrame:
    """Rank the pool once per weight.

    The base rank and the ranks of all weights come from one narrow sort; the rows meet them once, and only then
    are they repeated per weight.
    """
    clean = clean_candidates(df).withColumn("base_lcb_score", base_score("minimize", beta))
    totals = {f"__r{i}": soft_total(F.col("base_lcb_score"), F.lit(float(g))) for i, (_, g) in enumerate(weights)}
    ranks = rank_measures(clean, {"rank_without_failure_risk": F.col("base_lcb_score"), **totals}, ordinal, keys)
    options = F.array(*[F.struct(F.lit(n).alias("mode"), F.lit(float(g)).alias("gamma"), F.col(r).alias("rank"))
                        for (n, g), r in zip(weights, totals)])
    wide = match_keys(clean, ranks, [*keys, ordinal]).withColumn("__w", F.explode(options)).select(
        "*", "__w.mode", "__w.gamma", "__w.rank").drop("__w", *totals)
    return with_shift(score_candidates(wide, beta=beta, gamma=F.col("gamma")))


def sweep_readout(ranked: DataFrame, failed: Column, k: int = 10) -> DataFrame:
    """Per weight: mean risk, known failures and shifted rows in the top k, and all elevated rows."""
    top = F.col("rank") <= k
    return ranked.groupBy("mode", "gamma").agg(
        F.avg(F.when(top, F.coalesce(F.col("failure_risk"), F.lit(0.0)))).alias("mean_top_risk"),
        F.count_if(top & failed).alias("known_failures"),
        F.count_if(top & (F.col("rank_shift") != 0)).alias("shifted"),
        F.count_if(F.col("risk_flag") == "elevated").alias("elevated"),
    )


def zero_weight_check(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """With weight zero the ranking must equal the plain bound, with no penalty anywhere."""
    ranked = rank_candidates(df, ordinal=ordinal, gamma=0.0)
    return ranked.agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.count_if(F.col("rank_shift") != 0).alias("n_rank_differences"),
        F.count_if(F.col("failure_penalty") != 0).alias("n_penalised"),
        F.when(F.bool_and((F.col("rank_shift") == 0) & (F.col("failure_penalty") == 0)), 1)
        .otherwise(0).alias("equivalent"),
    )


def rank_with_fallback(df: DataFrame, system: str, ordinal: str = "ordinal", beta: float = K.BETA,
                       gamma: float = K.GAMMA) -> DataFrame:
    """Risk-aware ranks for a system with any known risk, the plain bound otherwise."""
    clean = clean_candidates(df)
    known = clean.groupBy(system).agg(F.bool_or(F.col("failure_risk").isNotNull()).alias("has_risk"))
    joined = match_keys(clean, known, [system])
    scored = score_candidates(joined, beta=beta, gamma=F.when(F.col("has_risk"), F.lit(float(gamma))).otherwise(0.0))
    return add_ranks(scored, [system], ordinal)


def apply_risk_scorer(df: DataFrame, scorer: Callable[[DataFrame], DataFrame] | Column) -> DataFrame:
    """User-supplied risk: a column (a pandas UDF call is one), or a function that joins scores on."""
    if isinstance(scorer, Column):
        return df.withColumn("failure_risk", clean_risk(scorer))
    scored = scorer(df)
    return scored.withColumn("failure_risk", clean_risk(F.col("failure_risk")))


def high_uncertainty(points: DataFrame, known: DataFrame, system: str, dims: Sequence[str], point_id: str,
                     threshold: float = K.QUERY_THRESHOLD, n: int = K.QUERY_LABELS,
                     tol: float = K.DUPLICATE_TOLERANCE) -> DataFrame:
    """At most n new points per system with uncertainty above the threshold, most uncertain first.

    New means farther than the tolerance from known points and from those chosen before. Equal uncertainty goes by
    ``point_id``.
    """
    order = [F.col("uncertainty").desc(), F.col(point_id)]
    wanted = points.where(F.col("uncertainty") > threshold)
    fresh = drop_near_known(wanted, known, dims, [system], tol)
    turn = F.struct(-F.col("uncertainty"), F.col(point_id), *dims)
    single = first_at_point(fresh, [system], dims, [turn]).withColumns({"__turn": turn, "__trial": F.lit(0)})
    chosen = settle_claims(single, [system], "__turn", "__trial", dims, tol)
    return top_rows(chosen.drop("__turn", "__trial"), order, n, "query_rank", [system])


def candidate_grid(systems: DataFrame, n: int = K.GRID_CANDIDATES) -> DataFrame:
    """Even grid per system: n points for one variable, a square of side max(7, sqrt n) for two."""
    side = max(K.GRID_SIDE_MIN, int(n ** 0.5))
    count = F.when(F.col("dim") == 2, F.lit(side)).otherwise(F.lit(n))
    inner = F.when(F.col("dim") == 2, F.lit(side)).otherwise(F.lit(1))
    points = systems.withColumn("__n", count).withColumn(
        "__i2", F.explode(F.sequence(F.lit(0), inner - 1))).withColumn(
        "__i1", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return points.withColumns({
        "point_id": F.col("__i2") * F.col("__n") + F.col("__i1"),
        "p1": even_value("lo1", "hi1", F.col("__i1"), F.col("__n")),
        "p2": F.when(F.col("dim") == 2, even_value("lo2", "hi2", F.col("__i2"), F.col("__n"))),
    }).drop("__n", "__i1", "__i2")


def even_value(lo: str, hi: str, i: Column, n: Column) -> Column:
    step = (F.col(hi) - F.col(lo)) / (n - 1)
    return F.when(i == n - 1, F.col(hi)).otherwise(F.col(lo) + i * step)


def grid_kernel_scores(systems: DataFrame, labels: DataFrame, system: str, length: float,
                       n: int = K.GRID_CANDIDATES) -> DataFrame:
    """Kernel-weighted mean of the labelled points at each grid point; 1 - (largest kernel) as spread.

    A kernel regression, not a Gaussian-process posterior. Equal labelled points are merged first,
    then each spreads over the fixed number of grid points and sums are combined before the exchange.
    """
    merged = labels.groupBy(system, "x1", "x2").agg(F.sum("y").alias("__y"), F.count("y").alias("__m"))
    grid = candidate_grid(systems, n)
    # The grid row count per system is a constant, so it travels as one array on the system row.
    packed = grid.groupBy(system).agg(F.collect_list(F.struct("point_id", "p1", "p2")).alias("__grid"))
    # Few systems may hold all labels, so the grids go to the labels while they fit the bound on bytes.
    grids = small_side(packed, BROADCAST_BYTES // (64 * max(n, K.GRID_SIDE_MIN ** 2)))
    spread = merged.join(grids, system).withColumn("__g", F.explode("__grid"))
    gap2 = F.coalesce(F.col("__g.p2") - F.col("x2"), F.lit(0.0))
    gap1 = F.col("__g.p1") - F.col("x1")
    kernel = F.exp(-(gap1 * gap1 + gap2 * gap2) / F.lit(2.0 * length * length))
    sums = spread.select(system, F.col("__g.point_id").alias("point_id"), "__y", "__m", kernel.alias("__k")).groupBy(
        system, "point_id").agg(
        F.sum(F.col("__k") * F.col("__y")).alias("__ky"), F.sum(F.col("__k") * F.col("__m")).alias("__ks"),
        F.max("__k").alias("__kmax"))
    return grid.join(sums, [system, "point_id"], "left").withColumns({
        "predicted_value": F.try_divide(F.col("__ky"), F.nullif(F.col("__ks"), F.lit(0.0))),
        "uncertainty": F.lit(1.0) - F.coalesce(F.col("__kmax"), F.lit(0.0)),
    }).drop("__ky", "__ks", "__kmax")


def grid_proposal(scored: DataFrame, system: str, kappa: float = 1.0) -> DataFrame:
    """Best grid point per system by the bound, with the predicted improvement over the grid minimum."""
    bound = lower_bound(F.col("predicted_value"), F.col("uncertainty"), kappa)
    best = F.min(F.struct(bound.alias("score"), "point_id", "p1", "p2", "predicted_value", "uncertainty"))
    return (
        scored.where(F.col("predicted_value").isNotNull())
        .groupBy(system).agg(best.alias("__b"), F.min("predicted_value").alias("coarse_min"))
        .select(system, "__b.*", F.greatest(F.lit(0.0), F.col("coarse_min") - F.col("__b.predicted_value"))
                .alias("predicted_improvement"))
        .withColumn("candidate_id", parameter_id("p1", "p2"))
    )


def parameter_id(*params: str) -> Column:
    """Candidate id from parameter values; absent parameters are left out."""
    return F.concat_ws("|", *[general_text(F.col(p), 8) for p in params])


def best_observed(df: DataFrame, system: str, value: str, point: str) -> DataFrame:
    best = F.min(F.struct(F.col(value), F.col(point)))
    return df.where(F.col(value).isNotNull()).groupBy(system).agg(best.alias("__b")).select(
        system, F.col(f"__b.{point}").alias("best_point"), F.col(f"__b.{value}").alias("best_value"))


def nearest_to_target(df: DataFrame, system: str, value: str, point: str, target: str) -> DataFrame:
    gap = F.abs(F.col(value) - F.col(target))
    best = F.min(F.struct(gap.alias("gap"), F.col(point), F.col(value)))
    return df.where(F.col(value).isNotNull()).groupBy(system).agg(best.alias("__b")).select(
        system, F.col(f"__b.{point}").alias("nearest_point"), F.col(f"__b.{value}").alias("nearest_value"))


def reachable_target(df: DataFrame, system: str, value: str, requested: float) -> DataFrame:
    """The requested value when it lies in the observed range, else the observed minimum."""
    return df.groupBy(system).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).select(
        system, F.when(F.lit(float(requested)).between(F.col("lo"), F.col("hi")), F.lit(float(requested)))
        .otherwise(F.col("lo")).alias("target"))


def named_weights(modes: Mapping[str, float] = K.GAMMA_MODES) -> list[tuple[str, float]]:
    return list(modes.items())


def penalty_weights(values: Sequence[float] = K.PENALTY_SWEEP) -> list[tuple[str, float]]:
    return [(f"{v:g}", float(v)) for v in values]
