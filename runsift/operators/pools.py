"""Candidate assembly and resampled candidate pools.

Draws follow the order of md5(seed|id), so they are reproducible on any engine.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsift import constants as K
from runsift.functions.numeric import ratio_or_zero, to_double
from runsift.functions.order import hash_order, match_keys, rank_within, top_rows
from runsift.session import materialize


QUANTILE_ACCURACY = 10_000
SPREAD_ROWS = 100_000  # rows of the strata that one task hashes


def threshold_slice(predictions: DataFrame, threshold: float) -> DataFrame:
    return predictions.where(F.abs(F.col("threshold") - F.lit(threshold)) <= 1e-12)


def model_slice(predictions: DataFrame, experiment: str, model: str, threshold: float,
                limit: int, order: Sequence[Column]) -> DataFrame:
    """First rows of one experiment and model, for a demonstration table."""
    wanted = (F.col("experiment") == experiment) & (F.col("model") == model)
    return threshold_slice(predictions.where(wanted), threshold).orderBy(*order).limit(limit)


def first_per_record(predictions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per record, from its lowest split."""
    kept = F.min_by(F.struct(*columns), F.col("split_id"))
    return predictions.groupBy("record_id").agg(kept.alias("r")).select("record_id", "r.*")


def assemble_candidates(predictions: DataFrame, outcomes: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Candidates at one threshold. Missing risk counts as 0 here; only eV outcomes are attached."""
    columns = ["material_id", "failure_label", "true_failure", "total_failure_risk", "ood_distance"]
    rows = first_per_record(threshold_slice(predictions, threshold), columns)
    energies = outcomes.select("record_id", F.col("energy_ev").alias("known_energy_ev"))
    # Stored, because the bounds below read it once more than the result does.
    joined = materialize(rows.join(energies, "record_id", "left").select(
        F.col("record_id").alias("candidate_id"), "material_id", "failure_label", "true_failure",
        F.coalesce(to_double(F.col("total_failure_risk")), F.lit(0.0)).alias("failure_risk"),
        F.lit(0.0).alias("predicted_value"),
        F.coalesce(to_double(F.col("ood_distance")), F.lit(0.0)).alias("uncertainty"),
        "known_energy_ev"))
    return min_max_normalise(joined, "uncertainty")


def min_max_normalise(df: DataFrame, column: str) -> DataFrame:
    """Scale to [0, 1] over the whole table; a zero span gives 0. Both bounds come from one pass over the column."""
    bounds = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    return df.withColumn("__b", bounds).withColumn(
        column, ratio_or_zero(F.col(column) - F.col("__b.lo"), F.col("__b.hi") - F.col("__b.lo"))).drop("__b")


class Stratum(NamedTuple):
    """Rows of ``population`` that fulfil ``rows``; every trial draws ``want`` of them, or all if there are fewer."""

    mode: str
    rows: Column
    first_seed: int
    want: int
    population: int


def draw_strata(base: DataFrame, strata: Sequence[Stratum], n_trials: int, key: str) -> DataFrame:
    """The draws of all strata from one scan: base columns, pool_mode, trial_id, seed, draw (from 1 in each stratum).

    A row is hashed once per stratum and trial; hashes above the stratum's bound cannot be among the smallest and end in
    the scan's own task. Strata with a trial that is not full are read again with a wider bound, so draws are exact.
    """
    open_shares = {i: (min(s.want, s.population) + 10.0 * s.want ** 0.5 + 20.0) / s.population
                   for i, s in enumerate(strata) if min(s.want, s.population) > 0}
    made = [_below(base, strata, {}, n_trials, key).limit(0)]
    spread = _spread(base, strata, key)
    while open_shares:
        near = materialize(_below(spread, strata, open_shares, n_trials, key))
        found = near.groupBy("__s", "trial_id").count().groupBy("__s").agg(
            F.count(F.lit(1)).alias("trials"), F.min("count").alias("least")).collect()
        got = {r["__s"]: r["least"] if r["trials"] == n_trials else 0 for r in found}
        full = [i for i, share in open_shares.items()
                if share >= 1.0 or got.get(i, 0) >= min(strata[i].want, strata[i].population)]
        made.append(near.where(F.col("__s").isin(full)))
        open_shares = {i: share * 4.0 for i, share in open_shares.items() if i not in full}
    rows = made[0]
    for more in made[1:]:
        rows = rows.unionByName(more)
    return top_rows(rows, [F.col("__h"), F.col(key)], F.col("__want"), "draw", ["__s", "trial_id"]).drop("__h", "__s", "__want")


def _below(base: DataFrame, strata: Sequence[Stratum], shares: dict[int, float], n_trials: int, key: str) -> DataFrame:
    """Rows of the strata named by ``shares``, once per trial in which their hash is below the bound."""
    options = [F.when(strata[i].rows, F.struct(
        F.lit(i).alias("s"), F.lit(strata[i].mode).alias("mode"), F.lit(strata[i].first_seed).alias("first"),
        F.lit(strata[i].want).alias("want"), F.lit(_bound(share)).alias("bound"))) for i, share in shares.items()]
    empty = F.lit(None).cast("array<struct<s:int,mode:string,first:int,want:int,bound:string>>")
    wide = base.withColumn("__o", F.explode(F.array_compact(F.array(*options)) if options else empty)).withColumn(
        "trial_id", F.explode(F.sequence(F.lit(0), F.lit(n_trials - 1)))).withColumn(
        "seed", F.col("trial_id") + F.col("__o.first")).withColumn("__h", hash_order(F.col("seed"), key))
    return wide.where(F.col("__h") <= F.col("__o.bound")).withColumns({
        "pool_mode": F.col("__o.mode"), "__s": F.col("__o.s"), "__want": F.col("__o.want")}).drop("__o")


def _bound(share: float) -> str:
    return "z" if share >= 1.0 else format(int(share * 16 ** 12), "012x") + "f" * 20


def _spread(base: DataFrame, strata: Sequence[Stratum], key: str) -> DataFrame:
    """Every row is hashed many times, so the rows are first dealt over the cores, and over more tasks where there are many."""
    rows = sum(s.population for s in strata)
    tasks = max(base.sparkSession.sparkContext.defaultParallelism, -(-rows // SPREAD_ROWS))
    return base.repartition(tasks, key)


def draw(base: DataFrame, n_trials: int, first_seed: int, size: int, key: str,
         population: int | None = None) -> DataFrame:
    """``size`` rows per trial without replacement, in hash order."""
    n = base.count() if population is None else population
    return draw_strata(base, [Stratum("", F.lit(True), first_seed, size, n)], n_trials, key).drop("pool_mode")


def draw_with_replacement(base: DataFrame, n_trials: int, first_seed: int, size: int, key: str) -> DataFrame:
    """For targets above the population: each draw picks a hashed row number, from 60 bits of the hash."""
    numbered = rank_within(base, [F.col(key)], "__row")
    n = numbered.count()
    spark = base.sparkSession
    draws = spark.range(n_trials * size).select(
        F.floor(F.col("id") / size).cast("int").alias("trial_id"), (F.col("id") % size + 1).alias("draw"),
    ).withColumn("seed", F.col("trial_id") + first_seed)
    picked = F.conv(F.substring(hash_order(F.col("seed"), "draw"), 1, 15), 16, 10).cast("long") % n + 1
    return draws.withColumn("__row", picked).join(numbered, "__row").drop("__row")


def class_sizes(base: DataFrame) -> dict[int, int]:
    """Rows with true_failure 0 and 1."""
    found = {r["true_failure"]: r["count"] for r in base.groupBy("true_failure").count().collect()}
    return {0: found.get(0, 0), 1: found.get(1, 0)}


def _normal(sizes: dict[int, int], size: int, seed: int) -> list[Stratum]:
    return [Stratum("normal_pool", F.lit(True), seed + K.SEED_OFFSETS["normal_pool"], size, sum(sizes.values()))]


def _enriched(sizes: dict[int, int], size: int, seed: int) -> list[Stratum]:
    """Failures make up 60 percent where there are enough of them."""
    mode = "failure_enriched_pool"
    first = seed + K.SEED_OFFSETS[mode]
    failures = min(round(size * K.ENRICHED_FRACTION), sizes[1])
    return [Stratum(mode, F.col("true_failure") == 1, first, failures, sizes[1]),
            Stratum(mode, F.col("true_failure") == 0, first, min(size - failures, sizes[0]), sizes[0])]


def _top_uncertainty(base: DataFrame, sizes: dict[int, int], size: int, seed: int, key: str) -> list[Stratum]:
    """The most uncertain half."""
    mode, n = "high_uncertainty_pool", sum(sizes.values())
    top = max(1, int(n * K.TOP_FRACTION))
    return [Stratum(mode, among_first(base, "uncertainty", key, top, n), seed + K.SEED_OFFSETS[mode], size, min(top, n))]


def among_first(base: DataFrame, value: str, key: str, top: int, n: int) -> Column:
    """Whether a row is among the ``top`` of ``n`` with the highest values, ties by key; null values come last.

    An approximate quantile brackets the value of the last such row. Only rows inside the bracket are sorted, in narrow
    form, to find that row exactly; the others are counted.
    """
    if top >= n:
        return F.lit(True)
    lowest = F.lit(float("-inf"))
    narrow = base.select(F.coalesce(F.col(value).cast("double"), lowest).alias("__v"), F.col(key).alias("__k"))
    at, slack = (n - top) / n, 2.0 / QUANTILE_ACCURACY
    low, high = narrow.agg(F.percentile_approx(
        "__v", [max(0.0, at - slack), min(1.0, at + slack)], QUANTILE_ACCURACY)).first()[0]
    above, inside = narrow.agg(F.count_if(F.col("__v") > high), F.count_if(F.col("__v").between(low, high))).first()
    if not above < top <= above + inside:
        above, low, high = 0, float("-inf"), float("inf")
    ranked = rank_within(narrow.where(F.col("__v").between(low, high)), [F.col("__v").desc(), F.col("__k")], "__r")
    last = ranked.where(F.col("__r") == top - above).select("__v", "__k").first()
    own = F.coalesce(F.col(value).cast("double"), lowest)
    return (own > last["__v"]) | (own == last["__v"]) & (F.col(key) <= last["__k"])


def normal_pool(base: DataFrame, n_trials: int = K.TRIALS, size: int = K.POOL_SIZE, seed: int = K.BASE_SEED,
                key: str = "candidate_id", sizes: dict[int, int] | None = None) -> DataFrame:
    return draw_strata(base, _normal(sizes or class_sizes(base), size, seed), n_trials, key)


def enriched_pool(base: DataFrame, n_trials: int = K.TRIALS, size: int = K.POOL_SIZE, seed: int = K.BASE_SEED,
                  key: str = "candidate_id", sizes: dict[int, int] | None = None) -> DataFrame:
    return draw_strata(base, _enriched(sizes or class_sizes(base), size, seed), n_trials, key)


def group_pool(base: DataFrame, n_trials: int = K.TRIALS, target: int = K.GROUP_TARGET, seed: int = K.BASE_SEED,
               group: str = "material_id") -> DataFrame:
    """Whole groups in hash order until the pool has ``target`` rows; the crossing group is included."""
    first = seed + K.SEED_OFFSETS["heldout_material_pool"]
    sizes = base.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    # Each group has at least one row, so ``target`` groups are always enough.
    drawn = draw(sizes, n_trials, first, target, group)
    before = F.sum("__n").over(
        Window.partitionBy("trial_id").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1))
    chosen = drawn.withColumn("__before", F.coalesce(before, F.lit(0))).where(F.col("__before") < target)
    # At most n_trials * target rows, so the count finds it small unless those are raised a lot.
    pool = match_keys(base, chosen.select(group, "trial_id", "seed", "draw"), [group], check_size=True)
    return pool.withColumn("pool_mode", F.lit("heldout_material_pool"))


def top_uncertainty_pool(base: DataFrame, n_trials: int = K.TRIALS, size: int = K.POOL_SIZE,
                         seed: int = K.BASE_SEED, key: str = "candidate_id",
                         sizes: dict[int, int] | None = None) -> DataFrame:
    return draw_strata(base, _top_uncertainty(base, sizes or class_sizes(base), size, seed, key), n_trials, key)


def all_pools(base: DataFrame, n_trials: int = K.TRIALS, smallest: int = max(K.TOP_K), size: int = K.POOL_SIZE,
              seed: int = K.BASE_SEED, key: str = "candidate_id") -> DataFrame:
    """Every mode and trial in one table, without pools smaller than the largest k.

    The modes that draw rows share one scan; the mode that draws groups has its own.
    """
    sizes = class_sizes(base)
    strata = [*_normal(sizes, size, seed), *_enriched(sizes, size, seed), *_top_uncertainty(base, sizes, size, seed, key)]
    pools = draw_strata(base, strata, n_trials, key).unionByName(group_pool(base, n_trials, seed=seed))
    # The pools are read several times and hold far fewer rows than the base, unless a whole group is large.
    return size_gate(materialize(pools), smallest)


def size_gate(pools: DataFrame, smallest: int) -> DataFrame:
    keys = ["pool_mode", "trial_id"]
    large = pools.groupBy(*keys).count().where(F.col("count") >= smallest).select(*keys)
    return pools.join(large, keys, "left_semi")
