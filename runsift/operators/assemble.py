"""Result reuse, referenced values, seeds, structure screen and batch merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift import constants as K
from runsift.functions.numeric import ratio
from runsift.functions.order import small_side
from runsift.operators.claims import first_at_point, settle_claims
from runsift.operators.near import drop_near_known
from runsift.session import materialize

PLACED_ROWS = 250_000  # members whose cells one task counts


def reuse_key(system: str, params: Sequence[str], settings: Sequence[str]) -> Column:
    """System, parameters with six digits, and settings."""
    named = [F.concat(F.lit(f"{p}="), F.format_string("%.6f", F.col(p).cast("double"))) for p in params]
    return F.concat_ws(":", F.col(system).cast("string"), *named, *[F.col(s).cast("string") for s in settings])


def reuse_results(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Attach stored values by key; requests without one are missing. ``known``: reuse_key, energy."""
    stored = known.groupBy("reuse_key").agg(F.min("energy").alias("energy"))
    return requests.join(stored, "reuse_key", "left").withColumn("is_missing", F.col("energy").isNull().cast("int"))


def missing_requests(requests: DataFrame, known: DataFrame) -> DataFrame:
    return requests.join(known.select("reuse_key").distinct(), "reuse_key", "left_anti")


def referenced_values(totals: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Total minus the sum of reference values, per member where asked.

    ``totals``: key, total, n_members, per_member. ``references``: key, energy.
    """
    sums = references.groupBy(key).agg(F.sum("energy").alias("__ref"))
    left = F.col("total") - F.coalesce(F.col("__ref"), F.lit(0.0))
    return totals.join(sums, key, "left").withColumn(
        "value", F.when(F.col("per_member"), ratio(left, F.col("n_members"))).otherwise(left)).drop("__ref")


def seed_trials(seeds: DataFrame, step: float = K.SEED_OFFSET_STEP) -> DataFrame:
    """The base point, then one step down and up in each variable, clipped to the bounds.

    ``seeds``: seed_id, p1, lo1, hi1, p2, lo2, hi2; p2 is null for one variable.
    """
    def moved(i: int, sign: int) -> Column:
        p = F.least(F.greatest(F.col(f"p{i}") + sign * step, F.col(f"lo{i}")), F.col(f"hi{i}"))
        return F.struct((p if i == 1 else F.col("p1")).alias("t1"), (p if i == 2 else F.col("p2")).alias("t2"))

    base = F.struct(F.col("p1").alias("t1"), F.col("p2").alias("t2"))
    one = F.array(base, moved(1, -1), moved(1, 1))
    two = F.array(base, moved(1, -1), moved(1, 1), moved(2, -1), moved(2, 1))
    trials = F.when(F.col("p2").isNull(), one).otherwise(two)
    return seeds.select("*", F.posexplode(trials).alias("trial", "__t")).select("*", "__t.t1", "__t.t2").drop("__t")


def trial_outcomes(trials: DataFrame, outcomes: DataFrame, system: str, tol: float = K.DUPLICATE_TOLERANCE) -> DataFrame:
    """Trials with the known value nearest to them, at most ``tol`` away in each variable; the least of equally near ones.

    ``outcomes``: system, t1, t2, energy; a null energy is a failure. A missing variable counts as 0.
    """
    at = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("t1", "t2")}
    done = outcomes.where(F.col("energy").isNotNull()).groupBy(
        F.col(system).alias("__system"), at["t1"].alias("__o1"), at["t2"].alias("__o2")).agg(F.min("energy").alias("__energy"))
    width = F.lit(2.0 * tol)
    cell = {f"__c{i}": F.floor(at[f"t{i}"] / width) for i in (1, 2)}
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    near = done.withColumn("__s", F.explode(steps)).withColumns({
        "__n1": F.floor(F.col("__o1") / width) + F.col("__s.a"), "__n2": F.floor(F.col("__o2") / width) + F.col("__s.b")})
    gap = F.greatest(F.abs(at["t1"] - F.col("__o1")), F.abs(at["t2"] - F.col("__o2")))
    # Trials meet outcomes by position, so seeds that share one ask once; few places are sent to all tasks, as many trials
    # at few places would be sorted by few tasks.
    places = trials.select(F.col(system).alias("__asks"), at["t1"].alias("t1"), at["t2"].alias("t2")).distinct().withColumns(cell)
    values = places.join(near, (F.col("__asks") == F.col("__system")) & (F.col("__c1") == F.col("__n1"))
                         & (F.col("__c2") == F.col("__n2")) & (gap <= tol)).groupBy("__asks", "t1", "t2").agg(
        F.min(F.struct(gap.alias("gap"), F.col("__energy").alias("energy")))["energy"].alias("energy")).select(
        "__asks", F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), "energy")
    values = small_side(materialize(values))
    return trials.join(values, (F.col(system) == F.col("__asks")) & (at["t1"] == F.col("__t1")) & (at["t2"] == F.col("__t2"))).drop(
        "__asks", "__t1", "__t2")


def first_successes(trials: DataFrame, outcomes: DataFrame, system: str, tol: float = K.DUPLICATE_TOLERANCE) -> DataFrame:
    """The label of each seed: its first trial with a known value that no earlier seed has taken already.

    Seeds go by ``seed_id`` within a system. A seed whose trials all failed or are taken has no row.
    """
    tried = trial_outcomes(trials, outcomes, system, tol).withColumns(
        {"__t1": F.coalesce("t1", F.lit(0.0)), "__t2": F.coalesce("t2", F.lit(0.0))})
    return settle_claims(tried, [system], "seed_id", "trial", ["__t1", "__t2"], tol).drop("__t1", "__t2")


def label_gate(labels: DataFrame, system: str, dim: str) -> DataFrame:
    """Enough different initial labels: three for one variable, five for two."""
    cells = [F.round(F.coalesce(F.col(c), F.lit(0.0)) / K.DUPLICATE_TOLERANCE).alias(f"__{c}") for c in ("t1", "t2")]
    distinct = labels.select(system, dim, *cells).distinct()
    needed = F.when(F.col(dim) == 1, K.MIN_LABELS[1]).otherwise(K.MIN_LABELS[2])
    return distinct.groupBy(system, dim).agg(F.count(F.lit(1)).alias("n_labels")).withColumn(
        "enough", (F.col("n_labels") >= needed).cast("int"))


def merge_batch(labels: DataFrame, batch: DataFrame, dims: Sequence[str], keys: Sequence[str], order: Sequence[str],
                value: str = "energy", tol: float = K.DUPLICATE_TOLERANCE) -> DataFrame:
    """Append batch results that have a value and are new, in the order of the batch.

    New means farther than ``tol``, in some dimension, from all labels and from every result appended before. ``order``
    names the batch columns that give its order; of two results at one place the first stays.
    """
    got = batch.where(F.col(value).isNotNull())
    fresh = drop_near_known(got, labels, dims, keys, tol)
    turn = F.struct(*order, *dims)
    single = first_at_point(fresh, keys, dims, [turn]).withColumns({"__turn": turn, "__trial": F.lit(0)})
    return labels.unionByName(settle_claims(single, keys, "__turn", "__trial", dims, tol).select(*labels.columns))


def overlap_screen(members: DataFrame, structure: str, limit: float = K.MIN_PAIR_DISTANCE) -> DataFrame:
    """Structures in which two members are closer than ``limit``, nearest periodic image included.

    ``members``: structure, x, y, z and box lengths lx, ly, lz (null for an open direction). Two members
    in one fine cell, whose diagonal is below the limit, already overlap: such cells are only counted and
    no pair is formed. The other fine cells hold one member each, so a coarse cell holds a number of them
    that geometry fixes. Members meet in coarse cells; one side also enters the cells within the limit.
    """
    fine, coarse = limit / (3.0 ** 0.5) * 0.999, 4.0 * limit
    staged = members
    for a in "xyz":
        box, p = F.col(f"l{a}"), F.col(f"__p{a}")
        many = F.ceil(box / fine)
        width = F.when(box.isNull(), F.lit(fine)).otherwise(box / many)
        staged = staged.withColumn(f"__p{a}", F.when(box.isNull(), F.col(a)).otherwise(F.pmod(F.col(a), box)))
        staged = staged.withColumn(
            f"__c{a}", F.when(box.isNull(), F.floor(p / width)).otherwise(F.least(F.floor(p / width), many - 1)))
    cell = [f"__c{a}" for a in "xyz"]
    kept = [f"{p}{a}" for p in ("__p", "l") for a in "xyz"]
    # Dealt before the rows are counted: most cells hold one row, so a task that reads much would keep all of it for nothing.
    tasks = max(members.sparkSession.sparkContext.defaultParallelism, -(-members.count() // PLACED_ROWS))
    # Three steps read the cells, so they are stored once.
    per_cell = materialize(
        staged.select(structure, *cell, *[f"{p}{a}" for p in ("__p", "l") for a in "xyz"]).repartition(tasks, structure, *cell).groupBy(structure, *cell).agg(F.count(F.lit(1)).alias("__m"), *[F.first(c).alias(c) for c in kept]))
    crowded = per_cell.groupBy(structure).agg(F.sum("__m").cast("long").alias("n_members"), F.max("__m").alias("__most"))
    single = per_cell.where("__m = 1")
    home, reach = {}, {}
    for a in "xyz":
        box, p = F.col(f"l{a}"), F.col(f"__p{a}")
        cells = F.greatest(F.floor(box / coarse), F.lit(1))
        width = F.when(box.isNull(), F.lit(coarse)).otherwise(box / cells)

        def place(x: Column, box=box, cells=cells, width=width) -> Column:
            at = F.floor(x / width)
            return F.when(box.isNull(), at).otherwise(F.pmod(at, cells))

        home[f"__h{a}"] = place(p)
        reach[f"__h{a}"] = F.array_distinct(F.array(place(p - limit), place(p), place(p + limit)))
    own = single.select(structure, *cell, *kept, *[c.alias(n) for n, c in home.items()])
    other = single.select(
        structure, *[F.col(f"__c{a}").alias(f"__o{a}") for a in "xyz"], *[F.col(f"__p{a}").alias(f"__q{a}") for a in "xyz"],
        *[c.alias(n) for n, c in reach.items()])
    for n in reach:
        other = other.withColumn(n, F.explode(n))
    # Closeness is mutual, so each pair is looked at from one side.
    before = F.struct(*cell) < F.struct(*[F.col(f"__o{a}") for a in "xyz"])
    squares = F.lit(0.0)
    for a in "xyz":
        gap = F.col(f"__p{a}") - F.col(f"__q{a}")
        image = F.when(F.col(f"l{a}").isNull(), gap).otherwise(gap - F.col(f"l{a}") * F.round(gap / F.col(f"l{a}")))
        squares = squares + image * image
    close = own.join(other, [structure, *home]).where(before & (F.sqrt(squares) < limit)).select(structure).distinct()
    flagged = crowded.join(close.withColumn("__close", F.lit(1)), structure, "left")
    return flagged.select(
        structure, "n_members",
        F.when((F.col("__most") > 1) | F.col("__close").isNotNull(), 0).otherwise(1).alias("valid"))
