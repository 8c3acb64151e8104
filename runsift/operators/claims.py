"""Greedy choice under a distance tolerance, in priority order, settled in rounds.

Claimants come in a strict order and have one or more options, each a point. The rule is sequential: every claimant in
turn takes its first option that lies farther than the tolerance, in some dimension, from all points taken before it.
A claimant whose options are all gone takes none.

A round settles each claimant that no undecided earlier one can disturb: none of those has an option left in the cells
around its own first one. What is settled is therefore final, and options near it go. The first undecided claimant of a
key always settles, so rounds end; their number follows the longest chain of claimants that wait for each other, not the
number of rows. Per cell only the first claimant can settle, so a point shared by a third of all rows is one row of the
round's table.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift import constants as K
from runsift.operators.near import drop_near_known
from runsift.session import materialize

CLAIM_ROWS = 100_000  # options that one task holds


def first_at_point(points: DataFrame, keys: Sequence[str], dims: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each exact position. Whatever bars it also bars the others there, so none of them can be taken."""
    picked = points.groupBy(*keys, *[F.col(d) for d in dims]).agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in points.columns]), F.struct(*order)).alias("__b"))
    return picked.select("__b.*")


def settle_claims(options: DataFrame, keys: Sequence[str], claimant: str, trial: str, dims: Sequence[str],
                  tol: float = K.DUPLICATE_TOLERANCE) -> DataFrame:
    """The options that are taken, with all their columns; ``claimant`` and ``trial`` give both orders.

    A point with a null or NaN coordinate is near nothing. Rows that repeat a claimant and trial count once.
    """
    width = F.lit(2.0 * tol)
    cells = [f"__cell{i}" for i in range(len(dims))]
    open_ended = F.lit(False)
    for d in dims:
        open_ended = open_ended | F.col(d).isNull() | F.isnan(F.col(d).cast("double"))
    columns = list(options.columns)
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    # An option without a position stands in a cell of its own.
    alone = F.when(open_ended, F.col(claimant)).alias("__alone")
    place = [F.when(~open_ended, F.floor(F.col(d).cast("double") / width)).alias(c) for d, c in zip(dims, cells, strict=True)]
    steps = F.array(*[F.array(*[F.lit(s) for s in step]) for step in product((-1, 0, 1), repeat=len(dims))])
    taken: list[DataFrame] = []
    rest = materialize(options)
    tasks = -(-rest.count() // CLAIM_ROWS)
    if tasks > 1:
        # The options may come from one row group; each round sorts the rows that a task holds.
        rest = materialize(rest.repartition(tasks, claimant))
    while not rest.isEmpty():
        firsts = rest.groupBy(*keys, claimant).agg(F.min_by(row, F.col(trial)).alias("__row")).select("__row.*")
        heads = firsts.select("*", alone, *place).groupBy(*keys, "__alone", *cells).agg(
            F.min_by(row, F.col(claimant)).alias("__row")).select("__row", *keys, *cells)
        lowest = rest.where(~open_ended).select(*keys, claimant, *place).groupBy(*keys, *cells).agg(F.min(claimant).alias("__low"))
        around = heads.withColumn("__step", F.explode(steps)).withColumns(
            {c: F.col(c) + F.col("__step")[i] for i, c in enumerate(cells)})
        match = [around[k].eqNullSafe(lowest[k]) for k in keys] + [around[c] == lowest[c] for c in cells]
        condition = match[0]
        for m in match[1:]:
            condition = condition & m
        seen = around.join(lowest, condition, "left").select(*[around[k] for k in keys], "__row", "__low")
        settled = materialize(
            seen.groupBy(*keys, F.col(f"__row.{claimant}").alias("__who")).agg(
                F.min("__low").alias("__low"), F.first("__row").alias("__row"))
            .where(F.col("__low").isNull() | (F.col("__low") >= F.col("__who"))).select("__row.*"))
        taken.append(settled)
        who = settled.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(claimant).alias("__who")).distinct()
        done = F.col(claimant) == F.col("__who")
        for k in keys:
            done = done & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        rest = materialize(drop_near_known(rest.join(who, done, "left_anti"), settled.where(~open_ended), dims, keys, tol))
    out = options.limit(0)
    for part in taken:
        out = out.unionByName(part)
    return out
