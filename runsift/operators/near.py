"""Points within a tolerance of known points, by equi-joins on cells."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift import constants as K


def drop_near_known(points: DataFrame, known: DataFrame, dims: Sequence[str], keys: Sequence[str] = (),
                    tol: float = K.DUPLICATE_TOLERANCE) -> DataFrame:
    """Points with no known point within ``tol`` in every dimension (left anti join on cells)."""
    return _near_join(points, known, dims, keys, tol, "left_anti")


def keep_near_known(points: DataFrame, known: DataFrame, dims: Sequence[str], keys: Sequence[str] = (),
                    tol: float = K.DUPLICATE_TOLERANCE) -> DataFrame:
    return _near_join(points, known, dims, keys, tol, "left_semi")


def _near_join(points, known, dims, keys, tol, how):
    # Cells are two tolerances wide, so a match is in the same or a neighbouring cell.
    width = F.lit(2.0 * tol)
    cell = {f"__c{i}": F.floor(F.col(d).cast("double") / width) for i, d in enumerate(dims)}
    left = points.withColumns(cell)
    renamed = known.select(*keys, *[F.col(d).cast("double").alias(f"__k{i}") for i, d in enumerate(dims)]).distinct()
    steps = F.array(*[F.array(*[F.lit(s) for s in step]) for step in product((-1, 0, 1), repeat=len(dims))])
    right = renamed.withColumn("__s", F.explode(steps)).select(
        *[F.col(k).alias(f"__key_{k}") for k in keys],
        *[f"__k{i}" for i in range(len(dims))],
        *[(F.floor(F.col(f"__k{i}") / width) + F.col("__s")[i]).alias(f"__n{i}") for i in range(len(dims))])
    match = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]
    match += [F.col(f"__c{i}") == F.col(f"__n{i}") for i in range(len(dims))]
    match += [F.abs(F.col(d) - F.col(f"__k{i}")) <= tol for i, d in enumerate(dims)]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    return left.join(right, condition, how).drop(*cell)
