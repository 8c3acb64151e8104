"""Ranks, running values and quantiles that never put a whole group on one task.

A window over a hot key (or over no key at all) runs in one task. The helpers below sort with one
range exchange instead. Each task numbers its own slice, and the number of rows that sort before
a slice comes from a table with one row per (key, slice). A key that holds a third of all rows is
simply spread over a third of the slices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsift.session import materialize

_POS, _SLICE, _FIRST, _BEFORE = "__pos", "__slice", "__first", "__before"
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def sorted_slices(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Sort by keys then order, and store the rows with their slice number and position.

    The stored copy fixes the slice bounds, so a lost executor cannot move rows between slices.
    ``order`` must end in a unique column.
    """
    placed = df.orderBy(*keys, *order).withColumn(_POS, F.monotonically_increasing_id())
    return materialize(placed.withColumn(_SLICE, F.shiftright(F.col(_POS), 33)))


def match_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], check_size: bool = False) -> DataFrame:
    """Inner join in which a null key matches a null key, so no row is lost."""
    named = right.select(*[F.col(k).alias(f"__on_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__on_{k}")) for k in keys])
    return left.join(small_side(named) if check_size else named, condition).drop(*[f"__on_{k}" for k in keys])


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a narrow table only after counting its rows and the bytes of its texts; a larger one joins by exchange."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{n}`")), F.lit(0)) for n, t in df.dtypes if t in ("string", "binary")]
    width = reduce(lambda a, b: a + b, texts, F.lit(16 * len(df.columns)))
    rows, size = df.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and size <= limit_bytes else df


def _with_slice_totals(placed: DataFrame, keys: Sequence[str], totals: Mapping[str, Column],
                       combine: Mapping[str, str], whole: str | None = None) -> DataFrame:
    by = [*keys, _SLICE]
    per_slice = placed.groupBy(*by).agg(F.min(_POS).alias(_FIRST), *[c.alias(n) for n, c in totals.items()])
    # One row per (key, slice): a key has at most as many rows here as there are slices.
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum(_BEFORE).over(Window.partitionBy(*keys)).cast("long").alias(whole)] if whole else []
    carried = per_slice.select(
        *by, _FIRST, *[getattr(F, combine[n])(n).over(earlier).alias(n) for n in totals], *extra)
    return match_keys(placed, carried, by, check_size=True)


def rank_within(df: DataFrame, order: Sequence[Column], name: str, keys: Sequence[str] = (),
                total: str | None = None) -> DataFrame:
    """Row numbers 1, 2, 3, ... inside each key, in the given order; ``total`` names the rows per key."""
    placed = sorted_slices(df, order, keys)
    joined = _with_slice_totals(placed, keys, {_BEFORE: F.count(F.lit(1))}, {_BEFORE: "sum"}, total)
    rank = F.col(_POS) - F.col(_FIRST) + F.coalesce(F.col(_BEFORE), F.lit(0)) + 1
    return joined.withColumn(name, rank.cast("long")).drop(_POS, _SLICE, _FIRST, _BEFORE)


def rank_measures(df: DataFrame, measures: Mapping[str, Column], unique: str, keys: Sequence[str] = ()) -> DataFrame:
    """Keys, ``unique`` and, per measure, the rank of its value inside the key: lowest first, ties by ``unique``.

    All measures share one range exchange, in rows of (measure number, keys, value, ``unique``); only these narrow rows
    are sorted and stored. Rows with the same keys and ``unique`` would get one common rank.
    """
    each = F.array(*[F.struct(F.lit(i).alias("m"), c.cast("double").alias("v")) for i, c in enumerate(measures.values())])
    narrow = df.select(*keys, unique, F.explode(each).alias("__e")).select(
        *keys, unique, F.col("__e.m").alias("__m"), F.col("__e.v").alias("__v"))
    ranked = rank_within(narrow, [F.col("__v"), F.col(unique)], "__r", ["__m", *keys])
    return ranked.groupBy(*keys, unique).agg(
        *[F.max(F.when(F.col("__m") == i, F.col("__r"))).alias(n) for i, n in enumerate(measures)])


def running_within(df: DataFrame, order: Sequence[Column], values: Mapping[str, tuple[str, Column]],
                   keys: Sequence[str] = ()) -> DataFrame:
    """Inclusive running values inside each key; ``values`` maps a name to (sum | min | max, column)."""
    placed = sorted_slices(df, order, keys)
    totals = {f"__c_{n}": getattr(F, fn)(c) for n, (fn, c) in values.items()}
    combine = {f"__c_{n}": fn for n, (fn, _) in values.items()}
    joined = _with_slice_totals(placed, keys, totals, combine)
    local = Window.partitionBy(*keys, _SLICE).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    out = joined
    for n, (fn, c) in values.items():
        here, before = getattr(F, fn)(c).over(local), F.col(f"__c_{n}")
        if fn == "sum":
            merged = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
        else:
            merged = (F.least if fn == "min" else F.greatest)(here, before)
        out = out.withColumn(n, merged)
    return out.drop(_POS, _SLICE, _FIRST, *totals)


def quantile_within(df: DataFrame, value: str, q: float, name: str, unique: str,
                    keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Exact quantile with linear interpolation, one row per key; null values are left out.

    ``weight`` counts equal rows that were merged before.
    """
    times = F.col(weight) if weight else F.lit(1).cast("long")
    present = df.where(F.col(value).isNotNull()).select(
        *dict.fromkeys([*keys, unique, value]), times.alias("__w"))
    summed = running_within(present, [F.col(value), F.col(unique)], {"__cum": ("sum", F.col("__w"))}, keys)
    counts = present.groupBy(*keys).agg(F.sum("__w").alias("__n"))
    with_n = match_keys(summed, counts, keys) if keys else summed.withColumn("__n", counts.select("__n").scalar())
    spot = (F.col("__n") - 1) * F.lit(float(q))
    lower, part = F.floor(spot) + 1, spot - F.floor(spot)
    low = F.min(F.when(F.col("__cum") >= lower, F.col(value)))
    high = F.min(F.when(F.col("__cum") >= lower + 1, F.col(value)))
    return with_n.groupBy(*keys).agg((low + F.coalesce((high - low) * F.max(part), F.lit(0.0))).alias(name))


def hash_order(seed: Column | int, *ids: str) -> Column:
    """Reproducible pseudo-random order key."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws("|", seed.cast("string"), *[F.col(i).cast("string") for i in ids]))


def top_rows(df: DataFrame, order: Sequence[Column], k: int | Column, name: str,
             keys: Sequence[str]) -> DataFrame:
    """First k rows per key. Spark trims each task to k rows before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= k)
