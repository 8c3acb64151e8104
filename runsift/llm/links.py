"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.llm.storage import store


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small(edges: DataFrame) -> DataFrame:
    least = store(edges.groupBy("a").agg(F.min("b").alias("m")))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """Columns ``a`` and ``b`` (bigint) in; ``id`` and ``root`` out, the smallest id of the component.

    Only ids that have a link to another one are returned. Runs jobs while the plan is built: about log n rounds,
    each on a stored table with one row per link at most. Minima are combined before the exchange, and the two joins
    of a round read stored tables, so a node with very many links is split over tasks.
    """
    now = store(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
                .where("a <> b").distinct())
    before, mark = None, _mark(now)
    while mark != before and mark[0]:
        grown = store(_large(now).distinct())
        now = store(_small(grown).distinct())
        before, mark = mark, _mark(now)
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
