"""Train/test splits, reproducible through hashed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift import constants as K
from runsift.functions.order import hash_order, match_keys, rank_within


def stratified_split(rows: DataFrame, label: str, record: str, seed: int = K.BASE_SEED,
                     share: float = K.TEST_SHARE) -> DataFrame:
    """The share of each class that comes first in hash order is the test set."""
    hashed = rows.withColumn("__h", hash_order(seed, record))
    ranked = rank_within(hashed, [F.col("__h"), F.col(record)], "__r", [label], total="__n")
    limit = F.floor(F.col("__n") * share + 0.5)
    return ranked.withColumn("is_test", (F.col("__r") <= limit).cast("int")).drop("__r", "__n", "__h")


def group_splits(rows: DataFrame, group: str, n_splits: int = K.GROUP_SPLITS, seed: int = K.BASE_SEED,
                 share: float = K.TEST_SHARE) -> DataFrame:
    """One row per (split, group): a share of the groups, not of the rows, is the test set."""
    groups = rows.select(group).distinct()
    spread = groups.withColumn("split_id", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    hashed = spread.withColumn("__h", hash_order(F.col("split_id") + seed, group))
    ranked = rank_within(hashed, [F.col("__h"), F.col(group)], "__r", ["split_id"], total="__n")
    return ranked.withColumn("is_test", (F.col("__r") <= F.ceil(F.col("__n") * F.lit(share))).cast("int")).select(
        "split_id", group, "is_test")


def group_split(rows: DataFrame, group: str, seed: int = K.BASE_SEED, share: float = K.TEST_SHARE) -> DataFrame:
    """Rows with is_test for a single hold-out of whole groups."""
    table = group_splits(rows, group, 1, seed, share).select(group, "is_test")
    return match_keys(rows, table, [group])


def with_test_splits(rows: DataFrame, group: str, n_splits: int = K.GROUP_SPLITS, seed: int = K.BASE_SEED) -> DataFrame:
    """Rows with the ids of the splits that hold them out; the rows are not copied per split."""
    table = group_splits(rows, group, n_splits, seed)
    held = table.groupBy(group).agg(F.array_sort(F.collect_list(F.when(F.col("is_test") == 1, F.col("split_id")))).alias("test_splits"))
    return match_keys(rows, held, [group])
