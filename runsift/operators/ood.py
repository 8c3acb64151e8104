"""Distance of new rows from the training rows, exact and approximate.

Vectors are array columns, whose last numbers may be codes of categories (``ball_tree.py``). Nothing forms all pairs as rows: a task compares one bounded block of
queries with one bounded block of references and returns one best distance per query.
"""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift import constants as K
from runsift.functions.order import quantile_within
from runsift.operators.ball_tree import block_nearest, build_tree, search
from runsift.session import materialize


def distinct_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """One row per different vector with its number of copies, so copies never fill a block."""
    return rows.groupBy(F.col(vector).cast("array<double>").alias("vec")).agg(
        F.min(key).alias("ref_id"), F.count(F.lit(1)).alias("copies"))


def nearest_distances(queries: DataFrame, refs: DataFrame, skip_same: bool = False, codes: int = 0) -> DataFrame:
    """Exact distance of each query to its nearest reference, and the number of references it was compared with.

    ``queries``: query_id, vec. ``refs``: ref_id, vec, different vectors.
    """
    return search(queries, build_tree(refs, codes), skip_same)


def test_distances(test: DataFrame, train: DataFrame, key: str, vector: str, codes: int = 0) -> DataFrame:
    """Distance of each test row to its nearest training row."""
    queries = test.select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("vec"))
    return nearest_distances(queries, distinct_vectors(train, key, vector), codes=codes).select(F.col("query_id").alias(key), "distance")


def train_distances(train: DataFrame, key: str, vector: str, codes: int = 0) -> DataFrame:
    """Distance of each different training vector to its nearest other row, with its number of copies."""
    refs = materialize(distinct_vectors(train, key, vector))
    lone = refs.where("copies = 1").select(F.col("ref_id").alias("query_id"), "vec")
    found = nearest_distances(lone, refs, skip_same=True, codes=codes)
    return refs.join(found, refs.ref_id == found.query_id, "left").select(
        "ref_id", "copies", F.when(F.col("copies") > 1, 0.0).otherwise(F.col("distance")).alias("distance"))


def distance_threshold(distances: DataFrame, q: float = K.OOD_QUANTILE) -> DataFrame:
    """One row: the quantile of the training distances, each copy counted."""
    return quantile_within(distances, "distance", q, "threshold", "ref_id", weight="copies")


def flag_outliers(test: DataFrame, train: DataFrame, key: str, vector: str, codes: int = 0) -> DataFrame:
    """Test rows farther away than almost all training rows are from each other."""
    if train.limit(2).count() < 2:
        return test.select(key, F.lit(0.0).alias("ood_distance"), F.lit(0).alias("ood_flag"))
    limit = distance_threshold(train_distances(train, key, vector, codes)).scalar()
    found = test_distances(test, train, key, vector, codes).withColumn("__t", limit)
    return found.select(key, F.col("distance").alias("ood_distance"),
                        (F.col("distance") > F.col("__t")).cast("int").alias("ood_flag"))


def approximate_distances(test: DataFrame, train: DataFrame, key: str, vector: str, bucket: float,
                          tables: int = 4, seed: int = K.BASE_SEED) -> DataFrame:
    """Nearest training row among those that share a random-projection bucket; null when none does.

    An upper bound of the exact distance, for sizes where the exact search visits too many cells.
    """
    refs = distinct_vectors(train, key, vector).withColumn("features", array_to_vector("vec"))
    asked = test.select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("vec"))
    lsh = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(refs)

    def spread(df: DataFrame, key_name: str) -> DataFrame:
        hashed = lsh.transform(df)
        buckets = F.transform("hashes", lambda h: F.element_at(vector_to_array(h), 1).cast("long"))
        return materialize(hashed.select(key_name, "vec", F.posexplode(buckets).alias("table", "bucket")))

    left = spread(asked.withColumn("features", array_to_vector("vec")), "query_id")
    best = block_nearest(left, spread(refs, "ref_id"), ["table", "bucket"], False)
    return asked.select("query_id").join(best, "query_id", "left").select(F.col("query_id").alias(key), "distance")
