"""Out-of-distribution distance over the embedding vectors; whole labels are held out."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsift.operators import ood as O
from runsift.operators import splits as S
from runsift.plans.inputs import table


def _sets(spark, d):
    rows = S.group_split(table(spark, d, "embeddings"), "label")
    return rows.where("is_test = 1"), rows.where("is_test = 0")


def ood_exact(spark, d):
    test, train = _sets(spark, d)
    return O.test_distances(test, train, "vec_id", "embedding").select("vec_id", F.round("distance", 6).alias("ood_distance"))


def ood_threshold(spark, d):
    _, train = _sets(spark, d)
    out = O.distance_threshold(O.train_distances(train, "vec_id", "embedding"))
    return out.select(F.round("threshold", 6).alias("threshold"))


def ood_flag(spark, d):
    test, train = _sets(spark, d)
    return O.flag_outliers(test, train, "vec_id", "embedding").select(
        "vec_id", F.round("ood_distance", 6).alias("ood_distance"), "ood_flag")


def ood_lsh(spark, d):
    test, train = _sets(spark, d)
    return O.approximate_distances(test, train, "vec_id", "embedding", bucket=2.0).select(
        "vec_id", F.round("distance", 6).alias("ood_distance"))


QUERIES = {f.__name__: f for f in (ood_exact, ood_threshold, ood_flag, ood_lsh)}

_SETS = """
g as (select label, row_number() over (order by md5('42|' || label), label) as r from (select distinct label from embeddings)),
rows0 as (select e.vec_id, cast(e.embedding as double[]) as v, case when r <= ceil((select count(*) from g) * 0.2e0) then 1 else 0 end as is_test
  from embeddings e join g on g.label = e.label),
near as (select a.vec_id, min(list_distance(a.v, b.v)) as d from rows0 a join rows0 b on a.is_test = 1 and b.is_test = 0 group by 1),
selfd as (select a.vec_id, min(list_distance(a.v, b.v)) as d from rows0 a join rows0 b on a.is_test = 0 and b.is_test = 0 and a.vec_id <> b.vec_id group by 1),
lim as (select quantile_cont(d, 0.95) as t from selfd)"""

ORACLES = {
    "ood_exact": f"with {_SETS} select vec_id, round(d, 6) as ood_distance from near",
    "ood_threshold": f"with {_SETS} select round(t, 6) as threshold from lim",
    "ood_flag": f"with {_SETS} select vec_id, round(d, 6) as ood_distance, case when d > t then 1 else 0 end as ood_flag from near, lim",
}
