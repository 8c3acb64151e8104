"""Every registered query against its SQL twin on the driver tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{data_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, data_dir, name):
    frame = QUERIES[name](spark, data_dir)
    columns = sorted(frame.columns)
    got = _sorted(tuple(_plain(r[c]) for c in columns) for r in frame.collect())
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = _sorted(tuple(_plain(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["model_lr", "model_rf", "model_top_features", "ood_lsh"])
def test_fitted_queries_run(spark, data_dir, name):
    assert QUERIES[name](spark, data_dir).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
