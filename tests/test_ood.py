"""Distances against brute force, with a third of the training rows being copies of one vector."""

import numpy as np
import pandas as pd
import pytest

from runsift.operators import ball_tree as T
from runsift.operators import ood as O


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 4
    train = centres[rng.integers(0, 6, 600)] + rng.normal(size=(600, 8)) * 0.3
    train[:200] = train[0]
    test = np.vstack([centres[rng.integers(0, 6, 50)] + rng.normal(size=(50, 8)) * 0.3, rng.normal(size=(10, 8)) * 12, train[:5]])
    return train, test


def _frame(spark, matrix):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(matrix)), "v": list(matrix)}))


def _brute(a, b):
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def test_exact_with_small_blocks(spark, data, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_ROWS", 40)
    monkeypatch.setattr(T, "FAN", 4)
    monkeypatch.setattr(T, "PART_ROWS", 30)
    train, test = data
    got = O.test_distances(_frame(spark, test), _frame(spark, train), "id", "v").toPandas().sort_values("id")
    assert np.allclose(got["distance"], _brute(test, train).min(axis=1), atol=1e-9)


def test_threshold_and_flags(spark, data):
    train, test = data
    own = _brute(train, train)
    np.fill_diagonal(own, np.inf)
    limit = np.quantile(own.min(axis=1), 0.95)
    frame = _frame(spark, train)
    got = O.distance_threshold(O.train_distances(frame, "id", "v")).first()["threshold"]
    assert np.isclose(got, limit)
    flags = O.flag_outliers(_frame(spark, test), frame, "id", "v").toPandas().sort_values("id")
    assert (flags["ood_flag"].to_numpy() == (_brute(test, train).min(axis=1) > limit)).all()


def test_single_training_row_gives_zero(spark, data):
    train, test = data
    out = O.flag_outliers(_frame(spark, test), _frame(spark, train[:1]), "id", "v").toPandas()
    assert (out["ood_distance"] == 0).all() and (out["ood_flag"] == 0).all()


def test_all_training_rows_equal(spark, data):
    train, _ = data
    assert O.distance_threshold(O.train_distances(_frame(spark, train[:50]), "id", "v")).first()["threshold"] == 0.0


def test_approximate_is_an_upper_bound_with_good_recall(spark, data):
    train, test = data
    got = O.approximate_distances(_frame(spark, test), _frame(spark, train), "id", "v", bucket=3.0).toPandas().sort_values("id")
    exact = _brute(test, train).min(axis=1)
    found = got["distance"].notna().to_numpy()
    assert (got["distance"].to_numpy()[found] >= exact[found] - 1e-9).all()
    assert np.mean(np.isclose(got["distance"].fillna(np.inf), exact)[:50]) > 0.8


def test_tree_looks_at_few_rows(spark, monkeypatch):
    """Four times the references must not mean four times the comparisons."""
    monkeypatch.setattr(T, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(4)
    seen = {}
    for n in (1500, 6000):
        refs, asked = rng.normal(size=(n, 3)), rng.normal(size=(40, 3))
        tree = T.build_tree(_frame(spark, refs).selectExpr("id as ref_id", "v as vec"))
        assert tree.leaves.count() == n and len(tree.levels) > 1
        assert tree.leaves.groupBy("cell").count().agg({"count": "max"}).first()[0] <= 64
        got = T.search(_frame(spark, asked).selectExpr("id as query_id", "v as vec"), tree).toPandas().sort_values("query_id")
        assert np.allclose(got["distance"], _brute(asked, refs).min(axis=1), atol=1e-9)
        seen[n] = got["compared"].mean()
    assert seen[1500] < 300 and seen[6000] < 3 * seen[1500]


def test_no_references(spark, data):
    _, test = data
    none = _frame(spark, test).selectExpr("id as ref_id", "v as vec").limit(0)
    got = T.search(_frame(spark, test).selectExpr("id as query_id", "v as vec"), T.build_tree(none)).toPandas()
    assert len(got) == len(test) and got["distance"].isna().all()


def test_open_leaves_do_not_copy_vectors(spark, monkeypatch):
    """In high dimensions nearly every leaf stays open; no stored table may hold a vector per query and leaf."""
    monkeypatch.setattr(T, "BLOCK_ROWS", 20)
    monkeypatch.setattr(T, "BAND_BYTES", 100 * 24 * 8)
    rng = np.random.default_rng(5)
    refs, asked = rng.normal(size=(600, 24)), rng.normal(size=(150, 24))
    tree = T.build_tree(_frame(spark, refs).selectExpr("id as ref_id", "v as vec"))
    stored, keep = [], T.materialize

    def counted(df):
        out = keep(df)
        stored.append(out.count() if "vec" in df.columns else 0)
        return out

    monkeypatch.setattr(T, "materialize", counted)
    got = T.search(_frame(spark, asked).selectExpr("id as query_id", "v as vec"), tree).toPandas().sort_values("query_id")
    assert np.allclose(got["distance"], _brute(asked, refs).min(axis=1), atol=1e-9)
    assert tree.leaves.select("cell").distinct().count() > 20 and max(stored) <= 150
    own = T.search(_frame(spark, refs).selectExpr("id as query_id", "v as vec"), tree, skip_same=True).toPandas().sort_values("query_id")
    away = _brute(refs, refs)
    np.fill_diagonal(away, np.inf)
    assert np.allclose(own["distance"], away.min(axis=1), atol=1e-9)


def test_codes_stand_for_their_one_hot_vectors(spark, monkeypatch):
    """Distances of numbers with category codes equal those of the long vectors, for unseen values, copies and many values."""
    rng = np.random.default_rng(6)
    values = 300

    def rows(n, seen):
        codes = np.stack([rng.integers(0, values, n), rng.integers(0, 3, n)], axis=1).astype(float)
        codes[rng.random(n) < seen, 0] = -1.0
        return np.hstack([rng.integers(0, 3, (n, 2)), codes])

    def long(short):
        out = np.zeros((len(short), 2 + values + 3))
        out[:, :2] = short[:, :2]
        for row, (a, b) in enumerate(short[:, 2:].astype(int)):
            out[row, 2 + b + values] = 1.0
            if a >= 0:
                out[row, 2 + a] = 1.0
        return out

    train, test = rows(700, 0.1), rows(90, 0.5)
    own = _brute(long(train), long(train))
    np.fill_diagonal(own, np.inf)
    near = _brute(long(test), long(train)).min(axis=1)
    for block in (2048, 40):
        monkeypatch.setattr(T, "BLOCK_ROWS", block)
        monkeypatch.setattr(T, "BAND_BYTES", 50 * block)
        got = O.flag_outliers(_frame(spark, test), _frame(spark, train), "id", "v", 2).toPandas().sort_values("id")
        assert np.allclose(got["ood_distance"], near, atol=1e-9)
        limit = np.quantile(own.min(axis=1), 0.95)
        assert (got["ood_flag"].to_numpy() == (near > limit)).all()
