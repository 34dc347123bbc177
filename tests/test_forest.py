"""ML-02: trees grown in tasks against brute force, and what a forest must hold."""

import numpy as np
import pytest

from helixframe.operators import forest as FO
from helixframe.operators import models as ML


def table(spark, x, y, parts=3):
    rows = [(i, v.tolist(), None if t is None else float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id int, features array<double>, y double").repartition(parts)


def brute(x, y, w, depth):
    """A tree's values for its own rows by trying every cut of every feature."""
    mean = (w * y).sum() / w.sum()
    best = None
    for f in range(x.shape[1]) if depth and len(set(y.tolist())) > 1 else ():
        for cut in sorted(set(x[:, f].tolist()))[:-1]:
            left = x[:, f] <= cut
            error = sum((w[s] * (y[s] - (w[s] * y[s]).sum() / w[s].sum()) ** 2).sum() for s in (left, ~left))
            if best is None or error < best[0] - 1e-9:
                best = error, left
    if best is None or best[0] >= (w * (y - mean) ** 2).sum() - 1e-9:
        return np.full(len(y), mean)
    out = np.empty(len(y))
    for s in (best[1], ~best[1]):
        out[s] = brute(x[s], y[s], w[s], depth - 1)
    return out


@pytest.mark.parametrize("depth", [1, 3, 25])
def test_a_tree_against_brute_force(depth):
    r = np.random.default_rng(depth)
    x, w = r.integers(0, 9, (200, 3)), r.integers(1, 4, 200).astype("f8")
    y = x[:, 0] * 3.0 + (x[:, 1] > 4) + r.normal(size=200)
    tree = FO.grow(x.astype("u1"), y, w, depth, 3, 16, r)
    got, want = FO.leaves(tree, x.astype("u1")), brute(x, y, w, depth)
    # equal gains may go either way, so the errors are compared
    assert abs((w * (got - y) ** 2).sum() - (w * (want - y) ** 2).sum()) < (1e-6 if depth < 3 else 0.02 * (w * (want - y) ** 2).sum())
    assert len(tree["cut"]) == 2 * (tree["feature"] < 0).sum() - 1


def test_equal_labels_are_one_leaf_and_equal_rows_their_mean():
    r = np.random.default_rng(0)
    x = r.integers(0, 30, (50, 4)).astype("u1")
    assert FO.grow(x, np.full(50, 0.1), np.full(50, 3.0), 25, 2, 32, r)["value"].tolist() == [0.1]
    assert FO.grow(x[:1].repeat(4, axis=0), np.array([1.0, 2, 3, 4]), np.ones(4), 25, 4, 32, r)["value"].tolist() == [2.5]


@pytest.mark.parametrize("local_rows", [1 << 30, 100, 20])
def test_nodes_split_by_histograms_or_in_a_task_learn_alike(spark, local_rows):
    r = np.random.default_rng(5)
    x = r.normal(size=(900, 6))
    y = 2 * x[:, 0] + x[:, 1]
    train, test = table(spark, x[:600], y[:600]), table(spark, x[600:], y[600:])
    model = FO.RandomForestRegressor(numTrees=12, seed=3, labelCol="y", local_rows=local_rows).fit(train)
    got = {r["id"]: r["prediction"] for r in model.transform(test).collect()}
    assert sorted(got) == list(range(300)) and np.corrcoef([got[i] for i in range(300)], y[600:])[0, 1] > 0.93
    assert model.totalNumNodes > 12 * 300
    assert (max(len(t.feature) for t in model.upper) > 1) == (local_rows < 600)
    again = FO.RandomForestRegressor(numTrees=12, seed=3, labelCol="y", local_rows=local_rows).fit(train)
    assert again.totalNumNodes == model.totalNumNodes


def test_one_tree_with_every_feature_is_the_same_by_histograms(spark):
    """Nodes above ``local_rows`` are split as a task would split them."""
    r = np.random.default_rng(6)
    x = r.integers(0, 12, (400, 3)).astype("f8")
    y = x[:, 0] + 0.1 * x[:, 1] ** 2 + r.normal(size=400)
    d = table(spark, x, y, parts=1)
    got = []
    for local_rows in (1 << 30, 60):
        model = FO.RandomForestRegressor(numTrees=1, seed=9, labelCol="y", featureSubsetStrategy="all", maxDepth=4, local_rows=local_rows).fit(d)
        got.append([r["prediction"] for r in model.transform(d).orderBy("id").collect()])
    assert np.allclose(got[0], got[1])


def test_bins(spark):
    x = np.array([[i % 3, i, 7.0] for i in range(100)], "f8")
    edges = FO.bin_edges(table(spark, x, np.zeros(100)).selectExpr("features AS x"), 3, 10)
    assert edges[0] == [0.5, 1.5] and edges[2] == [] and len(edges[1]) == 9


def test_odd_tables(spark):
    one = table(spark, np.ones((1, 2)), [5.0])
    fit = lambda d: FO.RandomForestRegressor(numTrees=8, seed=1, labelCol="y", maxDepth=3).fit(d)
    assert [r["prediction"] for r in fit(one).transform(one).collect()] == [5.0]         # also of trees that drew no row
    assert fit(one).transform(one.limit(0)).count() == 0
    for bad in (table(spark, np.ones((3, 2)), [1.0, None, 2.0]), table(spark, np.full((1, 2), np.nan), [1.0]), one.limit(0)):
        with pytest.raises(ValueError, match="labels and features are numbers"):
            fit(bad)


def test_all_trees_for_numbers_are_one_part(spark, monkeypatch):
    """The driver holds none of their nodes, so many rows do not mean few trees at a time."""
    made = []
    real = ML.RandomForestRegressor
    monkeypatch.setattr(ML, "RandomForestRegressor", lambda numTrees, **how: made.append(numTrees) or real(numTrees=numTrees, **how))
    monkeypatch.setattr(ML, "NODES_HELD", 10)
    r = np.random.default_rng(7)
    d = table(spark, r.normal(size=(60, 3)), r.normal(size=60))
    pred = ML.fit_predict(d, d, ML.random_forest(20, 5, regression=True, label="y"), ["id", "y"])
    assert pred.count() == 60 and made == [20]
