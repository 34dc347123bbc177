"""ML-03 against a plain booster that looks at every row for every split."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import metrics as M
from helixframe.operators.boosting import UNIT, BoostedTrees, Rule, Tree, binned


def data(spark, n=400, d=5, seed=1, parts=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    x[:, 1] = r.integers(0, 4, n)                       # few values, many ties
    x[r.random((n, d)) < 0.05] = np.nan
    y = ((np.nan_to_num(x[:, 0]) * np.nan_to_num(x[:, 2]) + np.nan_to_num(x[:, 1]) - 1.5 + r.normal(size=n) * 0.3) > 0).astype(int)
    df = spark.createDataFrame([(int(i), [None if math.isnan(v) else float(v) for v in x[i]], int(y[i])) for i in range(n)],
                               "id int, features array<double>, label int").repartition(parts)
    return df, x, y


def plain_margins(edges, x, y, trees, rate, depth, lam, gamma, least):
    """Row by row: for each node every feature and cut is tried."""
    bins = binned(x, edges)
    margin = [0.0] * len(y)
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [round((a - b) * UNIT) / UNIT for a, b in zip(p, y, strict=True)]
        h = [round(a * (1 - a) * UNIT) / UNIT for a in p]

        def grow(rows, level):
            gt, ht = sum(g[i] for i in rows), sum(h[i] for i in rows)
            best = None
            if level < depth:
                for f in range(bins.shape[1]):
                    for cut in sorted({bins[i, f] for i in rows}):
                        left = [i for i in rows if bins[i, f] <= cut]
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        gr, hr = gt - gl, ht - hl
                        if hl < least or hr < least:
                            continue
                        gain = (gl * gl / (hl + lam) + gr * gr / (hr + lam) - gt * gt / (ht + lam)) / 2 - gamma
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                            best = gain, f, cut
            if best is None:
                for i in rows:
                    margin[i] += -gt / (ht + lam) * rate
                return
            _, f, cut = best
            grow([i for i in rows if bins[i, f] <= cut], level + 1)
            grow([i for i in rows if bins[i, f] > cut], level + 1)
        grow(range(len(y)), 0)
    return margin


@pytest.mark.parametrize("local_rows", [100_000, 60, 0])      # one task a tree; levels, then subtrees; levels only
@pytest.mark.parametrize(("depth", "gamma"), [(3, 0.0), (8, 0.2)])
def test_scores_equal_a_plain_booster(spark, local_rows, depth, gamma):
    df, x, y = data(spark, 160, 4)
    made = BoostedTrees(5, 0.3, depth, gamma=gamma, max_bins=16, local_rows=local_rows, write_every=2).fit(df)
    want = plain_margins(made.edges, x, y, 5, 0.3, depth, 1.0, gamma, 1.0)
    assert np.allclose(made.margins(x), want, atol=1e-9)
    got = {r["id"]: (r["score"], r["prediction"]) for r in made.transform(df).collect()}
    for i, m in enumerate(want):
        assert abs(got[i][0] - 1 / (1 + math.exp(-m))) < 1e-9 and got[i][1] == float(got[i][0] >= 0.5)


def test_partitions_and_ways_give_the_same_trees(spark):
    df, x, _ = data(spark, 500, 6, seed=2, parts=1)
    models = [BoostedTrees(6, 0.1, 25, max_bins=64, local_rows=n).fit(df.repartition(p)) for n, p in ((10**6, 1), (50, 4), (120, 7))]
    assert models[0].edges == models[1].edges == models[2].edges
    assert (models[0].margins(x) == models[1].margins(x)).all() and (models[0].margins(x) == models[2].margins(x)).all()


def test_a_hundred_trees_learn(spark):
    df, _, _ = data(spark, 900, 5, seed=3)
    model = BoostedTrees(100, 0.1, 25).fit(df.where("id < 600"))
    assert len(model.trees) == 100
    pred = model.transform(df.where("id >= 600"))
    assert M.ranking_metrics(pred, "score", "label").first()["auroc"] > 0.95


def test_edges_are_quantiles_and_missing_goes_left(spark):
    df, x, _ = data(spark, 300, 3)
    model = BoostedTrees(1, max_bins=8).fit(df)
    assert model.edges[1] == [0.0, 1.0, 2.0, 3.0] and all(len(e) <= 6 for e in model.edges)
    bins = binned(x, model.edges)
    assert ((bins == 0) == np.isnan(x)).all() and bins.max() <= 7


def test_odd_tables(spark):
    df, _, _ = data(spark, 40, 3)
    empty = BoostedTrees(3).fit(df.limit(0))
    assert {r["score"] for r in empty.transform(df).collect()} == {0.5}
    one = BoostedTrees(3).fit(df.withColumn("label", F.lit(1)))             # one class: higher and higher, no split
    assert all(r["score"] > 0.5 for r in one.transform(df).collect()) and all(len(t.feature) == 1 for t in one.trees)
    nulls = df.union(spark.createDataFrame([(99, None, 1), (98, [1.0, 2.0, None], None)], df.schema))
    model = BoostedTrees(3).fit(nulls)
    assert model.transform(nulls).where("score is null").count() == 0
    same = BoostedTrees(3).fit(df.withColumn("features", F.array(F.lit(1.0), F.lit(2.0))))
    assert all(len(t.feature) == 1 for t in same.trees)


def test_graft_and_walk():
    tree, sub = Tree(), Tree()
    root = tree.leaf(0.0)
    a, b = tree.leaf(1.0), tree.leaf(2.0)
    tree.split(root, 0, 3, a, b)
    top = sub.leaf(0.0)
    sub.split(top, 1, 0, sub.leaf(5.0), sub.leaf(6.0))
    tree.graft(b, sub)
    margin = np.zeros(3)
    tree.add_to(margin, np.array([[1, 0], [4, 0], [4, 1]], "u1"))
    assert margin.tolist() == [1.0, 5.0, 6.0]
    assert Rule(1.0, 0.0, 1.0, 0.1, 3).best(np.zeros((2, 4)), np.zeros((2, 4))) is None
