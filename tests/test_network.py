"""ML-04 and ML-05: gradients, plain training, early stopping, learning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import metrics as M
from helixframe.operators import models as ML
from helixframe.operators.network import Network, NetworkTrainer


def table(spark, n=800, d=6, seed=1, parts=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    y = (x[:, 0] - 2 * x[:, 1] + 0.3 * r.normal(size=n) > 0).astype(float)
    return spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(n)], "id int, features array<double>, label double").repartition(parts)


@pytest.mark.parametrize("loss", ["bce", "mse"])
@pytest.mark.parametrize("dropout", [0.0, 0.5])
def test_gradient(loss, dropout):
    r = np.random.default_rng(2)
    net = Network(4, [(5, "relu"), (6, "linear"), (3, "relu")], dropout, loss)
    theta, x, y = net.start(3) + r.normal(size=len(net.start(3))) * 0.1, r.normal(size=(9, 4)), r.integers(0, 2, 9).astype(float)
    keep = (r.random((9, 3)) > 0.5) / 0.5 if dropout else None

    def loss_of(t):
        z, _ = net.forward(t, x, keep)
        return np.mean(np.maximum(z, 0) - z * y + np.log1p(np.exp(-abs(z)))) if loss == "bce" else np.mean((z - y) ** 2)
    got = net.gradient(theta, x, y, keep)
    for k in range(len(theta)):
        step = np.zeros_like(theta)
        step[k] = 1e-6
        assert abs((loss_of(theta + step) - loss_of(theta - step)) / 2e-6 - got[k]) < 1e-6


def test_one_partition_is_plain_training(spark):
    df = table(spark, 100, 4, parts=1)
    net = Network(4, [(3, "relu")], 0.2)
    model = NetworkTrainer(net, 0.01, 3, batch=16, seed=5).fit(df)
    rows = df.collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows])
    theta = net.start(5)
    state = theta, np.zeros_like(theta), np.zeros_like(theta), 0
    for epoch in range(3):
        state = net.run(state, x, y, 16, 0.01, np.random.default_rng((5 + epoch, 0)))
    assert np.allclose(model.theta, state[0], atol=1e-12)


def test_tasks_are_averaged_by_rows(spark):
    df = table(spark, 300, 4, parts=4)
    net = Network(4, [(3, "relu")])
    model = NetworkTrainer(net, 0.01, 1, batch=16, seed=5, rows_per_task=1).fit(df)
    again = NetworkTrainer(net, 0.01, 1, batch=16, seed=5, rows_per_task=1).fit(df)
    assert (model.theta == again.theta).all()               # whatever the order tasks end in
    assert not np.allclose(model.theta, net.start(5))


def test_dense_network_learns_in_many_tasks(spark):
    df = table(spark, 1200, 6)
    for how in ({}, {"rows_per_task": 300}):
        model = ML.dense_network(6, **how).fit(df.where("id < 900"))
        assert len(model.network.layers) == 5 and [k for _, k in model.network.layers] == ["relu"] + ["linear"] * 4
        pred = model.transform(df.where("id >= 900"))
        assert M.ranking_metrics(pred, "score", "label").first()["auroc"] > 0.95


def test_head_keeps_the_best_epoch(spark):
    df = table(spark, 240, 6, seed=4)
    noisy = df.withColumn("label", F.when(F.col("id") % 4 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    model = ML.mlp_head(6, max_iter=60, learning_rate=0.05, validation=noisy.where("id >= 160")).fit(noisy.where("id < 160"))
    losses = [x for _, x in model.history]
    assert [e for e, _ in model.history] == list(range(2, 61, 2)) and losses[-1] > min(losses)
    got = NetworkTrainer(model.network, validation=None)._loss(
        NetworkTrainer(model.network)._rows(noisy.where("id >= 160")), model.theta, model.scale)
    assert abs(got - min(losses)) < 1e-12


def test_regression_head(spark):
    df = table(spark, 600, 4).withColumn("label", F.col("features")[0] * 2 + F.col("features")[1])
    pred = ML.mlp_head(4, loss="mse", learning_rate=0.01).fit(df.where("id < 450")).transform(df.where("id >= 450"))
    assert pred.select(F.corr("prediction", "label")).first()[0] > 0.95


def test_odd_tables(spark):
    df = table(spark, 20, 4)
    model = ML.dense_network(4).fit(df.limit(0))
    assert model.transform(df.limit(0)).count() == 0 and model.transform(df).where("score IS NULL").count() == 0
    nulls = df.union(spark.createDataFrame([(99, None, 1.0), (98, [1.0] * 4, None)], df.schema))
    got = {r["id"]: r["score"] for r in ML.dense_network(4, max_iter=4).fit(nulls).transform(nulls).collect()}
    assert got[99] is None and got[98] is not None
