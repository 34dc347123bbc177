"""Dense networks trained data-parallel (ML-04, ML-05).

Each round is one Spark job: every task starts from the shared weights, runs
minibatch Adam over the rows of its partition, a bounded chunk at a time, and
returns its weights and moments; a tree of sums brings them to the driver,
weighted by rows.  A task that is lost is run again from the same weights with
the same random numbers, and gives the same.  With one partition this is
ordinary minibatch training.

With a validation table its loss is taken after every round, and the weights
of the best epoch (the earlier one of equals, AGG-03) are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from helixframe.operators.metrics import best_epoch
from helixframe.session import Shared, reliable_checkpoint

CHUNK_ROWS = 65_536
_B1, _B2, _EPS = 0.9, 0.999, 1e-7                       # Adam's usual constants


@dataclass
class Network:
    """Layers of (units, "relu" or "linear") and one output, with ``dropout`` before the output.  ``loss``
    is "bce" (the output is a probability) or "mse"."""
    n_inputs: int
    layers: Sequence[tuple[int, str]]
    dropout: float = 0.0
    loss: str = "bce"

    def shapes(self) -> list[tuple[int, int]]:
        sizes = [self.n_inputs, *[n for n, _ in self.layers], 1]
        return list(zip(sizes, sizes[1:], strict=False))

    def start(self, seed: int):
        """Weights by Glorot's uniform rule, biases 0, as one vector."""
        import numpy as np
        r, out = np.random.default_rng(seed), []
        for a, b in self.shapes():
            bound = math.sqrt(6.0 / (a + b))
            out += [r.uniform(-bound, bound, a * b), np.zeros(b)]
        return np.concatenate(out)

    def parts(self, theta) -> list[tuple]:
        out, at = [], 0
        for a, b in self.shapes():
            out.append((theta[at:at + a * b].reshape(a, b), theta[at + a * b:at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, theta, x, keep=None):
        """(output before its activation, what the layers passed on); ``keep`` is a dropout mask."""
        import numpy as np
        passed = [x]
        for (w, b), (_, kind) in zip(self.parts(theta), self.layers, strict=False):
            x = x @ w + b
            passed.append(np.maximum(x, 0) if kind == "relu" else x)
            x = passed[-1]
        if keep is not None:
            x = passed[-1] = x * keep
        w, b = self.parts(theta)[-1]
        return (x @ w + b)[:, 0], passed

    def losses(self, theta, x, y):
        """The loss of each row."""
        import numpy as np
        z, _ = self.forward(theta, x)
        return np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z))) if self.loss == "bce" else (z - y) ** 2

    def predict(self, theta, x):
        import numpy as np
        z, _ = self.forward(theta, x)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) if self.loss == "bce" else z

    def gradient(self, theta, x, y, keep=None):
        """The gradient of the mean loss of a batch."""
        import numpy as np
        z, passed = self.forward(theta, x, keep)
        d = (1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) - y if self.loss == "bce" else 2 * (z - y))[:, None] / len(y)
        out, parts = [], self.parts(theta)
        for k in range(len(parts) - 1, -1, -1):
            out[:0] = [(passed[k].T @ d).ravel(), d.sum(axis=0)]
            if k:
                d = d @ parts[k][0].T
                if keep is not None and k == len(parts) - 1:
                    d = d * keep
                if self.layers[k - 1][1] == "relu":
                    d = d * (passed[k] > 0)
        return np.concatenate(out)

    def run(self, state, x, y, batch: int, rate: float, random):
        """One epoch of minibatch Adam over rows in random order; ``state`` is (theta, m, v, steps)."""
        import numpy as np
        theta, m, v, steps = state
        order = random.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at:at + batch]
            keep = None
            if self.dropout:
                keep = (random.random((len(rows), self.shapes()[-1][0])) >= self.dropout) / (1 - self.dropout)
            g = self.gradient(theta, x[rows], y[rows], keep)
            steps += 1
            m, v = _B1 * m + (1 - _B1) * g, _B2 * v + (1 - _B2) * g * g
            theta = theta - rate * (m / (1 - _B1 ** steps)) / (np.sqrt(v / (1 - _B2 ** steps)) + _EPS)
        return theta, m, v, steps


class NetworkTrainer:
    """``fit(df)`` on columns ``features`` (array or vector) and ``label``.

    ``epochs_per_round`` passes are made over a chunk of rows before the
    tasks' weights are averaged; a partition has ``rows_per_task`` rows at
    least, so that few rows are not spread over many tasks."""

    def __init__(self, network: Network, learning_rate: float = 1e-4, epochs: int = 10, batch: int = 64, seed: int = 1234,
                 validation: DataFrame | None = None, epochs_per_round: int = 1, rows_per_task: int = 4096,
                 standardize: bool = False, features: str = "features", label: str = "label"):
        self.network, self.rate, self.epochs, self.batch, self.seed = network, learning_rate, epochs, batch, seed
        self.validation, self.per_round, self.rows_per_task = validation, epochs_per_round, rows_per_task
        self.standardize, self.features, self.label = standardize, features, label

    def _rows(self, df: DataFrame) -> DataFrame:
        x = F.col(self.features).cast("array<double>") if isinstance(df.schema[self.features].dataType, ArrayType) else \
            vector_to_array(self.features)
        return df.select(x.alias("x"), F.col(self.label).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")

    def fit(self, df: DataFrame) -> NetworkModel:
        import numpy as np
        net, spark = self.network, df.sparkSession
        data = reliable_checkpoint(self._rows(df))
        n = data.count()
        tasks = max(1, min(data.rdd.getNumPartitions(), -(-n // self.rows_per_task)))
        if tasks < data.rdd.getNumPartitions():
            data = reliable_checkpoint(data.coalesce(tasks))
        valid = reliable_checkpoint(self._rows(self.validation)) if self.validation is not None else None
        theta = net.start(self.seed)
        scale = _scale(data, net.n_inputs) if self.standardize and n else (np.zeros(net.n_inputs), np.ones(net.n_inputs))
        state, kept, history = (theta, np.zeros_like(theta), np.zeros_like(theta), 0), [], []
        for epoch in range(0, self.epochs if n else 0, self.per_round):
            shared = spark.sparkContext.broadcast((state, scale))
            parts = data.mapInArrow(_trained(net, shared, self.batch, self.rate, self.seed + epoch, self.per_round), _STATE)
            sums = sorted(parts.repartition(max(1, math.isqrt(tasks)), "task").mapInArrow(_added, _STATE).collect(), key=lambda r: r["task"])
            rows = sum(r["n"] for r in sums)
            total = sum(np.frombuffer(r["state"]) for r in sums) / rows
            state = (*np.split(total, 3), max(r["steps"] for r in sums))
            if valid is not None:
                history.append((epoch + self.per_round, self._loss(valid, state[0], scale)))
                kept.append(state[0])
        theta = state[0]
        scores = spark.createDataFrame([("net", e, -x) for e, x in history], "model string, epoch int, score double")
        if history:
            best = best_epoch(scores).first()["best_epoch"]
            theta = kept[[e for e, _ in history].index(best)]
        return NetworkModel(net, theta, scale, self.features, history)

    def _loss(self, valid: DataFrame, theta, scale) -> float:
        net, shared = self.network, valid.sparkSession.sparkContext.broadcast((theta, scale))

        def run(batches) -> Iterator:
            import pyarrow as pa
            theta, scale = shared.value
            for b in batches:
                x, y = _matrix(b, scale)
                yield pa.RecordBatch.from_pydict({"loss": [float(net.losses(theta, x, y).sum())], "n": [len(y)]})
        r = valid.mapInArrow(run, "loss double, n long").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).first()
        return r["loss"] / r["n"] if r["n"] else 0.0


_STATE = "task int, n long, steps long, state binary"


def _matrix(batch, scale):
    import numpy as np
    x = np.array(batch.column(0).to_pylist(), "f8").reshape(batch.num_rows, -1)
    return (x - scale[0]) / scale[1], np.asarray(batch.column(1).to_numpy(), "f8")


def _scale(data: DataFrame, n: int):
    """Mean and standard deviation of each input (1 where it does not vary)."""
    import numpy as np
    got = data.agg(*[f(F.col("x")[k]).alias(f"{name}{k}") for name, f in (("m", F.avg), ("s", F.stddev_pop)) for k in range(n)]).first()
    mean, std = np.array([got[f"m{k}"] for k in range(n)], "f8"), np.array([got[f"s{k}"] for k in range(n)], "f8")
    return mean, np.where(std > 0, std, 1.0)


def _trained(net: Network, shared, batch: int, rate: float, seed: int, epochs: int):
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        state, scale = shared.value
        task, n, held, rows = TaskContext.get().partitionId(), 0, [], 0
        random = np.random.default_rng((seed, task))

        def chunk(state):
            x, y = (np.concatenate(c) for c in zip(*held, strict=True))
            for _ in range(epochs):
                state = net.run(state, x, y, batch, rate, random)
            return state
        for b in batches:
            if b.num_rows:
                held.append(_matrix(b, scale))
                n, rows = n + b.num_rows, rows + b.num_rows
            if rows >= CHUNK_ROWS:
                state, held, rows = chunk(state), [], 0
        if held:
            state = chunk(state)
        if n:
            theta, m, v, steps = state
            yield pa.RecordBatch.from_pydict({"task": pa.array([task], "i4"), "n": [n], "steps": [steps],
                                              "state": [(np.concatenate([theta, m, v]) * n).tobytes()]})
    return run


def _added(batches) -> Iterator:
    """One row for the tasks that a partition holds, added in their order."""
    import numpy as np
    import pyarrow as pa
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["task"])
    if rows:
        yield pa.RecordBatch.from_pydict({
            "task": pa.array([rows[0]["task"]], "i4"), "n": [sum(r["n"] for r in rows)], "steps": [max(r["steps"] for r in rows)],
            "state": [sum(np.frombuffer(r["state"]) for r in rows).tobytes()]})


@dataclass
class NetworkModel:
    network: Network
    theta: object
    scale: tuple
    features: str
    history: list[tuple[int, float]]                    # (epoch, validation loss)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``score`` (probability of label 1, or the value) and
        ``prediction``; null where there are no features."""
        shared = Shared(df.sparkSession, (self.network, self.theta, self.scale))

        def score(s: pd.Series) -> pd.Series:
            import numpy as np
            net, theta, scale = shared.value
            known = s.notna().to_numpy()
            out = np.full(len(s), np.nan)
            if known.any():
                x = np.stack([np.asarray(v, "f8") for v in s[known]])
                out[known] = net.predict(theta, (x - scale[0]) / scale[1])
            return pd.Series(out).astype("object").where(pd.Series(known), None)
        x = F.col(self.features).cast("array<double>") if isinstance(df.schema[self.features].dataType, ArrayType) else \
            vector_to_array(self.features)
        out = df.withColumn("score", F.pandas_udf(score, "double")(x))
        return out.withColumn("prediction", (F.col("score") >= 0.5).cast("double") if self.network.loss == "bce" else F.col("score"))
