"""Spark ML baselines (ML-01..06).

Spark ML trees accept depth at most 30, so the reference's unlimited depth
maps to 30.  Features are fixed-length arrays turned into ML vectors at the
model boundary only.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from helixframe.operators.boosting import BoostedTrees
from helixframe.operators.forest import RandomForestRegressor
from helixframe.operators.network import Network, NetworkTrainer
from helixframe.session import Shared, bounded_batches, ensure_checkpoint_dir, reliable_checkpoint

MAX_TREE_DEPTH = 30


def features(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.transform(array_col, lambda x: x.cast("double"))))


#: nodes of grown trees that the driver holds at a time
NODES_HELD = 1_000_000


class Forest:
    """A random forest fitted and applied a few trees at a time.

    Spark ML keeps a forest whole on the driver, and deep trees have up to two
    nodes a row; so the trees are fitted in parts of about ``nodes_held`` nodes,
    each part scores the rows to predict, and only their sums of
    probabilities (or values) are kept.  A forest that fits is one part.  Trees
    for numbers (``forest.py``) are not held on the driver: all are one part,
    unless ``nodes_held`` is given."""

    def __init__(self, cls, num_trees: int, seed: int, nodes_held: int = NODES_HELD, **how):
        self.cls, self.num_trees, self.seed, self.nodes_held, self.how = cls, num_trees, seed, nodes_held, how

    def predicted(self, train: DataFrame, test: DataFrame) -> DataFrame:
        """``test`` with ``prediction`` and, for classes, ``probability`` (an array)."""
        label = self.how["labelCol"]
        train = reliable_checkpoint(train.select(label, "features"))
        test = reliable_checkpoint(test.withColumn("__row", F.monotonically_increasing_id()))
        kind = "prediction" if self.cls is RandomForestRegressor else "probability"
        width, done, sums = 2 * max(1, train.count()), 0, None
        while done < self.num_trees:
            size = max(1, min(self.num_trees - done, self.nodes_held // width))
            model = self.cls(numTrees=size, seed=self.seed + done, **self.how).fit(train)
            value = F.array("prediction") if kind == "prediction" else vector_to_array("probability")
            part = reliable_checkpoint(model.transform(test).select("__row", F.transform(value, lambda x: x * size).alias("__v")))
            sums = part if sums is None else sums.unionByName(part)
            done += size
            if done < self.num_trees:
                width = max(1, model.totalNumNodes // size)         # from now on by the trees as they are
        n = len((sums.first() or {"__v": [0.0]})["__v"])
        mean = sums.groupBy("__row").agg(F.array(*[F.sum(F.col("__v")[k]) / self.num_trees for k in range(n)]).alias(kind))
        if kind == "prediction":
            return test.join(mean.select("__row", F.col(kind)[0].alias(kind)), "__row").drop("__row")
        best = F.array_position(kind, F.array_max(kind)) - 1
        return test.join(mean, "__row").withColumn("prediction", best.cast("double")).drop("__row")


def random_forest(num_trees: int = 100, max_depth: int | None = 25, seed: int = 1234,
                  regression: bool = False, label: str = "label", nodes_held: int | None = None) -> Forest:
    depth = MAX_TREE_DEPTH if max_depth is None else min(max_depth, MAX_TREE_DEPTH)
    # what "auto" is for several trees: a part of one tree draws its features like the others
    subset = "all" if num_trees == 1 else "onethird" if regression else "sqrt"
    how = {"maxDepth": depth, "labelCol": label, "featuresCol": "features", "featureSubsetStrategy": subset}
    if regression:
        return Forest(RandomForestRegressor, num_trees, seed, nodes_held or sys.maxsize, **how)
    # deep trees: keep each row's node id cached instead of re-walking the
    # trees every level; checkpoint that cache to cut its lineage
    return Forest(RandomForestClassifier, num_trees, seed, nodes_held or NODES_HELD, **how, maxMemoryInMB=512, cacheNodeIds=True, checkpointInterval=10)


def boosted_trees(step_size: float = 0.1, max_depth: int = 25, max_iter: int = 100, label: str = "label", **how) -> BoostedTrees:
    """Second-order boosted trees (ML-03): the reference's rate, depth and the
    100 trees it leaves to the library's default."""
    return BoostedTrees(max_iter, step_size, max_depth, label=label, **how)


#: how the reference trains its dense network
DENSE_AS_REFERENCE = {"learning_rate": 1e-4, "max_iter": 10, "batch": 64}


def dense_network(n_inputs: int, hidden: Sequence[int] = (32, 64, 128, 64, 32), seed: int = 1234,
                  max_iter: int = 40, label: str = "label", learning_rate: float = 3e-3, batch: int = 32,
                  dropout: float = 0.1, **how) -> NetworkTrainer:
    """The 32-64-128-64-32 network (ML-04): the first layer rectified, the
    others linear, dropout, one sigmoid output.  ``DENSE_AS_REFERENCE`` has the
    reference's settings, which are for hundreds of thousands of rows."""
    layers = [(n, "linear" if k else "relu") for k, n in enumerate(hidden)]
    how = {"epochs_per_round": 4, "standardize": True} | how
    return NetworkTrainer(Network(n_inputs, layers, dropout), learning_rate, max_iter, batch, seed, label=label, **how)


def mlp_head(n_inputs: int, label: str = "label", loss: str = "bce", max_iter: int = 40, learning_rate: float = 3e-3,
             batch: int = 32, seed: int = 1234, validation: DataFrame | None = None, **how) -> NetworkTrainer:
    """The two-layer head on frozen embeddings (ML-05): a rectified layer as
    wide as the input and one output.  With ``validation`` the epoch of least
    validation loss is kept."""
    how = {"epochs_per_round": 2, "standardize": True} | how
    return NetworkTrainer(Network(n_inputs, [(n_inputs, "relu")], 0.0, loss), learning_rate, max_iter, batch, seed,
                          validation, label=label, **how)


def linear_head(label: str = "label", max_iter: int = 100):
    """Classifier head on frozen embeddings."""
    return LogisticRegression(maxIter=max_iter, labelCol=label, featuresCol="features")


def positive_probability(pred: DataFrame) -> DataFrame:
    """Probability of class 1 from a fitted classifier's output."""
    each = "probability" if isinstance(pred.schema["probability"].dataType, ArrayType) else vector_to_array("probability")
    return pred.withColumn("score", (F.col(each) if isinstance(each, str) else each)[1])


def _count_chars(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each text's code points, ascending, and how often they occur."""
    import numpy as np
    for texts in batches:
        got = [np.unique(np.frombuffer((t.as_py() or "").encode("utf-32-le"), "<i4"), return_counts=True) for t in texts]
        ends = pa.array(np.concatenate([[0], np.cumsum([len(c) for c, _ in got])]).astype("i4"))
        flat = [np.concatenate([np.zeros(0, "i4"), *[g[k] for g in got]]).astype("i4") for k in (0, 1)]
        yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x)) for x in flat], ["code", "n"])


class CharCounts:
    """Characters of the whole text, counted over the vocabulary of the rows it
    is fitted on, scaled to unit L2 norm, then ``model``: fitted as one, so a
    fold's test rows never shape its vocabulary (``fit_scope="each"``).  Texts
    are read once (``prepared``): vocabularies and vectors come from each
    text's own counts."""

    def __init__(self, model, text: str = "text"):
        self.model, self.text = model, text

    def prepared(self, data: DataFrame) -> DataFrame:
        if "__chars" in data.columns:
            return data
        bounded_batches(data.sparkSession)
        return data.withColumn("__chars", F.arrow_udf(_count_chars, "struct<code:array<int>,n:array<int>>")(F.lower(F.col(self.text))))

    def vectors(self, train: DataFrame, test: DataFrame) -> list[DataFrame]:
        """Both with ``features`` over the characters of ``train``, most frequent first."""
        each = train.select(F.explode(F.arrays_zip("__chars.code", "__chars.n")).alias("c"))
        counts = each.groupBy("c.code").agg(F.sum("c.n").alias("n")).orderBy(F.col("n").desc(), "code").collect()
        place = Shared(train.sparkSession, {r["code"]: k for k, r in enumerate(counts)})
        width = len(counts)

        def vector(code, n):
            at = place.value
            return SparseVector(width, {at[c]: float(x) for c, x in zip(code, n, strict=True) if c in at})

        counted = F.udf(vector, VectorUDT(), useArrow=False)("__chars.code", "__chars.n")
        scale = Normalizer(p=2.0, inputCol="__counts", outputCol="features")
        return [scale.transform(d.withColumn("__counts", counted)).drop("__counts", "__chars") for d in (train, test)]


def char_counts_then(model, text: str = "text") -> CharCounts:
    return CharCounts(model, text)


def fit_predict(train: DataFrame, test: DataFrame, model, keep_cols: Sequence[str]) -> DataFrame:
    """``keep_cols, prediction, score`` of the test rows, written once to the
    checkpoint folder: metrics read them several times, trees score once."""
    ensure_checkpoint_dir(train.sparkSession)  # deep forests checkpoint their node-id cache
    if isinstance(model, CharCounts):
        train, test = model.vectors(model.prepared(train), model.prepared(test))
        model = model.model
    pred = model.predicted(train, test) if isinstance(model, Forest) else model.fit(train).transform(test)
    if "score" not in pred.columns:
        pred = positive_probability(pred) if "probability" in pred.columns else pred.withColumn("score", F.col("prediction"))
    return reliable_checkpoint(pred.select(*keep_cols, "prediction", "score"))


def cross_validate(data: DataFrame, fold_col: str, make_model: Callable[[], object],
                   keep_cols: Sequence[str], n_folds: int, parallelism: int | None = None) -> DataFrame:
    """Per fold: fit on the other folds, predict this one (ML-06).  All
    predictions come back as one table with ``fold``; metrics are then one
    grouped aggregate.  The folds are fitted from driver threads, several at
    a time (like ``CrossValidator(parallelism=...)``), over an input written
    once to the checkpoint folder, with texts already counted."""
    from concurrent.futures import ThreadPoolExecutor

    model = make_model()
    if isinstance(model, CharCounts):
        counted = model.prepared(data)
        data = counted.select(*[c for c in counted.columns if c != model.text or c in keep_cols])
    data = reliable_checkpoint(data)

    def one(f: int) -> DataFrame:
        pred = fit_predict(data.where(F.col(fold_col) != f), data.where(F.col(fold_col) == f), make_model(), keep_cols)
        return pred.select(*keep_cols, F.lit(f).alias("fold"), "prediction", "score")

    with ThreadPoolExecutor(max_workers=parallelism or n_folds) as pool:
        parts = list(pool.map(one, range(n_folds)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
