"""Second-order boosted trees on gradient histograms (ML-03).

Every feature is cut into at most ``max_bins`` bins at its quantiles; a row is
then one byte a feature.  A tree is grown level by level: tasks add up gradients
and hessians of their rows by (node, feature, bin), a grouped sum merges them,
and the split of greatest gain of each node comes back.  A node of at most
``local_rows`` rows is finished in one task, which gets its rows and grows the
rest of its subtree by the same rule, so deep levels cost one job instead of
one each.  Margins are written every few trees; trees since then are applied
on the way.

Gradients and hessians are whole numbers (2^-24ths), so sums do not depend on
the order of rows, tasks or retries, and both ways to split a node give the
same tree.  Equal gains go to the lower feature, then the lower cut.

Objective: logistic loss.  Leaf weight -G / (H + reg_lambda); gain
(GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l)) / 2 - gamma; a child needs a hessian
of ``min_child_weight``.  Null and NaN features go to the left child.  The
defaults are those of the usual gradient boosting library.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from helixframe.session import Shared, reliable_checkpoint

UNIT = float(1 << 24)
_ROW = "row_bins binary, y double, margin double"
_SUBTREE = "node int, feature array<int>, cut array<int>, left array<int>, right array<int>, weight array<double>"


@dataclass
class Tree:
    """Nodes as lists; ``feature`` -1 marks a leaf.  A row goes left if its bin
    of the feature is at most ``cut``."""
    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)

    def leaf(self, weight: float) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.weight, weight)):
            column.append(x)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: int, left: int, right: int) -> None:
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, left, right

    def graft(self, node: int, other: Tree) -> None:
        """``other`` in place of the leaf ``node``."""
        at = [node, *range(len(self.feature), len(self.feature) + len(other.feature) - 1)]
        for _ in at[1:]:
            self.leaf(0.0)
        for k, n in enumerate(at):
            self.weight[n] = other.weight[k]
            if other.feature[k] >= 0:
                self.split(n, other.feature[k], other.cut[k], at[other.left[k]], at[other.right[k]])

    def nodes_of(self, bins):
        """The leaf of each row of a bin matrix."""
        import numpy as np
        feature, cut = np.array(self.feature), np.array(self.cut)
        left, right = np.array(self.left), np.array(self.right)
        at, rows = np.zeros(len(bins), "i8"), np.arange(len(bins))
        while len(rows):
            rows = rows[feature[at[rows]] >= 0]
            n = at[rows]
            at[rows] = np.where(bins[rows, feature[n]] <= cut[n], left[n], right[n])
        return at

    def add_to(self, margin, bins) -> None:
        import numpy as np
        margin += np.array(self.weight)[self.nodes_of(bins)]


@dataclass
class Rule:
    """What a split is judged by."""
    reg_lambda: float
    gamma: float
    min_child_weight: float
    learning_rate: float
    max_depth: int

    def weight(self, g: int, h: int) -> float:
        return -(g / UNIT) / (h / UNIT + self.reg_lambda) * self.learning_rate

    def best(self, g, h) -> tuple[float, int, int] | None:
        """(gain, feature, cut) of the best split by histograms [feature, bin]
        of whole numbers, or None."""
        import numpy as np
        g, h = np.asarray(g, "f8") / UNIT, np.asarray(h, "f8") / UNIT
        gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
        gt, ht = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
        gr, hr, l = gt - gl, ht - hl, self.reg_lambda
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (gl * gl / (hl + l) + gr * gr / (hr + l) - gt * gt / (ht + l)) / 2 - self.gamma
        gain[~((hl >= self.min_child_weight) & (hr >= self.min_child_weight) & np.isfinite(gain))] = -np.inf
        if not gain.size:
            return None
        f, b = divmod(int(gain.argmax()), gain.shape[1])
        return (float(gain[f, b]), f, b) if gain[f, b] > 1e-9 else None

    def grow(self, bins, g, h, depth: int, n_bins: int) -> Tree:
        """The whole subtree of a node from its rows."""
        import numpy as np
        tree, n_features = Tree(), bins.shape[1]
        flat = bins.astype("i8") + np.arange(n_features) * n_bins

        def sums(rows):
            at = flat[rows].ravel()
            return [np.bincount(at, np.repeat(x[rows], n_features).astype("f8"), n_features * n_bins).reshape(n_features, n_bins)
                    for x in (g, h)]

        rows = np.arange(len(g))
        todo = [(tree.leaf(self.weight(int(g.sum()), int(h.sum()))), rows, depth, None)]
        while todo:
            node, rows, depth, made = todo.pop()
            if depth >= self.max_depth or int(h[rows].sum()) < 2 * self.min_child_weight * UNIT or len(rows) < 2:
                continue
            made = made or sums(rows)
            found = self.best(*made)
            if found is None:
                continue
            _, f, cut = found
            goes = bins[rows, f] <= cut
            sides = [rows[goes], rows[~goes]]
            few = int(len(sides[1]) < len(sides[0]))
            part = sums(sides[few])                     # the larger side is what is left of the node
            each = [None, None]
            each[few], each[1 - few] = part, [a - b for a, b in zip(made, part, strict=True)]
            kids = [tree.leaf(self.weight(int(g[r].sum()), int(h[r].sum()))) for r in sides]
            tree.split(node, f, cut, *kids)
            todo += [(kids[k], sides[k], depth + 1, each[k]) for k in (0, 1)]
        return tree


def gradients(margin, y):
    """Gradient and hessian of the logistic loss in 2^-24ths."""
    import numpy as np
    p = 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))
    return np.rint((p - y) * UNIT).astype("i8"), np.rint(np.maximum(p * (1 - p), 1e-16) * UNIT).astype("i8")


def bin_edges(df: DataFrame, features: str, n_features: int, max_bins: int) -> list[list[float]]:
    """For each feature the values that begin a new bin: at most ``max_bins - 2``
    quantiles, so with the first bin and that of missing values a bin fits in a
    byte.  Where a feature has few values each is an edge."""
    n = max_bins - 2
    at = [i / n for i in range(1, n + 1)]
    one = lambda k: F.when(~F.isnan(F.col(features)[k]), F.col(features)[k])
    got = df.agg(*[F.percentile_approx(one(k), at, 100 * n).alias(f"q{k}") for k in range(n_features)]).first()
    return [sorted(set(x or [])) for x in got]


def matrix(rows: list[bytes], n_features: int):
    import numpy as np
    return np.frombuffer(b"".join(rows), "u1").reshape(len(rows), n_features)


def binned(values, edges: list[list[float]]):
    """Bin numbers of a feature matrix: 0 for missing, then 1 + the edges
    that are not above the value."""
    import numpy as np
    out = np.empty(values.shape, "u1")
    for k, e in enumerate(edges):
        out[:, k] = np.where(np.isnan(values[:, k]), 0, 1 + np.searchsorted(np.array(e), values[:, k], "right"))
    return out


class BoostedTrees:
    """``fit(df)`` on columns ``features`` (array or vector) and ``label`` (0 or 1)."""

    def __init__(self, n_trees: int = 100, learning_rate: float = 0.3, max_depth: int = 6, reg_lambda: float = 1.0,
                 gamma: float = 0.0, min_child_weight: float = 1.0, max_bins: int = 256, base_score: float = 0.5,
                 local_rows: int = 100_000, write_every: int = 10, features: str = "features", label: str = "label"):
        if not 3 <= max_bins <= 256:
            raise ValueError("3 to 256 bins")
        self.rule = Rule(reg_lambda, gamma, min_child_weight, learning_rate, max_depth)
        self.n_trees, self.max_bins, self.local_rows, self.write_every = n_trees, max_bins, local_rows, write_every
        self.base = math.log(base_score / (1 - base_score))
        self.features, self.label = features, label

    def fit(self, df: DataFrame) -> BoostedModel:
        d = df.select(_array(df, self.features).alias("x"), F.col(self.label).cast("double").alias("y")).where(
            F.col("x").isNotNull() & F.col("y").isNotNull())
        d = reliable_checkpoint(d)
        first = d.select(F.size("x").alias("n")).first()
        n_features = first["n"] if first else 0
        model = BoostedModel([], [], n_features, self.base, self.features)
        if not n_features:
            return model
        model.edges = edges = bin_edges(d, "x", n_features, self.max_bins)
        base = self.base

        def rows(batches) -> Iterator:
            import numpy as np
            import pyarrow as pa
            for b in batches:
                bins = binned(_values(b.column(0), n_features), edges)
                yield pa.RecordBatch.from_pydict({"row_bins": pa.array([r.tobytes() for r in bins], pa.binary()), "y": b.column(1),
                                                  "margin": np.full(b.num_rows, base)})
        data = reliable_checkpoint(d.mapInArrow(rows, _ROW))
        total, fresh = data.count(), []
        for t in range(self.n_trees):
            tree = self._tree(data, total, fresh, n_features)
            model.trees.append(tree)
            fresh.append(tree)
            if (t + 1) % self.write_every == 0 and t + 1 < self.n_trees:
                data, fresh = reliable_checkpoint(data.mapInArrow(_applied(fresh, n_features), _ROW)), []
        return model

    def _tree(self, data: DataFrame, total: int, fresh: list[Tree], n_features: int) -> Tree:
        """One tree: levels of large nodes, then the subtrees of small ones."""
        rule, spark = self.rule, data.sparkSession
        tree, small = Tree(), {}
        root = tree.leaf(0.0)
        level, depth = ([], 0) if total <= self.local_rows else ([root], 0)
        if not level:
            small[root] = 0
        while level:
            shared = Shared(spark, (tree, level, fresh))
            sums = (data.mapInArrow(_histograms(shared, n_features), "node int, feature int, bin int, g long, h long, n long")
                    .groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")]))
            each = sums.groupBy("node", "feature").agg(F.collect_list(F.struct("bin", "g", "h", "n")).alias("bins"))
            splits = each.mapInArrow(_best(rule, self.max_bins), "node int, feature int, gain double, cut int, "
                                     "g long, h long, gl long, hl long, nl long, n long")
            best = splits.groupBy("node").agg(F.max_by(F.struct(*splits.columns), F.struct("gain", -F.col("feature"))).alias("s")).collect()
            below = []
            for r in (r["s"] for r in best):
                node = r["node"]
                tree.weight[node] = rule.weight(r["g"], r["h"])
                if not r["gain"] > 1e-9:
                    continue
                kids = [tree.leaf(rule.weight(r["gl"], r["hl"])), tree.leaf(rule.weight(r["g"] - r["gl"], r["h"] - r["hl"]))]
                tree.split(node, r["feature"], r["cut"], *kids)
                if depth + 1 < rule.max_depth:
                    for kid, n in zip(kids, (r["nl"], r["n"] - r["nl"]), strict=True):
                        if n > self.local_rows:
                            below.append(kid)
                        else:
                            small[kid] = depth + 1
            level, depth = below, depth + 1
        if small:
            shared = Shared(spark, (tree, small, fresh))
            rows = data.mapInArrow(_rows_of(shared, n_features), "node int, row_bins binary, g long, h long")
            done = rows.groupBy("node").applyInArrow(_finished(rule, shared, n_features, self.max_bins), _SUBTREE)
            for r in done.collect():
                tree.graft(r["node"], Tree(*[list(r[c]) for c in ("feature", "cut", "left", "right", "weight")]))
        return tree


def _array(df: DataFrame, col: str):
    return F.col(col).cast("array<double>") if isinstance(df.schema[col].dataType, ArrayType) else vector_to_array(col)


def _values(column, n_features: int):
    import numpy as np
    import pyarrow as pa
    flat = column.flatten().to_numpy(zero_copy_only=False) if isinstance(column, pa.ListArray) else np.array(column.to_pylist(), "f8")
    return np.asarray(flat, "f8").reshape(len(column), n_features)


def _state(batch, trees: list[Tree], n_features: int):
    """(bin matrix, labels, margins) of a batch with ``trees`` added."""
    bins = matrix(batch.column(0).to_pylist(), n_features)
    margin = batch.column(2).to_numpy().copy()
    for t in trees:
        t.add_to(margin, bins)
    return bins, batch.column(1).to_numpy(), margin


def _applied(trees, n_features):
    def run(batches) -> Iterator:
        import pyarrow as pa
        for b in batches:
            _, _, margin = _state(b, trees, n_features)
            yield pa.RecordBatch.from_pydict({"row_bins": b.column(0), "y": b.column(1), "margin": margin})
    return run


def _histograms(shared, n_features):
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        tree, level, fresh = shared.value
        place = np.full(len(tree.feature), -1)
        place[level] = np.arange(len(level))
        size = len(level) * n_features * 256
        held = [np.zeros(size, "i8") for _ in range(3)] if size <= 1 << 24 else None

        def sparse(sums):
            at = np.flatnonzero(sums[2])
            node, feature = np.array(level)[at // (256 * n_features)], at // 256 % n_features
            return pa.RecordBatch.from_pydict({"node": pa.array(node, "i4"), "feature": pa.array(feature, "i4"), "bin": pa.array(at % 256, "i4"),
                                               "g": sums[0][at], "h": sums[1][at], "n": sums[2][at]})
        for b in batches:
            bins, y, margin = _state(b, fresh, n_features)
            g, h = gradients(margin, y)
            k = place[tree.nodes_of(bins)]
            rows = np.flatnonzero(k >= 0)
            at = ((k[rows, None] * n_features + np.arange(n_features)) * 256 + bins[rows]).ravel()
            keys, inverse = np.unique(at, return_inverse=True)
            for j, x in enumerate((g, h, np.ones(len(g), "i8"))):
                part = np.zeros(len(keys), "i8")
                np.add.at(part, inverse, np.repeat(x[rows], n_features))
                if held is None:
                    out = out if j else [keys]
                    out.append(part)
                else:
                    held[j][keys] += part
            if held is None:                            # too many nodes for one table: the grouped sum adds them up
                node = np.array(level)[out[0] // (256 * n_features)]
                yield pa.RecordBatch.from_pydict({"node": pa.array(node, "i4"), "feature": pa.array(out[0] // 256 % n_features, "i4"),
                                                  "bin": pa.array(out[0] % 256, "i4"), "g": out[1], "h": out[2], "n": out[3]})
        if held is not None:
            yield sparse(held)
    return run


def _best(rule: Rule, n_bins: int):
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for b in batches:
            out = []
            for node, feature, bins in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                g, h, n = (np.zeros(n_bins, "i8") for _ in range(3))
                for x in bins:
                    g[x["bin"]], h[x["bin"]], n[x["bin"]] = x["g"], x["h"], x["n"]
                found = rule.best(g[None], h[None])
                gain, cut = (found[0], found[2]) if found else (-1.0, 0)
                out.append((node, feature, gain, cut, int(g.sum()), int(h.sum()), int(g[:cut + 1].sum()), int(h[:cut + 1].sum()),
                            int(n[:cut + 1].sum()), int(n.sum())))
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), *[pa.int64()] * 6]
            names = ["node", "feature", "gain", "cut", "g", "h", "gl", "hl", "nl", "n"]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    return run


def _rows_of(shared, n_features):
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        tree, small, fresh = shared.value
        wanted = np.zeros(len(tree.feature), bool)
        wanted[list(small)] = True
        for b in batches:
            bins, y, margin = _state(b, fresh, n_features)
            g, h = gradients(margin, y)
            node = tree.nodes_of(bins)
            at = np.flatnonzero(wanted[node])
            yield pa.RecordBatch.from_pydict({"node": pa.array(node[at], "i4"), "row_bins": b.column(0).take(pa.array(at)),
                                              "g": g[at], "h": h[at]})
    return run


def _finished(rule: Rule, shared, n_features, n_bins):
    def run(key, rows):
        import numpy as np
        import pyarrow as pa
        node = key[0].as_py()
        bins = matrix(rows.column("row_bins").to_pylist(), n_features)
        g, h = (np.asarray(rows.column(c).to_numpy(), "i8") for c in ("g", "h"))
        tree = rule.grow(bins, g, h, shared.value[1][node], n_bins)
        lists = {c: pa.array([[int(x) for x in getattr(tree, c)]], pa.list_(pa.int32())) for c in ("feature", "cut", "left", "right")}
        return pa.Table.from_pydict({"node": pa.array([node], "i4"), **lists, "weight": pa.array([tree.weight], pa.list_(pa.float64()))})
    return run


@dataclass
class BoostedModel:
    edges: list[list[float]]
    trees: list[Tree]
    n_features: int
    base: float
    features: str

    def margins(self, values):
        """Sums of leaf weights for a feature matrix."""
        import numpy as np
        bins, margin = binned(values, self.edges), np.full(len(values), self.base)
        for t in self.trees:
            t.add_to(margin, bins)
        return margin

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``score`` (the probability of label 1) and
        ``prediction``; rows without features get the base score."""
        shared = Shared(df.sparkSession, self)

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import numpy as np
            model = shared.value
            for s in batches:
                x = np.full((len(s), model.n_features), np.nan)
                for k, v in enumerate(s):
                    if v is not None and model.trees:
                        x[k] = v
                yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(model.margins(x), -500, 500))))
        score = F.pandas_udf(run, "double")(_array(df, self.features))
        return df.withColumn("score", score).withColumn("prediction", (F.col("score") >= 0.5).cast("double"))
