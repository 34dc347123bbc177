"""Random forest of regression trees grown in tasks (ML-02).

Every feature is cut into at most ``max_bins`` bins; a row is then one byte a
feature, and rows travel in blocks of ``BLOCK_ROWS``.  Each tree draws its rows
with replacement (a row's weight is a Poisson number seeded by tree and block)
and each node its features.  A node of more than ``local_rows`` drawn rows is
split from histograms that tasks make of their blocks; a smaller one gets its
rows in one task, which grows the whole subtree, all nodes of a level at once.
A forest on few rows is thus one job with a task for each tree, and a tree on
many rows one job a level until its nodes are small.

The trees stay in the shared folder and the driver has only the nodes that were
split by histograms.  To predict, rows and subtrees meet by node.

Splits lessen the variance most; equal gains go to the feature drawn first, then
the lower cut.  Sums are added in the order of blocks, so retries change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from helixframe.operators.boosting import Tree
from helixframe.session import Shared, bounded_batches, reliable_checkpoint

BLOCK_ROWS = 4096
NODES_AT_ONCE = 2048                                    # nodes whose histograms a task holds
LEAST_GAIN = 1e-12                                      # of a node's variance; less is rounding
_PARTS = ("feature", "cut", "left", "right", "value")
_KINDS = dict(zip(_PARTS, ("i4", "u1", "i4", "i4", "f8"), strict=True))


class RandomForestRegressor:
    """``fit(df)`` on a column of vectors or arrays and a column of numbers."""

    def __init__(self, numTrees: int = 100, seed: int = 1234, maxDepth: int = 25, labelCol: str = "label", featuresCol: str = "features",
                 featureSubsetStrategy: str = "onethird", maxBins: int = 32, local_rows: int = 200_000):
        if not 2 <= maxBins <= 256:
            raise ValueError("2 to 256 bins")
        self.num_trees, self.seed, self.max_depth, self.max_bins = numTrees, seed, maxDepth, maxBins
        self.label, self.features, self.subset, self.local_rows = labelCol, featuresCol, featureSubsetStrategy, local_rows

    def fit(self, df: DataFrame) -> RandomForestModel:
        bounded_batches(df.sparkSession)
        d = df.select(_array(df, self.features).alias("x"), F.col(self.label).cast("double").alias("y"))
        facts = d.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.max(F.size("x")).alias("wide"),
                      F.count(F.when(F.col("y").isNull() | F.isnan("y") | (F.abs("y") == math.inf), 1)).alias("no_y"),
                      F.count(F.when(F.col("x").isNull() | F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == math.inf)), 1)).alias("no_x")).first()
        if not facts["n"] or facts["no_y"] or facts["no_x"]:
            raise ValueError(f"a forest needs rows whose labels and features are numbers: {facts['n']} rows, "
                             f"{facts['no_y']} labels and {facts['no_x']} features are null, NaN or infinite")
        wide = facts["wide"]
        drawn = {"all": wide, "onethird": math.ceil(wide / 3)}[self.subset]
        edges = bin_edges(d, wide, self.max_bins)
        packed = d.mapInArrow(_packed(edges), "block long, n int, bins binary, y binary")
        blocks = reliable_checkpoint(packed)
        blocks = blocks.repartition(max(1, min(blocks.count(), 4 * df.sparkSession.sparkContext.defaultParallelism)))
        how = (self.seed % (1 << 63), wide, drawn, self.max_bins)
        upper, small = self._upper(blocks, facts["n"], facts["mean"], how)
        shared = Shared(df.sparkSession, (upper, small))
        rows = blocks.mapInArrow(_rows_of(shared, how), "tree int, node int, block long, bins binary, y binary, w binary")
        tasks = max(1, min(2 * sum(map(len, small)), 2000))
        grown = rows.repartition(tasks, "tree", "node").groupBy("tree", "node").applyInArrow(
            _finished(shared, how, self.max_depth), "tree int, node int, " + ", ".join(f"{c} binary" for c in _PARTS))
        return RandomForestModel(upper, small, reliable_checkpoint(grown), edges, tasks, self.features)

    def _upper(self, blocks: DataFrame, total: int, mean: float, how) -> tuple[list[Tree], list[dict[int, int]]]:
        """The trees down to nodes of at most ``local_rows`` drawn rows, and
        for each tree the depth of those nodes."""
        trees, small = [Tree() for _ in range(self.num_trees)], [{} for _ in range(self.num_trees)]
        level = []
        for t, tree in enumerate(trees):
            root = tree.leaf(mean)
            if total > self.local_rows:
                level.append((t, root))
            else:
                small[t][root] = 0
        depth = 0
        while level:
            below = []
            for some in (level[i:i + NODES_AT_ONCE] for i in range(0, len(level), NODES_AT_ONCE)):
                shared = Shared(blocks.sparkSession, (trees, some))
                sums = blocks.mapInArrow(_histograms(shared, mean, how), "tree int, node int, part long, sums binary")
                for r in sums.groupBy("tree", "node").applyInArrow(_best(how), _SPLIT).collect():
                    tree, node = trees[r["tree"]], r["node"]
                    tree.weight[node] = mean + r["value"]
                    if r["feature"] < 0 or depth >= self.max_depth:
                        continue
                    kids = [tree.leaf(mean + r[c]) for c in ("left", "right")]
                    tree.split(node, r["feature"], r["cut"], *kids)
                    for kid, n in zip(kids, (r["n_left"], r["n_right"]), strict=True):
                        if n > self.local_rows:
                            below.append((r["tree"], kid))
                        else:
                            small[r["tree"]][kid] = depth + 1
            level, depth = sorted(below), depth + 1
        return trees, small


class RandomForestModel:
    def __init__(self, upper: list[Tree], small: list[dict[int, int]], grown: DataFrame, edges: list[list[float]], tasks: int, features: str):
        self.upper, self.small, self.grown, self.edges, self.tasks, self.features = upper, small, grown, edges, tasks, features

    @property
    def totalNumNodes(self) -> int:
        below = self.grown.agg(F.coalesce(F.sum(F.octet_length("cut") - 1), F.lit(0))).first()[0]
        return sum(len(t.feature) for t in self.upper) + below

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``, the mean of the trees' values."""
        spark, n_trees = df.sparkSession, len(self.upper)
        bounded_batches(spark)
        d = reliable_checkpoint(df.withColumn("__at", F.monotonically_increasing_id()))
        if d.where(F.col(self.features).isNull()).limit(1).count():
            raise ValueError("a forest cannot predict rows without features")
        packed = d.select(_array(d, self.features).alias("x"), "__at").mapInArrow(_packed(self.edges), "block long, n int, bins binary, at binary")
        meet = "tree int, node int, kind int, block long, " + ", ".join(f"{c} binary" for c in _PARTS)
        shared = Shared(spark, (self.upper, self.small))
        sent = reliable_checkpoint(packed).mapInArrow(_sent(shared, len(self.edges)), meet)
        trees = self.grown.select("tree", "node", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("block"), *_PARTS)
        both = trees.unionByName(sent).repartition(self.tasks, "tree", "node").sortWithinPartitions("tree", "node", "kind", "block")
        each = both.mapInArrow(_scored(shared, len(self.edges)), "block long, tree int, node int, at binary, value binary")
        means = each.groupBy("block").applyInArrow(_mean(n_trees), "__at long, prediction double")
        return d.join(means, "__at").drop("__at")


def _array(df: DataFrame, col: str):
    return F.col(col).cast("array<double>") if isinstance(df.schema[col].dataType, ArrayType) else vector_to_array(col)


def bin_edges(d: DataFrame, wide: int, max_bins: int) -> list[list[float]]:
    """For each feature of the arrays ``x`` the values that end a bin: between
    all values where there are at most ``max_bins`` of them, else quantiles."""
    few = d.mapInArrow(_few(max_bins + 1), "feature int, x double").groupBy("feature").agg(
        F.slice(F.array_sort(F.collect_set("x")), 1, max_bins + 1).alias("x"))
    values = {r["feature"]: r["x"] for r in few.collect()}
    at = [i / max_bins for i in range(1, max_bins)]
    many = [k for k in range(wide) if len(values[k]) > max_bins]
    cuts = d.agg(*[F.percentile_approx(F.col("x")[k], at, 100 * max_bins).alias(f"q{k}") for k in many]).first() if many else {}
    return [sorted(set(cuts[f"q{k}"])) if len(values[k]) > max_bins else
            [a + (b - a) / 2 for a, b in zip(values[k], values[k][1:])] for k in range(wide)]


def _few(most: int):
    """Up to ``most`` values of each feature in a task."""
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        held: list = []
        for b in batches:
            if not b.num_rows:
                continue
            x = _values(b.column(0))
            held = held or [np.zeros(0)] * x.shape[1]
            for k in range(x.shape[1]):
                if len(held[k]) < most:
                    held[k] = np.unique(np.concatenate([held[k], x[:, k]]))[:most]
        if held:
            yield pa.RecordBatch.from_pydict({"feature": pa.array(np.repeat(np.arange(len(held)), [len(h) for h in held]), "i4"), "x": np.concatenate(held)})
    return run


def _values(column):
    import numpy as np
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), "f8").reshape(len(column), -1)


def _packed(edges):
    """Blocks of rows as bytes: bins, and the second column as it is."""
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        task, made = TaskContext.get().partitionId(), 0
        names = ["block", "n", "bins"]

        def block(bins, other):
            bins, other = np.concatenate(bins), np.concatenate(other)
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + made]), pa.array([len(other)], "i4"), pa.array([bins.tobytes()]),
                                               pa.array([other.tobytes()])], [*names, name])
        held, name = ([], []), None
        for b in batches:
            if not b.num_rows:
                continue
            x, name = _values(b.column(0)), b.schema.names[1]
            if x.shape[1] != len(edges):
                raise ValueError(f"rows of {x.shape[1]} features, not {len(edges)}")
            bins = np.empty(x.shape, "u1")
            for k, e in enumerate(edges):
                bins[:, k] = np.searchsorted(np.array(e), x[:, k], "left")
            held[0].append(bins)
            held[1].append(b.column(1).to_numpy())
            if sum(map(len, held[1])) >= BLOCK_ROWS:
                yield block(*held)
                held, made = ([], []), made + 1
        if held[1]:
            yield block(*held)
    return run


def _drawn(how, tree: int, block: int, n: int):
    """How often each row of a block is in a tree."""
    import numpy as np
    return np.random.default_rng([how[0], tree, block]).poisson(1.0, n)


def _features_of(how, tree: int, node: int):
    """The features a node above the small ones may split by."""
    import numpy as np
    return np.random.default_rng([how[0], tree, node, 1]).permutation(how[1])[:how[2]]


def _blocks(batches, wide: int) -> Iterator:
    import numpy as np
    for b in batches:
        for block, n, bins, other in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            yield block, n, np.frombuffer(bins, "u1").reshape(n, wide), other


def _histograms(shared, mean: float, how):
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        trees, level = shared.value
        bins_of, part, wanted = how[3], TaskContext.get().partitionId(), {}
        for t, node in level:
            wanted.setdefault(t, []).append(node)
        held = {at: np.zeros((2, how[2], bins_of)) for at in level}
        span = {at: np.array([np.inf, -np.inf, 0.0]) for at in level}       # least and greatest label, sum of squares
        some = False
        for block, n, bins, y in _blocks(batches, how[1]):
            y, some = np.frombuffer(y, "f8") - mean, True
            for t, nodes in wanted.items():
                w = _drawn(how, t, block, n)
                rows = np.flatnonzero(w)
                node = trees[t].nodes_of(bins[rows])
                for k in nodes:
                    mine = rows[node == k]
                    if not len(mine):
                        continue
                    wk, yk, sums, s = w[mine].astype("f8"), y[mine], held[t, k], span[t, k]
                    s[:] = min(s[0], yk.min()), max(s[1], yk.max()), s[2] + (wk * yk * yk).sum()
                    for j, f in enumerate(_features_of(how, t, k)):
                        sums[0, j] += np.bincount(bins[mine, f], wk, bins_of)
                        sums[1, j] += np.bincount(bins[mine, f], wk * yk, bins_of)
        for t, k in level if some else ():
            yield pa.RecordBatch.from_arrays([pa.array([t], "i4"), pa.array([k], "i4"), pa.array([part]), pa.array(
                [held[t, k].tobytes() + span[t, k].tobytes()])], ["tree", "node", "part", "sums"])
    return run


_SPLIT = "tree int, node int, feature int, cut int, value double, left double, right double, n_left long, n_right long"


def _best(how):
    """The split of a node from the histograms of all tasks."""
    def run(key, table):
        import numpy as np
        import pyarrow as pa
        t, node = (k.as_py() for k in key)
        parts = sorted(zip(table.column("part").to_pylist(), table.column("sums").to_pylist(), strict=True))
        each = [np.frombuffer(x, "f8") for _, x in parts]
        w, s = sum(x[:-3] for x in each).reshape(2, how[2], how[3])
        low, high, squares = min(x[-3] for x in each), max(x[-2] for x in each), sum(x[-1] for x in each)
        n, total = w[0].sum(), s[0].sum()
        middle = min(max(total / max(n, 1), low), high) if n else 0.0
        s = s - w * middle                              # about the node's own mean
        nl, sl = w.cumsum(axis=1)[:, :-1], s.cumsum(axis=1)[:, :-1]
        gain = np.where((nl > 0) & (nl < n), sl * sl / np.maximum(nl * (n - nl), 0.5), -1.0)
        j, cut = divmod(int(gain.argmax()), gain.shape[1])
        found = high > low and gain[j, cut] * n > LEAST_GAIN * (squares - n * middle * middle) and gain[j, cut] > 0
        f, left, n_left = int(_features_of(how, t, node)[j]) if found else -1, sl[j, cut], nl[j, cut]
        row = (t, node, f, cut, middle, middle + left / max(n_left, 1), middle - left / max(n - n_left, 1), int(n_left), int(n - n_left))
        kinds = [pa.int32()] * 4 + [pa.float64()] * 3 + [pa.int64()] * 2
        return pa.Table.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in _SPLIT.split(", ")])
    return run


def _rows_of(shared, how):
    """A block's rows for each small node of each tree."""
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        trees, small = shared.value
        for block, n, bins, y in _blocks(batches, how[1]):
            y = np.frombuffer(y, "f8")
            for t, tree in enumerate(trees):
                w = _drawn(how, t, block, n)
                rows = np.flatnonzero(w)
                for k, mine in _by_node(tree, small[t], bins, rows):
                    yield pa.RecordBatch.from_arrays([pa.array([t], "i4"), pa.array([k], "i4"), pa.array([block]), pa.array([bins[mine].tobytes()]), pa.array(
                        [y[mine].tobytes()]), pa.array([w[mine].astype("u1").tobytes()])], ["tree", "node", "block", "bins", "y", "w"])
    return run


def _by_node(tree: Tree, nodes, bins, rows) -> Iterator:
    """``rows`` by the node of ``nodes`` they fall in."""
    import numpy as np
    if len(tree.feature) == 1:
        if nodes and len(rows):
            yield 0, rows
        return
    at = tree.nodes_of(bins[rows])
    order = np.argsort(at, kind="stable")
    found, first = np.unique(at[order], return_index=True)
    for k, part in zip(found.tolist(), np.split(rows[order], first[1:]), strict=True):
        if k in nodes:
            yield k, part


def _finished(shared, how, max_depth: int):
    def run(key, table):
        import numpy as np
        import pyarrow as pa
        t, node = (k.as_py() for k in key)
        order = np.argsort(table.column("block").to_numpy(), kind="stable").tolist()
        bins, y, w = (np.concatenate([np.frombuffer(column[i].as_buffer(), kind) for i in order])
                      for column, kind in zip((table.column(c) for c in ("bins", "y", "w")), ("u1", "f8", "u1"), strict=True))
        random = np.random.default_rng([how[0], t, node, 2])
        tree = grow(bins.reshape(-1, how[1]), y, w.astype("f8"), max_depth - shared.value[1][t][node], how[2], how[3], random)
        return pa.Table.from_arrays([pa.array([t], "i4"), pa.array([node], "i4"), *[pa.array([tree[c].tobytes()]) for c in _PARTS]],
                                    ["tree", "node", *_PARTS])
    return run


def grow(bins, y, w, max_depth: int, drawn: int, n_bins: int, random) -> dict:
    """The subtree of rows with weights ``w``, as columns of its nodes:
    ``feature`` -1 marks a leaf, a row goes left if its bin is at most ``cut``."""
    import numpy as np
    wide, flat = bins.shape[1], bins.ravel()
    at_once = max(1, min((1 << 18) // n_bins, (1 << 20) // wide))
    made = {c: [] for c in _PARTS}
    rows, first, size, depth = np.arange(len(y)), np.zeros(1, "i8"), 1, 0    # rows in the order of their nodes
    while len(first):
        count = np.diff(np.append(first, len(rows)))
        wr, yr = w[rows], y[rows]
        n = np.add.reduceat(wr, first)
        # about one of the node's values: where all are equal the mean is that value
        one = yr[first]
        mean = one + np.add.reduceat(wr * (yr - np.repeat(one, count)), first) / n
        column = {c: np.zeros(len(first), k) for c, k in _KINDS.items()}
        column["feature"][:], column["value"][:] = -1, mean
        for c in _PARTS:
            made[c].append(column[c])
        ids = np.flatnonzero((np.maximum.reduceat(yr, first) > np.minimum.reduceat(yr, first)) & (depth < max_depth))
        split, cut, sides = np.full(len(first), -1), np.zeros(len(first), "i8"), []
        for some in (ids[i:i + at_once] for i in range(0, len(ids), at_once)):
            m, c = len(some), count[some]
            begin = np.cumsum(c) - c
            node = np.repeat(np.arange(m), c)
            at = np.arange(len(node)) - np.repeat(begin - first[some], c)
            mine, weight = rows[at], wr[at]
            off = yr[at] - mean[some][node]
            wy = weight * off
            least = LEAST_GAIN * np.add.reduceat(wy * off, begin) / n[some]
            by = np.tile(np.arange(wide), (m, 1)) if drawn >= wide else random.random((m, wide), "f4").argpartition(drawn - 1, axis=1)[:, :drawn]
            best, where, base, row = np.zeros(m), np.full(m, -1), node * n_bins, mine * wide
            best_cut = np.zeros(m, "i8")
            for j in range(by.shape[1]):
                f = by[:, j]
                cell = base + flat[row + f[node]]
                nl = np.bincount(cell, weight, m * n_bins).reshape(m, n_bins).cumsum(axis=1)[:, :-1]
                sl = np.bincount(cell, wy, m * n_bins).reshape(m, n_bins).cumsum(axis=1)[:, :-1]
                nr = n[some][:, None] - nl
                nr *= nl
                np.maximum(nr, 0.5, out=nr)             # of weights; 0 if a side is empty, and then so is the sum
                sl *= sl
                sl /= nr
                k = sl.argmax(axis=1)
                gain = sl[np.arange(m), k]
                better = gain > np.maximum(best, least)
                best[better], where[better], best_cut[better] = gain[better], f[better], k[better]
            good = where >= 0
            split[some], cut[some] = where, best_cut
            keep = good[node]
            mine, node = mine[keep], (np.cumsum(good) - 1)[node[keep]]
            goes = flat[mine * wide + where[good][node]] <= best_cut[good][node]
            order = np.argsort(2 * node + ~goes, kind="stable")
            sides.append((mine[order], np.bincount(2 * node + ~goes, minlength=2 * int(good.sum()))))
        ids = np.flatnonzero(split >= 0)
        column["feature"][ids], column["cut"][ids] = split[ids], cut[ids]
        column["left"][ids], column["right"][ids] = size + np.arange(2 * len(ids)).reshape(-1, 2).T
        size, depth = size + 2 * len(ids), depth + 1
        rows = np.concatenate([s[0] for s in sides]) if sides else np.zeros(0, "i8")
        first = np.concatenate([s[1] for s in sides]) if sides else np.zeros(0, "i8")
        first = np.cumsum(first) - first
    return {c: np.concatenate(made[c]) for c in _PARTS}


def leaves(tree: dict, bins):
    """The value of each row's leaf."""
    import numpy as np
    feature, cut, left, right = (tree[c] for c in _PARTS[:4])
    at, rows = np.zeros(len(bins), "i8"), np.arange(len(bins))
    while len(rows):
        rows = rows[feature[at[rows]] >= 0]
        n = at[rows]
        at[rows] = np.where(bins[rows, feature[n]] <= cut[n], left[n], right[n])
    return tree["value"][at]


def _sent(shared, wide: int):
    """A block's rows for each tree: by the small node that they fall in, or
    with their values where they end above."""
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        trees, small = shared.value
        names = ["tree", "node", "kind", "block", *_PARTS]
        none = [pa.array([None], pa.binary())] * 3

        def out(t, k, kind, block, a, b):
            return pa.RecordBatch.from_arrays([*[pa.array([x], "i4") for x in (t, k, kind)], pa.array([block]), pa.array([a]), pa.array([b]), *none], names)
        for block, n, bins, ids in _blocks(batches, wide):
            ids = np.frombuffer(ids, "i8")
            for t, tree in enumerate(trees):
                for k, mine in _by_node(tree, range(len(tree.feature)), bins, np.arange(n)):
                    if k in small[t]:
                        yield out(t, k, 1, block, ids[mine].tobytes(), bins[mine].tobytes())
                    else:
                        yield out(t, k, 2, block, ids[mine].tobytes(), np.full(len(mine), tree.weight[k]).tobytes())
    return run


def _scored(shared, wide: int):
    """Sorted by tree and node, a subtree comes before its rows; a node that
    drew no rows has none and keeps its own value."""
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        tree, of = None, None
        for b in batches:
            for t, k, kind, block, *parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 0:
                    tree, of = {c: np.frombuffer(x, _KINDS[c]) for c, x in zip(_PARTS, parts, strict=True)}, (t, k)
                    continue
                if kind == 2:
                    value = parts[1]
                elif of == (t, k):
                    value = leaves(tree, np.frombuffer(parts[1], "u1").reshape(-1, wide)).tobytes()
                else:
                    value = np.full(len(parts[0]) // 8, shared.value[0][t].weight[k]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([t], "i4"), pa.array([k], "i4"), pa.array([parts[0]]), pa.array([value])],
                                                 ["block", "tree", "node", "at", "value"])
    return run


def _mean(n_trees: int):
    def run(key, table):
        import numpy as np
        import pyarrow as pa
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("tree", "node", "at", "value")), strict=True), key=lambda r: r[:2])
        ids = np.unique(np.concatenate([np.frombuffer(r[2], "i8") for r in rows if r[0] == rows[0][0]]))
        sums = np.zeros(len(ids))
        for _, _, at, value in rows:
            sums[np.searchsorted(ids, np.frombuffer(at, "i8"))] += np.frombuffer(value, "f8")
        return pa.Table.from_pydict({"__at": ids, "prediction": sums / n_trees})
    return run
