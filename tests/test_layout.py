"""VEC-05: the neighbour graph against brute force, and what a layout keeps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import layout as L


def table(spark, x, parts=4):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").repartition(parts)


def recall(spark, x, k, **how):
    rows = L.numbered(table(spark, x), "v", ["id"])
    of = {r["n"]: r["id"] for r in rows.select("n", "id").collect()}
    got = {}
    for r in L.neighbours(rows, k, **how).collect():
        got.setdefault(of[r["u"]], {})[of[r["w"]]] = r["d"]
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    hits = 0
    for i, near in got.items():
        assert i not in near and len(near) == k and all(abs(d[i, j] - e) < 1e-6 for j, e in near.items())
        worst = np.sort(d[i])[k - 1]
        hits += sum(e <= worst + 1e-9 for e in near.values())
    return hits / (k * len(x))


def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 16)) * 2
    x = centres[r.integers(0, 12, 900)] + r.normal(size=(900, 16))
    assert recall(spark, x, 10, block=64) >= 0.9


def test_neighbours_without_any_structure(spark):
    x = np.random.default_rng(2).normal(size=(600, 12))
    assert recall(spark, x, 10, block=48, starts=2) >= 0.9


def test_copies_do_not_gather(spark):
    """A third of the rows are one vector: blocks stay of equal size."""
    r = np.random.default_rng(3)
    x = np.concatenate([np.zeros((150, 6)), r.normal(size=(300, 6)) + 3])
    assert recall(spark, x, 5, block=32) >= 0.9


def test_recall_of_probes(spark):
    x = np.random.default_rng(5).normal(size=(300, 5))
    rows = L.numbered(table(spark, x), "v", ["id"])
    exact = L.neighbours(rows, 8, block=300, starts=1, rounds=0)             # one block holds all rows
    assert L.recall(rows, exact, F.col("id") % 20 == 0, 8, block=4) == 1.0
    assert abs(L.recall(rows, exact.where("w % 2 = 0"), F.col("id") % 20 == 0, 8) - 0.5) < 0.2
    assert L.recall(rows.limit(0), exact, F.col("id") % 20 == 0, 8) == 1.0


def test_weights_are_joint_and_fall_with_distance(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (0, 3, 3.0), (1, 0, 1.0), (1, 2, 1.5), (1, 3, 4.0)], "u long, w long, d double")
    got = {(r["u"], r["w"]): r["p"] for r in L.weights(edges, 3).collect()}
    assert got[0, 1] == got[1, 0] == 1.0 and got[0, 1] > got[0, 2] > got[0, 3] > 0
    assert abs(1 + got[0, 2] + got[0, 3] - np.log2(3)) < 1e-4       # 0's own weights sum to log2 k


def test_layout_keeps_neighbours(spark):
    r = np.random.default_rng(4)
    label = r.integers(0, 6, 400)
    x = (np.eye(6, 20) * 8)[label] + r.normal(size=(400, 20))
    got = sorted((row["id"], row["x"], row["y"]) for row in L.layout(table(spark, x), "v", ["id"], k=10).collect())
    assert [g[0] for g in got] == list(range(400))
    p = np.array([g[1:] for g in got])
    assert np.isfinite(p).all()
    d = ((p[:, None] - p) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :10]
    assert (label[near] == label[:, None]).mean() > 0.9     # neighbours in the plane are neighbours in space
    pca = x @ np.linalg.eigh(np.cov(x.T))[1][:, -2:]
    d = ((pca[:, None] - pca) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert (label[np.argsort(d, axis=1)[:, :10]] == label[:, None]).mean() < (label[near] == label[:, None]).mean()


def test_odd_tables(spark):
    df = table(spark, np.ones((1, 3)))
    assert L.layout(df, "v", ["id"]).count() == 1
    assert L.layout(df.limit(0), "v", ["id"]).count() == 0
    nulls = df.union(spark.createDataFrame([(7, None)], df.schema)).union(df)
    assert sorted(r["id"] for r in L.layout(nulls, "v", ["id"], steps=2).select("id").collect()) == [0, 0]
    assert L.layout(nulls, "v", ["id"], steps=2).where(F.col("x").isNull()).count() == 0


def test_layout_takes_a_graph_and_rounds_compare_new_pairs(spark, monkeypatch):
    """One graph serves the layout and its recall; a round leaves out pairs that have met."""
    x = np.random.default_rng(6).normal(size=(300, 6))
    rows = L.numbered(table(spark, x), "v", ["id"])
    near = L.neighbours(rows, 8, block=32)
    assert L.recall(rows, near, F.col("id") % 20 == 0, 8) >= 0.9
    monkeypatch.setattr(L, "neighbours", None)              # a second graph would fail
    placed = L.layout(rows, "v", ["id"], k=8, steps=2, edges=near)
    assert sorted(r["id"] for r in placed.collect()) == list(range(300))
    import pyarrow as pa
    met = pa.table({"w": [4, 5, 6], "worst": [9.0, 9.0, 9.0], "new": [False, False, True], "v": [[0.0], [1.0], [3.0]]})
    got = L._meet(met).to_pydict()
    assert sorted(zip(got["u"], got["w"], got["d"])) == [(4, 6, 3.0), (5, 6, 2.0), (6, 4, 3.0), (6, 5, 2.0)]


def nearest(x, k):
    """Squares of the distances to the ``k`` nearest other rows."""
    d = ((x[:, None] - x) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("kind", ["plain", "far from the origin", "copies", "few rows", "one block", "tiny", "with NaN"])
def test_blocks_give_the_nearest_rows(kind):
    r = np.random.default_rng(7)
    x = {"far from the origin": lambda: 1e6 + 1e-6 * r.normal(size=(500, 5)), "copies": lambda: np.concatenate([np.zeros((300, 5)), r.normal(size=(300, 5))]),
         "few rows": lambda: r.normal(size=(6, 3)), "tiny": lambda: 1e-120 * r.normal(size=(300, 4))}.get(kind, lambda: r.normal(size=(700, 8)))()
    if kind == "with NaN":
        x[5] = np.nan
    good = np.isfinite(x[:, 0])
    step = 1000 if kind == "one block" else 100
    near = L._Nearest(np.arange(len(x)), x, 9, x[good].mean(axis=0), np.abs(x[good]).max())
    for a in range(0, len(x), step):
        near.add(np.arange(a, min(len(x), a + step)), x[a:a + step])
    want = nearest(x[good], min(9, len(x) - 1))
    assert np.allclose(near.d[good][:, :want.shape[1]], want, rtol=1e-9, atol=0) and np.isinf(near.d[~good]).all()
    assert (near.n != np.arange(len(x))[:, None]).all()
    real = near.n[good][:, :want.shape[1]]
    assert np.allclose(((x[good][:, None] - x[real]) ** 2).sum(axis=2), want, rtol=1e-9, atol=0)


@pytest.mark.parametrize("queries", [L.QUERIES, 100])
def test_neighbours_are_exact(spark, monkeypatch, queries):
    """Without structure a descent misses rows; this many rows are compared in blocks."""
    monkeypatch.setattr(L, "BLOCK", 64)
    monkeypatch.setattr(L, "_top", None)                # the descent's
    x = np.random.default_rng(8).normal(size=(900, 24))
    rows = L.numbered(table(spark, x), "v", ["id"])
    of = {r["n"]: r["id"] for r in rows.select("n", "id").collect()}
    got = {}
    for r in (L.neighbours(rows, 7) if queries == L.QUERIES else L.exact_neighbours(rows, 7, queries)).collect():
        got.setdefault(of[r["u"]], []).append(r["d"])
    assert np.allclose(np.sort([got[i] for i in range(900)]) ** 2, nearest(x, 7))


def test_blocks_of_unequal_size(spark):
    x = np.random.default_rng(10).normal(size=(930, 4))
    parts = [(0, 900), (900, 910), (910, 920), (920, 930)]
    frames = [spark.createDataFrame([(i, x[i].tolist()) for i in range(a, b)], "n long, v array<double>").coalesce(1) for a, b in parts]
    rows = frames[0].union(frames[1]).union(frames[2]).union(frames[3])
    got = {}
    for r in L.exact_neighbours(rows, 4, 300).collect():
        got.setdefault(r["u"], []).append(r["d"])
    assert np.allclose(np.sort([got[i] for i in range(930)]) ** 2, nearest(x, 4))


def test_the_descent_beyond_exact_rows(spark):
    x = np.random.default_rng(2).normal(size=(600, 12))
    assert recall(spark, x, 10, block=48, starts=2, exact_rows=599) >= 0.9
    x = np.concatenate([np.zeros((150, 6)), x[:300, :6] + 3])
    assert recall(spark, x, 5, block=32, exact_rows=0) >= 0.9


def test_recall_of_probes_in_several_batches(spark):
    """Probes and rows that meet batch by batch give what all at once give."""
    x = np.random.default_rng(9).normal(size=(2500, 6))
    x[1000:1200] = x[:200]
    rows = L.numbered(table(spark, x, 1), "v", ["id"])
    near = L.neighbours(rows, 5)
    assert L.recall(rows, near, F.col("id") % 3 == 0, 5) == 1.0
    assert L.recall(rows, near.where("u % 2 = 0"), F.col("id") % 3 == 0, 5, block=100) < 0.7
