"""Ranking and regression metrics against brute force (MET, AGG, WIN)."""

import math
import random

from pyspark.sql import functions as F

from helixframe.operators import metrics as M
from helixframe.operators import ranks


def brute_auroc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y == 0]
    if not pos or not neg:
        return None
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def brute_ap(ys, ss):
    P = sum(ys)
    if P == 0 or P == len(ys):
        return None
    ap = 0.0
    for t in sorted(set(ss), reverse=True):
        sel = [y for y, s in zip(ys, ss) if s >= t]
        at = [y for y, s in zip(ys, ss) if s == t]
        ap += (sum(at) / P) * (sum(sel) / len(sel))
    return ap


def metric(spark, ys, ss, n_buckets=4):
    df = spark.createDataFrame([(int(y), float(s)) for y, s in zip(ys, ss)], "label int, score double")
    r = M.ranking_metrics(df, "score", "label", n_buckets=n_buckets).first()
    return r.auroc, r.ap


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_fixture_cases(spark):
    assert metric(spark, [1, 0, 1, 0], [0.3] * 4) == (0.5, 0.5)          # all equal
    assert metric(spark, [1, 1, 0, 0], [0.9, 0.8, 0.2, 0.1]) == (1.0, 1.0)  # perfect
    a, _ = metric(spark, [1, 1, 0, 0], [0.1, 0.2, 0.8, 0.9])
    assert a == 0.0                                                       # reversed
    assert metric(spark, [1, 1, 1], [0.1, 0.5, 0.9]) == (None, None)      # one class


def test_random_with_ties_matches_brute_force(spark):
    rng = random.Random(5)
    ys = [rng.randint(0, 1) for _ in range(300)]
    ss = [rng.randint(0, 20) / 20 for _ in range(300)]
    a, p = metric(spark, ys, ss, n_buckets=8)
    assert close(a, brute_auroc(ys, ss)) and close(p, brute_ap(ys, ss))


def test_auroc_symmetry(spark):
    rng = random.Random(9)
    ys = [rng.randint(0, 1) for _ in range(200)]
    ss = [rng.random() for _ in range(200)]
    a1, _ = metric(spark, ys, ss)
    a2, _ = metric(spark, ys, [-s for s in ss])
    assert abs(a1 + a2 - 1) < 1e-12


def test_hot_score_third_of_rows(spark):
    # one score value holds a third of the rows: grouped before the window
    rng = random.Random(3)
    ys = [rng.randint(0, 1) for _ in range(3000)]
    ss = [0.5 if i % 3 == 0 else rng.random() for i in range(3000)]
    a, p = metric(spark, ys, ss, n_buckets=16)
    assert close(a, brute_auroc(ys, ss)) and close(p, brute_ap(ys, ss))


def test_grouped_metrics(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.1), ("b", 0, 0.9), ("c", 1, 0.5)]
    df = spark.createDataFrame(rows, "g string, label int, score double")
    got = {r.g: r.auroc for r in M.ranking_metrics(df, "score", "label", ["g"]).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": None}


def test_softmax_no_overflow(spark):
    df = spark.createDataFrame([(800.0, 0.0), (0.0, 800.0), (1.0, 1.0)], "l0 double, l1 double")
    got = [r[0] for r in df.select(M.positive_softmax("l0", "l1")).collect()]
    assert got[0] < 1e-300 and got[1] == 1.0 and got[2] == 0.5
    arr = spark.createDataFrame([([800.0, 801.0],)], "l array<double>")
    v = arr.select(M.softmax_at("l", 1)).first()[0]
    assert abs(v - 1 / (1 + math.exp(-1))) < 1e-12


def test_column_softmax_sums_to_one(spark):
    df = spark.createDataFrame([(float(i),) for i in range(50)], "l double")
    s = M.column_softmax(df, "l").agg(F.sum("score")).first()[0]
    assert abs(s - 1) < 1e-12


def test_argmax_first_max(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "l array<double>")
    assert df.select(M.argmax("l")).first()[0] == 1


def brute_spearman(x, y):
    def mid(v):
        order = sorted(range(len(v)), key=lambda i: v[i])
        r = [0.0] * len(v)
        i = 0
        while i < len(v):
            j = i
            while j + 1 < len(v) and v[order[j + 1]] == v[order[i]]:
                j += 1
            for k in range(i, j + 1):
                r[order[k]] = (i + j) / 2 + 1
            i = j + 1
        return r
    rx, ry = mid(x), mid(y)
    mx, my = sum(rx) / len(rx), sum(ry) / len(ry)
    cov = sum((a - mx) * (b - my) for a, b in zip(rx, ry))
    vx = sum((a - mx) ** 2 for a in rx)
    vy = sum((b - my) ** 2 for b in ry)
    return cov / math.sqrt(vx * vy) if vx and vy else None


def reg(spark, ys, ps):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(ys, ps)], "y double, p double")
    return M.regression_metrics(df, "y", "p", n_buckets=4).first()


def test_regression_fixture_cases(spark):
    rng = random.Random(1)
    ys = [rng.randint(0, 5) for _ in range(200)]
    ps = [rng.randint(0, 5) for _ in range(200)]
    r = reg(spark, ys, ps)
    assert abs(r.spearman - brute_spearman(ys, ps)) < 1e-9
    assert abs(r.mae - sum(abs(a - b) for a, b in zip(ys, ps)) / 200) < 1e-12
    assert abs(r.rmse - math.sqrt(sum((a - b) ** 2 for a, b in zip(ys, ps)) / 200)) < 1e-12
    assert reg(spark, [1, 2, 3], [5, 5, 5]).spearman is None       # constant column
    assert abs(reg(spark, [1, 2, 3, 4], [10, 20, 35, 90]).spearman - 1.0) < 1e-12  # monotone


def test_mid_ranks(spark):
    df = spark.createDataFrame([(v,) for v in [3, 1, 3, 2, 3]], "v int")
    got = sorted((r.v, r.v_rank) for r in ranks.mid_ranks(df, "v", n_buckets=2).collect())
    assert got == [(1, 1.0), (2, 2.0), (3, 4.0), (3, 4.0), (3, 4.0)]


def test_running_totals_exclusive(spark):
    df = spark.createDataFrame([(v, 1) for v in [5, 1, 5, 3]], "v int, one int")
    got = sorted((r.v, r.cum_one) for r in ranks.running_totals(df, "v", ["one"], n_buckets=2, exclusive=True).collect())
    assert got == [(1, 0), (3, 1), (5, 2), (5, 2)]


def test_best_epoch_earlier_wins(spark):
    df = spark.createDataFrame([("m", 1, 0.5), ("m", 2, 0.9), ("m", 3, 0.9)], "model string, epoch int, score double")
    r = M.best_epoch(df).first()
    assert r.best_epoch == 2 and r.best_score == 0.9


def test_prefix_mean_two_tasks(spark):
    df = spark.createDataFrame([("m", 1, "auroc [a]", 0.6), ("m", 1, "auroc [b]", 0.8), ("m", 1, "auprc [a]", 0.1)],
                               "model string, epoch int, metric string, value double")
    assert abs(M.prefix_mean(df, "auroc").first().score - 0.7) < 1e-12


def test_confusion_balanced_accuracy(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "label int, pred int")
    r = M.confusion(df, "pred", "label").first()
    assert (r.tp, r.fn, r.tn, r.fp) == (1, 1, 2, 0) and r.auroc == 0.75
    a, _ = metric(spark, [1, 1, 0, 0], [1, 0, 0, 0])
    assert a == 0.75


def test_exclusive_prefix_sum(spark):
    df = spark.createDataFrame([(0, 1, 3), (0, 2, 4), (1, 3, 5)], "b int, id int, size int")
    got = sorted((r.id, r.offset) for r in ranks.exclusive_prefix_sum(df, "size", ["id"], ["b"]).collect())
    assert got == [(1, 0), (2, 3), (3, 0)]


def test_spearman_with_hot_value(spark):
    rng = random.Random(4)
    ys = [7 if i % 3 == 0 else rng.randint(0, 50) for i in range(3000)]
    ps = [rng.randint(0, 50) if i % 3 else 7 for i in range(3000)]
    r = reg(spark, ys, ps)
    assert abs(r.spearman - brute_spearman(ys, ps)) < 1e-9


def test_metrics_same_at_1_and_200_partitions(spark):
    rng = random.Random(8)
    rows = [(rng.choice("abc"), rng.randint(0, 1), rng.randint(0, 30) / 30) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, label int, score double")
    res = []
    for n in (1, 200):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        res.append(sorted((r.g, round(r.auroc, 12), round(r.ap, 12))
                          for r in M.ranking_metrics(df, "score", "label", ["g"]).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert res[0] == res[1]
