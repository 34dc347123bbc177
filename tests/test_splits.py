"""Splits and ordinals (SPL, WIN-02)."""

import math

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from helixframe.operators import ranks, reshape, splits


def fold_sizes(df):
    return sorted((r.fold, r.n) for r in df.groupBy("fold").agg(F.count("*").alias("n")).collect())


def test_kfold_size_arithmetic(spark):
    for n, k in [(230456, 5), (5559, 5), (11, 5), (7, 3)]:
        a = splits.kfold(spark.range(n).withColumnRenamed("id", "row_id"), "row_id", k, seed=1234)
        sizes = [s for _, s in fold_sizes(a)]
        q, r = divmod(n, k)
        assert sizes == [q + 1] * r + [q] * (k - r), (n, sizes)
        assert a.count() == n and a.select("row_id").distinct().count() == n


def test_reference_split_sizes_fold0(spark):
    # 230,456 pairs -> 460,912 labelled rows; fold 0 has 46,092 test pairs
    n, k = 230456, 5
    a = splits.kfold(spark.range(n).withColumnRenamed("id", "row_id"), "row_id", k)
    test_pairs = a.where("fold = 0").count()
    assert test_pairs * 2 == 92184  # reference test size in labelled rows


def test_ordinal_equals_global_row_number(spark):
    df = spark.range(5000).withColumnRenamed("id", "k").withColumn("h", ranks.hash_key(7, "k"))
    got = ranks.ordinal_by_hash(df, "h", ["k"]).select("k", "rn")
    want = df.select("k", (F.row_number().over(Window.orderBy("h", "k")) - 1).alias("rn"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_repeats_use_distinct_seeds(spark):
    base = spark.range(200).withColumnRenamed("id", "row_id")
    a = splits.kfold(base, "row_id", 5, seed=1, repeats=2)
    f0 = {r.row_id: r.fold for r in a.where("repeat = 0").collect()}
    f1 = {r.row_id: r.fold for r in a.where("repeat = 1").collect()}
    assert f0 != f1
    same = splits.kfold(base, "row_id", 5, seed=1, repeats=2, same_seed=True)
    g0 = {r.row_id: r.fold for r in same.where("repeat = 0").collect()}
    g1 = {r.row_id: r.fold for r in same.where("repeat = 1").collect()}
    assert g0 == g1


def test_every_row_test_once_and_pairs_not_split(spark):
    pairs = spark.range(101).select(F.col("id").alias("row_id"), F.lit("A").alias("a"), F.lit("B").alias("b"))
    idx = splits.split_index(splits.kfold(pairs.select("row_id"), "row_id", 5), "row_id", 5)
    per_row = idx.where("split = 'test'").groupBy("row_id").count()
    assert per_row.where("count != 1").count() == 0 and per_row.count() == 101
    lab = reshape.attach_splits(reshape.unpivot_pairs(pairs, "a", "b"), idx)
    assert splits.pair_leaks(lab).where("n_leaks > 0").count() == 0


def test_holdout_ceil(spark):
    d = spark.range(230).withColumnRenamed("id", "k")
    assert splits.holdout(d, "k", 0.1).where("split = 'test'").count() == 23
    d = spark.range(231).withColumnRenamed("id", "k")
    assert splits.holdout(d, "k", 0.1).where("split = 'test'").count() == 24


def test_nested_ratio(spark):
    d = spark.range(10000).withColumnRenamed("id", "k")
    stated = {r.split: r["count"] for r in splits.nested_holdout(d, "k", 0.025, 0.25).groupBy("split").count().collect()}
    ref = {r.split: r["count"] for r in splits.nested_holdout(d, "k", 0.025, 0.25, nested_ratio="reference").groupBy("split").count().collect()}
    held = math.ceil(0.275 * 10000)
    assert stated["valid"] == math.ceil(held * 0.025 / 0.275)
    assert ref["valid"] == math.ceil(held * 0.1)  # 2.75% of all rows, the reference's arithmetic
    assert sum(stated.values()) == 10000 and stated["train"] == 10000 - held


def test_kfold_with_valid_sizes(spark):
    p = spark.range(100).withColumnRenamed("id", "row_id")
    idx = splits.split_index(splits.kfold(p, "row_id", 5), "row_id", 5)
    v = splits.kfold_with_valid(idx, "row_id", 0.1)
    c = {(r.fold, r.split): r["count"] for r in v.groupBy("fold", "split").count().collect()}
    for f in range(5):
        assert c[(f, "test")] == 20 and c[(f, "valid")] == 8 and c[(f, "train")] == 72


def test_range_subset_bounds(spark):
    import pytest
    d = spark.range(10).withColumnRenamed("id", "pos")
    assert splits.range_subset(d, "pos", 2, 5, 10).count() == 3
    with pytest.raises(ValueError):
        splits.range_subset(d, "pos", 8804, 9694, 10)  # the reference's overrun


def test_exact_sample_size_and_seed(spark):
    d = spark.range(1000).withColumnRenamed("id", "k")
    a = [r.k for r in splits.exact_sample(d, "k", 100, seed=3).collect()]
    b = [r.k for r in splits.exact_sample(d, "k", 100, seed=3).collect()]
    assert len(a) == 100 and len(set(a)) == 100 and sorted(a) == sorted(b)


def test_same_result_at_1_and_200_partitions(spark):
    d = spark.range(3000).withColumnRenamed("id", "row_id")
    res = []
    for n in (1, 200):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        res.append(sorted(tuple(r) for r in splits.kfold(d, "row_id", 5).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert res[0] == res[1]


def test_batches_keep_every_row(spark):
    d = spark.range(1003).withColumnRenamed("id", "k")
    b = reshape.batches(d, "k", 8)
    sizes = sorted(r["count"] for r in b.groupBy("batch_id").count().collect())
    assert sum(sizes) == 1003 and sizes[0] == 3 and sizes[-1] == 8


def test_duplicate_keys_stay_together(spark):
    # a group of copies (one key on a third of the rows) lands in one fold
    d = spark.range(300).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("row_id"))
    a = splits.kfold(d, "row_id", 5)
    assert a.where("row_id = -1").select("fold").distinct().count() == 1
    assert a.count() == 300


def test_holdout_many_groups_uses_join_path(spark):
    d = spark.range(20000).select(F.col("id").alias("k"), (F.col("id") % 100).alias("g"))
    h = splits.holdout(d, "k", 0.1, partition_cols=["g"])   # 100 groups > CASE limit
    per = {r.g: r["count"] for r in h.where("split = 'test'").groupBy("g").count().collect()}
    assert len(per) == 100 and set(per.values()) == {20}
    few = splits.holdout(d.where("g < 10"), "k", 0.1, partition_cols=["g"])
    both = h.where("g < 10").select("k", "split").exceptAll(few.select("k", "split")).count()
    assert both == 0


@pytest.mark.parametrize("n_pairs, folds, sizes", [
    (230456, [0], (331854, 36874, 92184)),          # train / valid / test labelled rows, fold 0
    (5559, [0, 1, 2, 3], (8004, 890, 2224)),         # the same for folds 0-3
])
def test_reference_split_sizes_with_valid(spark, n_pairs, folds, sizes):
    p = spark.range(n_pairs).withColumnRenamed("id", "row_id")
    idx = splits.split_index(splits.kfold(p, "row_id", 5), "row_id", 5)
    v = splits.kfold_with_valid(idx, "row_id", 0.1)
    got = {(r.fold, r.split): r["count"] * 2 for r in v.groupBy("fold", "split").count().collect()}
    for f in folds:
        assert (got[(f, "train")], got[(f, "valid")], got[(f, "test")]) == sizes


def test_batch_rows_in_order(spark):
    d = spark.range(10).select((F.col("id") * 7 % 10).alias("k"), (F.col("id") * 2).alias("v"))
    got = {r.batch_id: [x.k for x in r.rows] for r in reshape.batch_rows(d, "k", 4, ["k", "v"]).collect()}
    assert got == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7], 2: [8, 9]}
