"""Rules that the small tables do not show: large and equal keys, NULL groups,
long conversations, odd FASTA files, width checks, pruned scans, models that
learn."""

import os
import random

import numpy as np
import pytest
from conftest import SF001
from pyspark.sql import functions as F

from helixframe.operators import metrics as M
from helixframe.operators import models as ML
from helixframe.operators import ranks, reshape, splits
from helixframe.operators import tokens as K
from helixframe.operators import vectors as V
from helixframe.plans import QUERIES, inputs
from helixframe.plans.inspect import plan_text
from helixframe.sources import readers as RD
from helixframe.sources import writers as WR


def test_pair_ids_of_long_conversations_are_unique(spark, tmp_dir):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}.{t}") for c in (1, 2) for t in range(2400)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(
        f"{tmp_dir}/conversations.parquet")
    p = inputs.pairs(spark, tmp_dir)
    assert p.count() == p.select("row_id").distinct().count() == 2400


def test_positions_with_large_and_equal_keys(spark):
    keys = [5, 5, 5, 2**41 + 1, 2**62, -3, 2**41, 0]
    df = spark.createDataFrame([(k, s) for k in keys for s in ("test", "train")], "k bigint, split string")
    got = [(r.split, r.k) for r in reshape.concat_splits(df, "k").orderBy("position").collect()]
    assert got == [("train", k) for k in sorted(keys)] + [("test", k) for k in sorted(keys)]
    pos = sorted(r.rn for r in ranks.ordinal_by_value(df, "k", n_buckets=4).collect())
    assert pos == list(range(16))


def test_null_is_a_group_in_splits_ranks_and_metrics(spark):
    rows = [(i, None if i % 2 else "a", i % 7, (i * 37 % 101) / 101, int(i % 3 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, g string, v int, score double, label int")
    held = splits.holdout(df, "id", 0.2, 7, ["g"]).groupBy("g", "split").count().collect()
    assert {(r.g, r.split): r["count"] for r in held} == {
        ("a", "test"): 20, ("a", "train"): 80, (None, "test"): 20, (None, "train"): 80}
    assert ranks.ordinal_by_hash(df.withColumn("h", F.md5(F.col("id").cast("string"))), "h", ["id"], ["g"]).count() == 200
    assert ranks.mid_ranks(df, "v", ["g"]).where("v_rank IS NULL").count() == 0
    assert {r.g: r.n for r in M.ranking_metrics(df, "score", "label", ["g"]).collect()} == {"a": 100, None: 100}
    reg = {r.g: r for r in M.regression_metrics(df, "v", "score", ["g"]).collect()}
    assert set(reg) == {"a", None} and reg[None].n == 100 and reg[None].spearman is not None


def test_many_groups_take_the_same_way(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 300).alias("g"))
    got = splits.holdout(df, "id", 0.25, 3, ["g"]).where("split = 'test'").groupBy("g").count()
    assert {r["count"] for r in got.collect()} == {3} and got.count() == 300


def test_expected_groups_must_have_rows(spark):
    df = spark.createDataFrame([(0, 0, "train", 1), (0, 0, "test", 0)], "repeat int, fold int, split string, label int")
    want = spark.createDataFrame([(0, 0, "test", 0), (0, 0, "test", 1)], df.schema)
    assert splits.split_sizes(df, expected=df).count() == 2
    with pytest.raises(ValueError, match="empty split group"):
        splits.split_sizes(df, expected=want)


FASTA = {"none.fa": "hello\nworld\n", "comment.fa": "; x > y\nACGT\n>id1 some words\nAC GT\nTT\n>id2\n",
         "crlf.fa": ">a  b c\r\nAC\r\nGT\r\n\r\n>d\r\nTT\r\n", "inner.fa": ">p > q\nA>C\n", "empty.fa": ""}


def test_both_fasta_modes_give_the_same_records(spark, tmp_dir):
    for name, text in FASTA.items():
        with open(f"{tmp_dir}/{name}", "w", newline="") as f:
            f.write(text)
    want = {("comment.fa", 0, "id1", "some words", "ACGTTT"), ("comment.fa", 1, "id2", "", ""),
            ("crlf.fa", 0, "a", "b c", "ACGT"), ("crlf.fa", 1, "d", "", "TT"), ("inner.fa", 0, "p", "> q", "A>C")}
    for whole in (False, True):
        rows = RD.read_fasta_all(spark, tmp_dir, whole).collect()
        assert {(os.path.basename(r.path), r.rec, r.id, r.description, r.seq) for r in rows} == want
        first = RD.read_fasta_first(spark, tmp_dir, whole).collect()
        assert {(os.path.basename(r.path), r.id) for r in first} == {("comment.fa", "id1"), ("crlf.fa", "a"), ("inner.fa", "p")}


def test_records_without_a_description_are_kept(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a", "ACGT", "first", "f"), (2, "b", "TT", None, "f")],
                               "n int, id string, seq string, descr string, file string")
    WR.write_fasta(df, f"{tmp_dir}/out", "id", "seq", "file", ["n"], "descr")
    assert {(r.id, r.seq) for r in RD.read_fasta_all(spark, f"{tmp_dir}/out").collect()} == {("a", "ACGT"), ("b", "TT")}


def test_a_large_fold_is_written_by_several_tasks(spark, tmp_dir):
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = spark.range(0, 120_000, numPartitions=16).select(
            F.col("id").alias("row_id"), F.lit("train").alias("split"), F.lit(0).alias("repeat"), (F.col("id") % 2).alias("fold"))
        WR.write_split_index(df, f"{tmp_dir}/idx")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    for fold in (0, 1):
        files = [f for f in os.listdir(f"{tmp_dir}/idx/repeat=0/fold={fold}") if f.endswith(".parquet")]
        assert len(files) > 1
        assert RD.read_split_index(spark, f"{tmp_dir}/idx", 0, fold).count() == 60_000


def test_a_model_refuses_rows_of_another_width(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>")
    with pytest.raises(Exception, match="rows of 2 values for a model of 3 weights"):
        V.score_batches(df, V.linear_loader([1.0, 1.0, 100.0]), "v", ["id"], ["score"]).collect()


def test_norm_and_softmax_of_wide_rows(spark):
    r = np.random.default_rng(1)
    rows = [r.normal(0, 1, 1280).tolist() for _ in range(20)] + [[0.0] * 1280]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "id int, v array<double>")
    for i, u in df.select("id", V.l2_normalize("v")).collect():
        x = np.array(rows[i])
        assert np.allclose(u, x / (np.linalg.norm(x) or 1))
    for i, p in df.select("id", M.softmax_at("v", 7)).collect():
        e = np.exp(np.array(rows[i]) - max(rows[i]))
        assert abs(p - e[7] / e.sum()) < 1e-12


def test_line_and_paragraph_separators_are_space(spark):
    df = spark.createDataFrame([("A b C dÉ",)], "t string")
    assert df.select(K.bert_pretokenize(K.bert_normalize("t"))).first()[0] == ["a", "b", "c", "de"]


@pytest.mark.parametrize("key", ["prj_07", "spl_08", "spl_09", "agg_04", "top_02", "flt_02"])
def test_queries_that_count_rows_do_not_read_texts(spark, key):
    text = plan_text(QUERIES[key](spark, SF001))
    reads = [ln for ln in text.splitlines() if "ReadSchema" in ln]
    assert not any(s in ln.split("ReadSchema")[1] for ln in reads for s in ("text:string",))


def separable(spark):
    r = random.Random(1)
    rows = [(i, i % 2, [r.gauss(3 if i % 2 else -3, 1) for _ in range(6)], "ab" * 20 if i % 2 else "cd" * 20) for i in range(400)]
    d = spark.createDataFrame(rows, "id bigint, y0 int, v array<double>, text string").withColumn("y", F.col("y0").cast("double"))
    return ML.features(splits.holdout(d, "id", 0.25, 5), "v")


@pytest.mark.parametrize("model", [lambda: ML.random_forest(10, 5, label="y"), lambda: ML.boosted_trees(0.1, 3, 5, label="y"),
                                   lambda: ML.dense_network(6, hidden=(8,), label="y"), lambda: ML.linear_head(label="y")])
def test_classifiers_learn(spark, model):
    d = separable(spark)
    pred = ML.fit_predict(d.where("split = 'train'"), d.where("split = 'test'"), model(), ["id", "y"])
    row = M.ranking_metrics(pred, "score", "y").first()
    assert row.n == 100 and row.auroc > 0.95


def test_regressor_and_folds_learn(spark):
    d = separable(spark)
    pred = ML.fit_predict(d.where("split = 'train'"), d.where("split = 'test'"), ML.random_forest(
        10, 5, regression=True, label="y"), ["id", "y"])
    assert M.regression_metrics(pred, "y", "prediction").first().mae < 0.1
    folded = splits.kfold(d.drop("features", "split"), "id", 3, 5)
    pred = ML.cross_validate(folded, "fold", lambda: ML.char_counts_then(ML.random_forest(10, 5, label="y")), ["id", "y"], 3)
    rows = M.ranking_metrics(pred, "score", "y", ["fold"]).collect()
    assert len(rows) == 3 and all(r.auroc > 0.95 for r in rows)


def test_projection_is_the_principal_axes(spark):
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (300, 5)) @ r.normal(0, 1, (5, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = np.array([[row.pc1, row.pc2] for row in V.project_2d(df, "v", ["id"]).orderBy("id").collect()])
    _, axes = np.linalg.eigh(np.cov(x.T))
    for k in (0, 1):
        want = x @ axes[:, -1 - k]
        assert min(np.abs(got[:, k] - want).max(), np.abs(got[:, k] + want).max()) < 1e-8


@pytest.mark.parametrize("regression", [False, True])
def test_forests_are_held_in_parts(spark, monkeypatch, regression):
    """No fit on the driver holds more trees than ``nodes_held`` nodes allow; the parts make up the whole forest."""
    d = separable(spark)
    train, test = d.where("split = 'train'"), d.where("split = 'test'")
    made = []
    forest = ML.random_forest(10, 5, regression=regression, label="y", nodes_held=1)
    monkeypatch.setattr(forest, "cls", lambda numTrees, seed, f=forest.cls, **how: made.append((numTrees, seed)) or f(numTrees=numTrees, seed=seed, **how))
    if regression:
        monkeypatch.setattr(ML, "RandomForestRegressor", forest.cls)
    pred = ML.fit_predict(train, test, forest, ["id", "y"])
    assert [n for n, _ in made] == [1] * 10 and len({s for _, s in made}) == 10
    assert sorted(r.id for r in pred.collect()) == sorted(r.id for r in test.collect())
    whole = ML.fit_predict(train, test, ML.random_forest(10, 5, label="y", nodes_held=1 << 30, regression=False), ["id", "y"])
    for p in (pred, whole):
        assert M.ranking_metrics(p, "score", "y").first().auroc > 0.95
        assert p.where("abs(prediction - y) > 0.5").count() <= 5


def test_texts_are_counted_once_over_training_characters(spark):
    rows = [(0, "abA\U0001f642"), (1, ""), (2, None), (3, "zb")]
    df = spark.createDataFrame(rows, "i int, text string")
    counts = ML.char_counts_then(None)
    train, test = counts.vectors(counts.prepared(df.where("i < 3")), counts.prepared(df.where("i = 3")))
    got = {r.i: r.features for r in train.collect()}
    assert np.allclose(got[0].toArray(), np.array([2, 1, 1]) / 6 ** 0.5) and not got[1].toArray().any() and not got[2].toArray().any()
    assert test.first().features.toArray().tolist() == [0.0, 1.0, 0.0]      # z is no character of the training rows
