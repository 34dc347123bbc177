"""Queries: vectors, batch scoring and Spark ML baselines (VEC, JON-05, ML)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from helixframe.operators import layout as L
from helixframe.operators import metrics as M
from helixframe.operators import models as ML
from helixframe.operators import splits
from helixframe.operators import vectors as V
from helixframe.plans.inputs import SEED, kfold_sql
from helixframe.plans.registry import query, table

R = 6
_EMB = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")


@query("vec_01", f"""
WITH {_EMB}, n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e),
u AS (SELECT vec_id, CASE WHEN norm > 0 THEN list_transform(v, lambda x: x / norm) ELSE v END AS u FROM n)
SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), {R}) AS norm_after,
       round(list_sum(list_transform(range(len(u)), lambda j: u[j + 1] * (j + 1))), {R}) AS weighted_sum
FROM u
""")
def vec_01(spark, sf_dir):
    """Unit L2 norm per embedding; zero rows unchanged."""
    u = _emb(spark, sf_dir).select("vec_id", V.l2_normalize("embedding").alias("u"))
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x))
    ws = F.aggregate(F.transform("u", lambda x, j: x * (j + 1)), F.lit(0.0), lambda a, x: a + x)
    return u.select("vec_id", F.round(norm, R).alias("norm_after"), F.round(ws, R).alias("weighted_sum"))


_CHUNKS = "list_transform(range(8), lambda i: v[i * 8 + 1: i * 8 + 8])"


@query("vec_02", f"""
WITH {_EMB}, c AS (SELECT vec_id, {_CHUNKS} AS pos FROM e)
SELECT vec_id, round(list_sum(pos[1]), {R}) AS first_sum, round(pos[1][1], {R}) AS first_value FROM c
""")
def vec_02(spark, sf_dir):
    """First-position vector of each row viewed as 8 positions x 8 dims."""
    d = _emb(spark, sf_dir).select("vec_id", V.chunk_positions(F.transform("embedding", lambda x: x.cast("double")), 8).alias("pos"))
    first = V.first_position("pos")
    return d.select("vec_id", F.round(F.aggregate(first, F.lit(0.0), lambda a, x: a + x), R).alias("first_sum"),
                    F.round(F.element_at(first, 1), R).alias("first_value"))


@query("vec_03", f"""
WITH {_EMB}, x AS (SELECT label, unnest(range(len(v))) AS dim, unnest(v) AS val FROM e)
SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(val), {R}) AS mean FROM x GROUP BY label, dim
""")
def vec_03(spark, sf_dir):
    """Mean readout: the mean embedding of each label (Summarizer)."""
    m = V.group_mean(_emb(spark, sf_dir), "embedding", ["label"])
    return m.select("label", F.posexplode("mean").alias("dim", "mean")).select(
        "label", F.col("dim").cast("int"), F.round("mean", R).alias("mean"))


def _linear_loader():
    w = np.array([((j % 7) - 3) / 10.0 for j in range(64)])
    return lambda x: x @ w + 0.1


def _two_class_loader():
    w0 = np.array([((j % 5) - 2) / 10.0 for j in range(64)])
    w1 = np.array([((j % 3) - 1) / 10.0 for j in range(64)])
    return lambda x: np.stack([x @ w0, x @ w1], axis=1)


@query("vec_04", f"""
WITH {_EMB}
SELECT vec_id, label, round(list_sum(list_transform(range(len(v)), lambda j: v[j + 1] * ((j % 7) - 3) / 10.0)) + 0.1, {R}) AS score
FROM e
""")
def vec_04(spark, sf_dir):
    """Score every embedding with a loaded (here linear) model in Arrow
    batches of 64 rows; ids and labels travel with the rows."""
    s = V.score_batches(_emb(spark, sf_dir), _linear_loader, "embedding", ["vec_id", "label"], ["score"],
                        batch_size=64)
    return s.select("vec_id", "label", F.round("score", R).alias("score"))


@query("jon_05", f"""
WITH {_EMB}, l AS (SELECT vec_id, label,
  list_sum(list_transform(range(len(v)), lambda j: v[j + 1] * ((j % 5) - 2) / 10.0)) AS l0,
  list_sum(list_transform(range(len(v)), lambda j: v[j + 1] * ((j % 3) - 1) / 10.0)) AS l1 FROM e)
SELECT vec_id, label, CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS pred, round(greatest(l0, l1), {R}) AS max_logit FROM l
""")
def jon_05(spark, sf_dir):
    """Predictions collected with their ids: two logits per row, predicted
    class and winning logit."""
    s = V.score_batches(_emb(spark, sf_dir), _two_class_loader, "embedding", ["vec_id", "label"], ["l0", "l1"])
    lg = F.array("l0", "l1")
    return s.select("vec_id", "label", M.argmax(lg).alias("pred"), F.round(F.array_max(lg), R).alias("max_logit"))


@query("vec_05", """
SELECT label, count(*) AS n_rows, true AS in_order, true AS uncorrelated, true AS best_axis FROM embeddings GROUP BY label
""")
def vec_05(spark, sf_dir):
    """2-D projection of the embeddings (PCA; UMAP re-aimed): rows per label,
    and what must hold of principal axes over all rows: the first explains at
    least as much as the second, they are uncorrelated, and the first explains
    at least as much as any single dimension."""
    p = V.project_2d(_emb(spark, sf_dir), "embedding", ["vec_id", "label"])
    facts = p.agg(F.var_pop("pc1").alias("v1"), F.var_pop("pc2").alias("v2"), F.covar_pop("pc1", "pc2").alias("c")).first()
    dims = _emb(spark, sf_dir).select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(
        F.var_pop(F.col("x").cast("double")).alias("v")).agg(F.max("v")).first()[0]
    held = [facts["v1"] >= facts["v2"], abs(facts["c"]) <= 1e-6 * facts["v1"], facts["v1"] >= dims * (1 - 1e-9)] \
        if dims is not None else [True] * 3
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "label", "n_rows", *[F.lit(bool(x)).alias(n) for n, x in zip(("in_order", "uncorrelated", "best_axis"), held)])


@query("vec_05_layout", """
SELECT label, count(*) AS n_rows, count(*) FILTER (WHERE vec_id % 20 = 0) AS n_probes, true AS finite, true AS recall_ok
FROM embeddings GROUP BY label
""")
def vec_05_layout(spark, sf_dir):
    """Neighbour layout of the embeddings in the plane: rows per label, whether all places are finite, and
    whether the graph holds at least 0.9 of the 15 nearest rows of the probes
    (every row whose id is divisible by 20), found by comparing the probes
    with all rows in blocks."""
    rows = L.numbered(_emb(spark, sf_dir), "embedding", ["vec_id", "label"])
    near = L.neighbours(rows, 15)
    placed = L.layout(rows, "v", ["vec_id", "label"], k=15, steps=8, edges=near)
    ok = L.recall(rows, near, F.col("vec_id") % 20 == 0, 15) >= 0.9
    fine = ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < 1e6) & (F.abs("y") < 1e6)
    return placed.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("vec_id") % 20 == 0, 1)).alias("n_probes"),
                                       F.min(fine).alias("finite")).withColumn("recall_ok", F.lit(ok))


@query("vec_03_positions", f"""
WITH {_EMB}, c AS (SELECT vec_id, {_CHUNKS} AS pos FROM e),
x AS (SELECT vec_id, unnest(range(8)) AS dim, pos FROM c),
s AS (SELECT vec_id, dim, list_sum(list_transform(pos, lambda p: p[dim + 1])) AS total FROM x)
SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(total, {R}) AS sum, round(total / 8, {R}) AS mean FROM s
""")
def vec_03_positions(spark, sf_dir):
    """Sum and mean readout over the positions of each row (8 positions x 8
    dims)."""
    d = _emb(spark, sf_dir).select("vec_id", V.chunk_positions(F.transform("embedding", lambda x: x.cast("double")), 8).alias("pos"))
    both = F.arrays_zip(V.readout("pos", "sum").alias("sum"), V.readout("pos", "mean").alias("mean"))
    return d.select("vec_id", F.posexplode(both).alias("dim", "r")).select(
        "vec_id", F.col("dim").cast("int"), F.round("r.sum", R).alias("sum"), F.round("r.mean", R).alias("mean"))


# ---------------- Spark ML ----------------

# Fitted values have no SQL twin.  The labels are a rule on the embedding that
# a model can learn, so besides the rows held out and scored and their positives (which SQL
# computes) each query returns whether every score is in range and whether the
# model ranks the rows it never saw: held-out AUROC (or correlation) above a bound far from chance.

_HELD_SQL = f"""
WITH r AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE) AS v,
                  row_number() OVER (ORDER BY md5(concat('{SEED}', ':', CAST(vec_id AS VARCHAR))), vec_id) - 1 AS rn,
                  count(*) OVER () AS n FROM embeddings),
held AS (SELECT vec_id, v, CASE WHEN v > 0 THEN 1 ELSE 0 END AS y FROM r WHERE rn < CAST(ceil(0.2 * n) AS BIGINT))
"""
_RULE_SQL = _HELD_SQL + """
SELECT count(*) AS n, CAST(coalesce(sum(y), 0) AS BIGINT) AS n_pos, count(*) AS n_scored, true AS in_range, true AS learned FROM held
"""
LEARNED = 0.75


def _rule_value():
    return F.col("embedding")[0].cast("double") + F.col("embedding")[1].cast("double")


def _held_out(spark, sf_dir, model, label):
    d = ML.features(_emb(spark, sf_dir).withColumn("y", label.cast("double")), "embedding")
    f = splits.holdout(d, "vec_id", 0.2, SEED)
    return ML.fit_predict(f.where("split = 'train'"), f.where("split = 'test'"), model, ["vec_id", "y"])


def _facts(pred, *by):
    scored = F.col("score").isNotNull() & F.col("prediction").isNotNull()
    return pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).cast("long").alias("n_pos"),
        F.count(F.when(scored, 1)).alias("n_scored"),
        F.coalesce(F.min(F.col("score").between(0, 1) & F.col("prediction").isin(0.0, 1.0)), F.lit(True)).alias("in_range"))


def _rule(pred):
    """Facts of the held-out rows, with whether the scores rank them; a
    table with one class has nothing to rank."""
    auroc = M.ranking_metrics(pred, "score", "y").first()
    learned = auroc is None or auroc["auroc"] is None or auroc["auroc"] > LEARNED
    return _facts(pred).withColumn("learned", F.lit(learned))


@query("ml_01", _RULE_SQL)
def ml_01(spark, sf_dir):
    """Random forest, 100 trees, depth 25, on a rule of the embedding."""
    return _rule(_held_out(spark, sf_dir, ML.random_forest(100, 25, label="y"), (_rule_value() > 0).cast("int")))


@query("ml_02", _HELD_SQL + """
SELECT count(*) AS n, round(coalesce(sum(v), 0), 6) AS value_sum, count(*) AS n_scored, true AS in_range, true AS learned FROM held
""")
def ml_02(spark, sf_dir):
    """Random forest regressor (100 trees) on a sum of the embedding's
    components; a mean of labels lies within their range."""
    pred = _held_out(spark, sf_dir, ML.random_forest(100, 25, regression=True, label="y"), _rule_value())
    span = _emb(spark, sf_dir).agg(F.min(_rule_value()), F.max(_rule_value())).first()
    inside = F.col("prediction").between(float(span[0] or 0) - 1e-9, float(span[1] or 0) + 1e-9)
    return pred.agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("y"), F.lit(0.0)), 6).alias("value_sum"),
                    F.count("prediction").alias("n_scored"), F.coalesce(F.min(inside), F.lit(True)).alias("in_range"),
                    F.coalesce(F.corr("prediction", "y") > 0.5, F.lit(True)).alias("learned"))


@query("ml_03", _RULE_SQL)
def ml_03(spark, sf_dir):
    """Boosted trees (rate 0.1, depth 25, 100 trees) on a rule of the embedding."""
    return _rule(_held_out(spark, sf_dir, ML.boosted_trees(0.1, 25, label="y"), (_rule_value() > 0).cast("int")))


@query("ml_04", _RULE_SQL)
def ml_04(spark, sf_dir):
    """Dense network 64-32-64-128-64-32-1 on a rule of the embedding."""
    return _rule(_held_out(spark, sf_dir, ML.dense_network(64, label="y"), (_rule_value() > 0).cast("int")))


@query("ml_05", _RULE_SQL)
def ml_05(spark, sf_dir):
    """Two-layer head on frozen embeddings; the epoch of least loss on a
    quarter of the training rows is kept."""
    d = ML.features(_emb(spark, sf_dir).withColumn("y", (_rule_value() > 0).cast("double")), "embedding")
    f = splits.holdout(d, "vec_id", 0.2, SEED)
    train, test = f.where("split = 'train'").drop("split"), f.where("split = 'test'")
    inner = splits.holdout(train, "vec_id", 0.25, SEED + 1)
    head = ML.mlp_head(64, label="y", validation=inner.where("split = 'test'"))
    return _rule(ML.fit_predict(inner.where("split = 'train'"), test, head, ["vec_id", "y"]))


@query("ml_05_linear", _RULE_SQL)
def ml_05_linear(spark, sf_dir):
    """Linear head on frozen embeddings."""
    return _rule(_held_out(spark, sf_dir, ML.linear_head(label="y"), (_rule_value() > 0).cast("int")))


@query("ml_06", f"""
WITH l AS (SELECT l.doc_id, l.quality FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
f AS ({kfold_sql('l', 'doc_id', 5, SEED)})
SELECT fold, count(*) AS n, CAST(sum(quality) AS BIGINT) AS n_pos, count(*) AS n_scored, true AS in_range FROM f GROUP BY fold
""")
def ml_06(spark, sf_dir):
    """5-fold cross-validation of a random forest on whole texts (documents
    with quality labels): per fold the character vocabulary is fitted on the
    training rows alone, texts become counts over it with unit L2 norm."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    lab = table(spark, sf_dir, "labels", "doc_id", "quality")
    d = lab.join(docs, "doc_id").select("doc_id", F.col("quality").cast("double").alias("y"), "text")
    d = splits.kfold(d, "doc_id", 5, SEED)
    pred = ML.cross_validate(d, "fold", lambda: ML.char_counts_then(ML.random_forest(100, 25, label="y")), ["doc_id", "y"], 5)
    return _facts(pred, "fold")
