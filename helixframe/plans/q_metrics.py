"""Queries: scores, ranking and regression metrics, metric tables, windows
(MET, AGG, TOP-01/02, WIN-01/03/04, UDF-03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import metrics as M
from helixframe.operators import reshape, splits
from helixframe.operators.ranks import exclusive_prefix_sum, mid_ranks
from helixframe.plans.inputs import (METRIC_RECORDS_SQL, PAIRS_SQL, REGRESSION_SQL, SCORED_SQL,
                                     labelled_sql, metric_records, pairs, regression, scored)
from helixframe.plans.registry import query, table

R = 6  # decimals kept for floating results on both sides


def _r(c, d: int = R):
    return F.round(c, d)


_S = f"s AS ({SCORED_SQL})"


@query("met_01", f"""
WITH {_S}
SELECT doc_id, label, round(1.0 / (1.0 + exp(0.0 - logit1)), {R}) AS prob FROM s
""")
def met_01(spark, sf_dir):
    """Positive-class softmax of the logits (0, logit1)."""
    s = scored(spark, sf_dir)
    return s.select("doc_id", "label", _r(M.positive_softmax(F.lit(0.0), F.col("logit1"))).alias("prob"))


@query("met_02", f"""
WITH {_S}, m AS (SELECT max(logit1) AS mx FROM s),
t AS (SELECT sum(exp(logit1 - mx)) AS tot FROM s, m)
SELECT doc_id, label, round(exp(logit1 - mx) / tot, 9) AS col_softmax FROM s, m, t
""")
def met_02(spark, sf_dir):
    """Softmax down the logit column (axis 0): two scalar subqueries."""
    s = M.column_softmax(scored(spark, sf_dir), "logit1", out="col_softmax")
    return s.select("doc_id", "label", _r(F.col("col_softmax"), 9).alias("col_softmax"))


def _rank_sql(src: str, grp: str | None) -> str:
    """SQL twin of ``ranking_metrics``: one row per distinct score, running
    totals by a RANGE window, then the AUROC and AP sums."""
    gsel = f"{grp}, " if grp else ""
    gby = f"GROUP BY {grp}" if grp else ""
    part = f"PARTITION BY {grp} " if grp else ""
    return f"""
WITH {src},
g AS (SELECT {gsel}score, CAST(sum(label) AS BIGINT) AS p, CAST(sum(1 - label) AS BIGINT) AS n
      FROM s GROUP BY {gsel}score),
c AS (SELECT *, sum(p) OVER ({part}ORDER BY score DESC) AS tp,
                sum(n) OVER ({part}ORDER BY score DESC) AS fp FROM g),
m AS (SELECT {gsel}CAST(sum(p) + sum(n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS n_pos,
             CASE WHEN sum(p) > 0 AND sum(n) > 0
                  THEN round(sum(n * (tp - p) + n * p / 2.0) / (sum(p) * sum(n)), {R}) END AS auroc,
             CASE WHEN sum(p) > 0 AND sum(n) > 0
                  THEN round(sum(CASE WHEN p > 0 THEN p * tp / (tp + fp) ELSE 0 END) / sum(p), {R}) END AS ap
      FROM c {gby})
"""


def _ranking(spark, sf_dir):
    m = M.ranking_metrics(scored(spark, sf_dir), "score", "label", ["lang"])
    return m.select("lang", "n", "n_pos", _r(F.col("auroc")).alias("auroc"), _r(F.col("ap")).alias("ap"))


@query("met_03", _rank_sql(_S, "lang") + "SELECT lang, n, n_pos, auroc FROM m")
def met_03(spark, sf_dir):
    """Exact AUROC per language (ties at half weight)."""
    return _ranking(spark, sf_dir).select("lang", "n", "n_pos", "auroc")


_S_NULL = f"s0 AS ({SCORED_SQL}), s AS (SELECT nullif(lang, 'de') AS grp, label, score FROM s0)"


@query("met_03_nullgroup", _rank_sql(_S_NULL, "grp") + "SELECT grp, n, n_pos, auroc, ap FROM m")
def met_03_nullgroup(spark, sf_dir):
    """AUROC and average precision per language, where one language is NULL."""
    s = scored(spark, sf_dir).select(F.expr("nullif(lang, 'de')").alias("grp"), "label", "score")
    m = M.ranking_metrics(s, "score", "label", ["grp"])
    return m.select("grp", "n", "n_pos", _r(F.col("auroc")).alias("auroc"), _r(F.col("ap")).alias("ap"))


@query("met_04", _rank_sql(_S, "lang") + "SELECT lang, ap FROM m")
def met_04(spark, sf_dir):
    """Average precision per language (step sum over distinct thresholds)."""
    return _ranking(spark, sf_dir).select("lang", "ap")


_HARD_SRC = f"s0 AS ({SCORED_SQL}), s AS (SELECT lang, label, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS score FROM s0)"


@query("met_05", _rank_sql(_HARD_SRC, "lang") + f"""
, cf AS (SELECT lang,
        CAST(sum(CASE WHEN label = 1 AND score = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
        CAST(sum(CASE WHEN label = 0 AND score = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
        CAST(sum(CASE WHEN label = 0 AND score = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
        CAST(sum(CASE WHEN label = 1 AND score = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn
        FROM s GROUP BY lang)
SELECT cf.lang, tp, fp, tn, fn,
       CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN round((tp / (tp + fn) + tn / (tn + fp)) / 2, {R}) END AS balanced_acc,
       m.auroc, m.ap
FROM cf JOIN m ON cf.lang = m.lang
""")
def met_05(spark, sf_dir):
    """AUROC and AP of hard 0/1 predictions (score >= 0.5); AUROC equals the
    balanced accuracy from the confusion counts."""
    s = scored(spark, sf_dir).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    cf = M.confusion(s, "pred", "label", ["lang"]).withColumnRenamed("auroc", "balanced_acc")
    rk = M.ranking_metrics(s, "pred", "label", ["lang"])
    return cf.join(rk.select("lang", "auroc", "ap"), "lang").select(
        "lang", "tp", "fp", "tn", "fn", _r(F.col("balanced_acc")).alias("balanced_acc"),
        _r(F.col("auroc")).alias("auroc"), _r(F.col("ap")).alias("ap"))


_REG = f"r AS ({REGRESSION_SQL})"
_SPEARMAN_SQL = f"""
WITH {_REG},
k AS (SELECT grp, y, yhat,
             rank() OVER (PARTITION BY grp ORDER BY y) + (count(*) OVER (PARTITION BY grp, y) - 1) / 2.0 AS ry,
             rank() OVER (PARTITION BY grp ORDER BY yhat) + (count(*) OVER (PARTITION BY grp, yhat) - 1) / 2.0 AS rp
      FROM r)
SELECT grp, round(corr(ry, rp), {R}) AS spearman FROM k GROUP BY grp
"""


def _regression(spark, sf_dir):
    return M.regression_metrics(regression(spark, sf_dir), "y", "yhat", ["grp"])


@query("met_06", f"WITH {_REG} SELECT grp, count(*) AS n, round(avg(abs(y - yhat)), {R}) AS mae FROM r GROUP BY grp")
def met_06(spark, sf_dir):
    """Mean absolute error per return flag (quantity vs scaled discount)."""
    r = regression(spark, sf_dir)
    return r.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), _r(M.mae("y", "yhat")).alias("mae"))


@query("met_07", f"WITH {_REG} SELECT grp, round(sqrt(avg(pow(y - yhat, 2))), {R}) AS rmse FROM r GROUP BY grp")
def met_07(spark, sf_dir):
    """Root mean squared error per return flag."""
    r = regression(spark, sf_dir)
    return r.groupBy("grp").agg(_r(M.rmse("y", "yhat")).alias("rmse"))


@query("met_08", _SPEARMAN_SQL)
def met_08(spark, sf_dir):
    """Spearman correlation (mid-ranks, many ties) per return flag."""
    return _regression(spark, sf_dir).select("grp", _r(F.col("spearman")).alias("spearman"))


@query("win_01", f"""
WITH {_REG}
SELECT row_id, rank() OVER (PARTITION BY grp ORDER BY y) + (count(*) OVER (PARTITION BY grp, y) - 1) / 2.0 AS y_rank
FROM r
""")
def win_01(spark, sf_dir):
    """Mid-rank of every lineitem quantity within its return flag."""
    r = regression(spark, sf_dir)
    return mid_ranks(r, "y", ["grp"], out="y_rank").select("row_id", "y_rank")


_LI_RANK_SRC = """s AS (SELECT l_returnflag AS grp, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
                        l_extendedprice AS score FROM lineitem)"""


@query("win_03", _rank_sql(_LI_RANK_SRC, None) + "SELECT n, n_pos, auroc, ap FROM m")
def win_03(spark, sf_dir):
    """Running totals in value order over every lineitem row: AUROC and AP of
    the extended price as a score for the 'R' return flag (nearly every
    price distinct, so the running total is a global one)."""
    li = table(spark, sf_dir, "lineitem", "l_returnflag", "l_extendedprice")
    s = li.select((F.col("l_returnflag") == "R").cast("int").alias("label"),
                  F.col("l_extendedprice").alias("score"))
    m = M.ranking_metrics(s, "score", "label", n_buckets=256)
    return m.select("n", "n_pos", _r(F.col("auroc")).alias("auroc"), _r(F.col("ap")).alias("ap"))


@query("win_04", """
SELECT doc_id, batch_id,
       CAST(coalesce(sum(n_chars) OVER (PARTITION BY batch_id ORDER BY doc_id
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset
FROM (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch_id FROM documents) t
""")
def win_04(spark, sf_dir):
    """Start offset of each document inside its batch of 64 (cumsum - size)."""
    b = reshape.batches(table(spark, sf_dir, "documents", "doc_id", "n_chars"), "doc_id", 64)
    return exclusive_prefix_sum(b, "n_chars", ["doc_id"], ["batch_id"]).select("doc_id", "batch_id", "offset")


@query("met_09", f"""
WITH {_S}
SELECT lang, round(avg(CASE WHEN (CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) = label THEN 1.0 ELSE 0.0 END), {R}) AS accuracy
FROM s GROUP BY lang
""")
def met_09(spark, sf_dir):
    """Accuracy of (score >= 0.5) per language."""
    a = M.accuracy(scored(spark, sf_dir), "score", "label", ["lang"])
    return a.select("lang", _r(F.col("accuracy")).alias("accuracy"))


@query("met_10", f"""
WITH {_S}, x AS (SELECT lang, label, score, logit1 - 4.8 AS z FROM s)
SELECT lang,
       round(avg(greatest(z, 0.0) - z * label + ln(1 + exp(-abs(z)))), {R}) AS bce,
       round(avg(pow(score - label, 2)), {R}) AS mse
FROM x GROUP BY lang
""")
def met_10(spark, sf_dir):
    """Mean binary cross entropy from logits (centred at 4.8) and the
    squared-error criterion, per language."""
    s = scored(spark, sf_dir).withColumn("z", F.col("logit1") - 4.8)
    return s.groupBy("lang").agg(
        _r(F.avg(M.bce_from_logit(F.col("z"), F.col("label")))).alias("bce"),
        _r(F.avg(F.pow(F.col("score") - F.col("label"), 2))).alias("mse"))


@query("met_11", f"""
WITH {_S}, x AS (SELECT doc_id, [0.0, logit1, 4.8] AS logits FROM s)
SELECT doc_id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred,
       round(list_max(logits), {R}) AS max_logit
FROM x
""")
def met_11(spark, sf_dir):
    """Predicted class (first largest logit) and its logit."""
    s = scored(spark, sf_dir).select("doc_id", F.array(F.lit(0.0), F.col("logit1"), F.lit(4.8)).alias("logits"))
    return s.select("doc_id", M.argmax("logits").alias("pred"), _r(F.array_max("logits")).alias("max_logit"))


_MR = f"mr AS ({METRIC_RECORDS_SQL})"
_EPOCHS = "ep AS (SELECT model, epoch, metric, avg(value) AS value FROM mr GROUP BY model, epoch, metric)"
_PREFIX = "pm AS (SELECT model, epoch, avg(value) AS score FROM ep WHERE starts_with(metric, 'auroc') GROUP BY model, epoch)"


def _epoch_scores(spark, sf_dir):
    mr = metric_records(spark, sf_dir)
    ep = mr.groupBy("model", "epoch", "metric").agg(F.avg("value").alias("value"))
    return M.prefix_mean(ep, "auroc")


@query("agg_01", f"""
WITH {_MR}, pf AS (SELECT dataset, model, metric, fold, avg(value) AS value FROM mr GROUP BY dataset, model, metric, fold)
SELECT dataset, model, metric, round(avg(value), {R}) AS mean, round(stddev_samp(value), {R}) AS std,
       count(*) AS n_folds
FROM pf GROUP BY dataset, model, metric
""")
def agg_01(spark, sf_dir):
    """Mean, standard deviation and count of each metric over 5 folds."""
    mr = metric_records(spark, sf_dir)
    pf = mr.groupBy("dataset", "model", "metric", "fold").agg(F.avg("value").alias("value"))
    s = M.fold_summary(pf)
    return s.select("dataset", "model", "metric", _r(F.col("mean")).alias("mean"),
                    _r(F.col("std")).alias("std"), "n_folds")


@query("agg_02", f"WITH {_MR}, {_EPOCHS}, {_PREFIX} SELECT model, epoch, round(score, {R}) AS score FROM pm")
def agg_02(spark, sf_dir):
    """Per (model, epoch): mean over tasks of the metrics named 'auroc [..]'."""
    return _epoch_scores(spark, sf_dir).select("model", "epoch", _r(F.col("score")).alias("score"))


@query("agg_03", f"""
WITH {_MR}, {_EPOCHS}, {_PREFIX}
SELECT model, arg_max(epoch, (score, -epoch)) AS best_epoch, round(max(score), {R}) AS best_score
FROM pm GROUP BY model
""")
def agg_03(spark, sf_dir):
    """Best epoch per model; the earlier epoch wins a tie."""
    b = M.best_epoch(_epoch_scores(spark, sf_dir))
    return b.select("model", "best_epoch", _r(F.col("best_score")).alias("best_score"))


@query("agg_04", f"""
WITH pairs AS ({PAIRS_SQL}), lab AS ({labelled_sql()})
SELECT (SELECT count(*) FROM pairs) AS n_pairs, (SELECT count(*) FROM lab) AS n_labelled,
       (SELECT count(*) FROM conversations) AS n_turns
""")
def agg_04(spark, sf_dir):
    """Row counts: pairs, labelled rows, conversation turns."""
    p = pairs(spark, sf_dir)
    lab = reshape.unpivot_pairs(p, "surf_sequence", "deep_sequence")
    turns = table(spark, sf_dir, "conversations", "conv_id")
    return p.select(F.count(F.lit(1)).alias("n_pairs")).select(
        "n_pairs", lab.select(F.count(F.lit(1))).scalar().alias("n_labelled"),
        turns.select(F.count(F.lit(1))).scalar().alias("n_turns"))


@query("top_01", f"""
WITH {_MR}, {_EPOCHS}, {_PREFIX}
SELECT model, epoch, round(score, {R}) AS score FROM pm ORDER BY score DESC, epoch, model LIMIT 1
""")
def top_01(spark, sf_dir):
    """Top-1 (model, epoch) by score, earlier epoch first on ties (top-k
    report: the limit is the feature)."""
    s = _epoch_scores(spark, sf_dir)
    best = s.orderBy(F.col("score").desc(), F.col("epoch").asc(), F.col("model").asc()).limit(1)
    return best.select("model", "epoch", _r(F.col("score")).alias("score"))


@query("top_02", f"""
WITH pairs AS ({PAIRS_SQL}), lab AS ({labelled_sql()})
SELECT row_id, label FROM lab
ORDER BY md5(concat('11', ':', CAST(row_id * 2 + label AS VARCHAR))), row_id * 2 + label LIMIT 25
""")
def top_02(spark, sf_dir):
    """First 25 labelled rows of a seeded random order (sampling: the limit is
    the feature)."""
    lab = reshape.unpivot_pairs(pairs(spark, sf_dir), "surf_sequence", "deep_sequence")
    lab = lab.withColumn("text_id", F.col("row_id") * 2 + F.col("label"))
    return splits.exact_sample(lab, "text_id", 25, seed=11).select("row_id", "label")


@query("udf_03", _rank_sql(_S, "lang") + """
SELECT lang, 'auroc' AS metric, CAST(auroc AS DOUBLE) AS value FROM m
UNION ALL SELECT lang, 'auprc' AS metric, CAST(ap AS DOUBLE) AS value FROM m
""")
def udf_03(spark, sf_dir):
    """Metric callback as a table: (lang, metric, value) rows."""
    m = _ranking(spark, sf_dir).withColumnRenamed("ap", "auprc")
    return M.long_metrics(m, ["lang"], ["auroc", "auprc"])
