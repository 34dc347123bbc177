"""Scores, exact ranking metrics, regression metrics and metric-table
summaries (MET, AGG, TOP, UDF-03).

Ranking metrics group rows by distinct score first (a partial aggregate, so a
score shared by a third of the rows is one row), then take running totals in
score order from the bucketed helper.  No metric pulls rows to the driver or
puts all rows of a group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.ranks import null_safe_join, rank_table, running_totals
from helixframe.session import reliable_checkpoint


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- scores from logits (MET-01, MET-02, MET-11) ----

def positive_softmax(l0, l1) -> Column:
    """Softmax of class 1 across a two-logit row: ``1 / (1 + exp(l0 - l1))``,
    which cannot overflow for large logits (MET-01)."""
    d = _c(l0) - _c(l1)
    return F.when(d > 0, F.exp(-d) / (F.exp(-d) + 1)).otherwise(1 / (F.exp(d) + 1))


def softmax_at(logits, index: int) -> Column:
    """Softmax of element ``index`` (0-based) of a logit array: the max is
    subtracted first (MET-01, any number of classes)."""
    lg = _c(logits)
    # the maximum is bound as a lambda variable: one computation per row, not one per element
    return F.element_at(F.transform(F.array(F.array_max(lg)), lambda m: F.exp(F.element_at(lg, index + 1) - m) / F.aggregate(
        lg, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))), 1)


def column_softmax(df: DataFrame, logit: str, out: str = "score") -> DataFrame:
    """Softmax down the column (MET-02, the reference's axis-0 variant):
    ``exp(l - max) / sum(exp(l - max))`` over all rows.  The two totals are
    scalar subqueries (one small aggregate job each), not a window over all
    rows and not a join."""
    m = df.select(F.max(logit)).scalar()
    s = df.select(F.sum(F.exp(F.col(logit) - m))).scalar()
    return df.withColumn(out, F.exp(F.col(logit) - m) / s)


def argmax(logits) -> Column:
    """0-based index of the first largest logit (MET-11)."""
    lg = _c(logits)
    return (F.array_position(lg, F.array_max(lg)) - 1).cast("int")


# ---- ranking metrics (MET-03, MET-04, MET-05) ----

def ranking_metrics(df: DataFrame, score: str, label: str,
                    group_cols: Sequence[str] | None = None, n_buckets: int | None = None) -> DataFrame:
    """Exact AUROC (ties count half) and average precision (the step sum
    used by scikit-learn, not the trapezoid) per group.

    Returns ``(*group_cols, n, n_pos, auroc, ap)``; both metrics are NULL for
    a group with one class only.
    """
    g = list(group_cols or [])
    per_score = (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
                 .groupBy(*g, score)
                 .agg(F.sum(F.col(label).cast("long")).alias("p"),
                      F.sum((1 - F.col(label)).cast("long")).alias("n")))
    cum = running_totals(per_score, score, ["p", "n"], g, descending=True, n_buckets=n_buckets)
    tp, fp = F.col("cum_p"), F.col("cum_n")
    agg = cum.groupBy(*g).agg(
        F.sum("p").alias("P"), F.sum("n").alias("N"),
        F.sum(F.col("n") * (tp - F.col("p")) + F.col("n") * F.col("p") / 2.0).alias("_auc"),
        F.sum(F.when(F.col("p") > 0, F.col("p") * tp / (tp + fp)).otherwise(0.0)).alias("_ap"))
    ok = (F.col("P") > 0) & (F.col("N") > 0)
    return agg.select(*g, (F.col("P") + F.col("N")).alias("n"), F.col("P").alias("n_pos"),
                      F.when(ok, F.col("_auc") / (F.col("P") * F.col("N"))).alias("auroc"),
                      F.when(ok, F.col("_ap") / F.col("P")).alias("ap"))


def confusion(df: DataFrame, pred: str, label: str, group_cols: Sequence[str] | None = None) -> DataFrame:
    """Confusion counts and the metrics of hard 0/1 predictions (MET-05):
    AUROC of a 0/1 score is the balanced accuracy ``(TPR + TNR) / 2``."""
    g = list(group_cols or [])
    y, p = F.col(label), F.col(pred)
    c = df.groupBy(*g).agg(
        F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when((y == 0) & (p == 1), 1).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when((y == 0) & (p == 0), 1).otherwise(0)).cast("long").alias("tn"),
        F.sum(F.when((y == 1) & (p == 0), 1).otherwise(0)).cast("long").alias("fn"))
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    ok = (pos > 0) & (neg > 0)
    return c.select("*", F.when(ok, (F.col("tp") / pos + F.col("tn") / neg) / 2).alias("auroc"))


# ---- regression and classification losses (MET-06..10) ----

def regression_metrics(df: DataFrame, y: str, yhat: str, group_cols: Sequence[str] | None = None,
                       n_buckets: int | None = None) -> DataFrame:
    """MAE, RMSE and Spearman correlation per group (NULL is a group like any
    other).  Spearman is the Pearson correlation of mid-ranks (ties averaged);
    NULL for a constant column.

    Rows are first summed up to ``(group, y, yhat, n)``, written once; ranks
    and weighted moments come from that table, so no row is shuffled by its
    value."""
    g = list(group_cols or [])
    pairs = reliable_checkpoint(df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
                                .groupBy(*g, F.col(y).alias("_y"), F.col(yhat).alias("_p")).agg(F.count(F.lit(1)).alias("_n")))
    n, err = F.col("_n"), F.col("_y") - F.col("_p")
    total = F.sum("_n")
    basic = pairs.groupBy(*g).agg(total.alias("n"), (F.sum(n * F.abs(err)) / total).alias("mae"),
                                  F.sqrt(F.sum(n * F.pow(err, 2)) / total).alias("rmse"))
    r = pairs
    for v, out in (("_y", "_ry"), ("_p", "_rp")):
        r = null_safe_join(r, rank_table(pairs, v, g, out, n_buckets, weight="_n"), [*g, v])
    # weighted Pearson of the ranks around their mean, which is (N + 1) / 2; try_divide gives NULL for a
    # constant column instead of failing
    r = null_safe_join(r, basic.select(*g, ((F.col("n") + 1) / 2.0).alias("_m")), g) if g else \
        r.withColumn("_m", (basic.select("n").scalar() + 1) / 2.0)
    a, b = F.col("_ry") - F.col("_m"), F.col("_rp") - F.col("_m")
    sp = r.groupBy(*g).agg(F.try_divide(F.sum(n * a * b), F.sqrt(F.sum(n * a * a) * F.sum(n * b * b))).alias("spearman"))
    if not g:  # two one-row results: put them side by side without a join
        return basic.select("*", F.lit(sp.select("spearman").scalar()).alias("spearman"))
    return null_safe_join(basic, sp, g)


def mae(y, yhat) -> Column:
    """Mean absolute error aggregate (MET-06)."""
    return F.avg(F.abs(_c(y) - _c(yhat)))


def rmse(y, yhat) -> Column:
    """Root mean squared error aggregate (MET-07)."""
    return F.sqrt(F.avg(F.pow(_c(y) - _c(yhat), 2)))


def accuracy(df: DataFrame, prob: str, label: str, group_cols: Sequence[str] | None = None,
             threshold: float = 0.5) -> DataFrame:
    """Share of rows with ``(prob >= threshold) == label`` (MET-09)."""
    g = list(group_cols or [])
    hit = ((F.col(prob) >= threshold).cast("int") == F.col(label)).cast("double")
    return df.groupBy(*g).agg(F.avg(hit).alias("accuracy"))


def bce_from_logit(x, y) -> Column:
    """Binary cross entropy of a logit, stable for large |x|:
    ``max(x,0) - x*y + log1p(exp(-|x|))`` (MET-10)."""
    x, y = _c(x), _c(y)
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


# ---- metric tables (AGG-01..04, TOP-01, UDF-03) ----

def long_metrics(metrics: DataFrame, group_cols: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Wide metric columns to ``(*group_cols, metric, value)`` rows (UDF-03:
    the metric callback result as a table)."""
    pairs = ", ".join(f"'{n}', CAST(`{n}` AS DOUBLE)" for n in names)
    expr = f"stack({len(names)}, {pairs}) AS (metric, value)"
    return metrics.selectExpr(*[f"`{c}`" for c in group_cols], expr)


def fold_summary(records: DataFrame, group_cols=("dataset", "model", "metric")) -> DataFrame:
    """Mean, sample standard deviation and count of a metric over folds
    (AGG-01)."""
    return records.groupBy(*group_cols).agg(F.avg("value").alias("mean"),
                                            F.stddev_samp("value").alias("std"),
                                            F.count(F.lit(1)).alias("n_folds"))


def prefix_mean(records: DataFrame, prefix: str, group_cols=("model", "epoch"),
                out: str = "score") -> DataFrame:
    """Mean over tasks of the metrics whose name starts with ``prefix``
    (AGG-02, e.g. every ``auroc [task]``)."""
    return (records.where(F.col("metric").startswith(prefix))
            .groupBy(*group_cols).agg(F.avg("value").alias(out)))


def best_epoch(scores: DataFrame, group_cols=("model",), epoch: str = "epoch",
               score: str = "score") -> DataFrame:
    """Best epoch per group; on equal scores the earlier epoch wins (AGG-03).
    One partial aggregate: ``max_by`` over ``(score, -epoch)``."""
    key = F.struct(F.col(score), (-F.col(epoch)).alias("_ne"))
    return scores.groupBy(*group_cols).agg(F.max_by(epoch, key).alias("best_epoch"),
                                           F.max(score).alias("best_score"))
