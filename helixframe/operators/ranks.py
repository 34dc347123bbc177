"""Order-dependent numbers (ordinals, running totals, mid-ranks) without a
single-partition sort (WIN-01..04).

A window with no PARTITION BY sends every row to one task.  The helpers here
split the order into buckets that depend on the row alone (a prefix of an
md5 hex key, or the position of a value between sampled cut points), number
rows inside each bucket with an ordinary partitioned window, and add the
running total of the bucket sizes, which is a table of at most
``groups x buckets`` rows.  Because a bucket is a function of the row, a lost
task recomputes to the same numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.session import reliable_checkpoint

# A value range holds about this many rows at most, so a task sorts as much at
# any size; there are at least as many ranges as tasks run at a time, so no
# table is sorted by one task.
RANGE_ROWS = 1_000_000


def null_safe_join(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``cols`` where NULL equals NULL, as in GROUP BY; the columns
    come out once.  Whether a side is small enough to broadcast is left to the
    planner, which sees its size."""
    names = {c: f"_r_{c}" for c in cols}
    right = right.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in right.columns])
    on = F.lit(True)
    for c, r in names.items():
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(f"`{r}`"))
    return left.join(right, on, how).drop(*names.values())


def ranges_for(df: DataFrame, n_rows: int) -> int:
    """Value ranges for a table of ``n_rows``: one for each task that can run
    at a time, more where a range would hold over ``RANGE_ROWS``."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n_rows / RANGE_ROWS))


def hash_key(seed, *keys) -> Column:
    """md5 hex of ``seed:key1:key2...``: a repeatable pseudo-random order.

    The same string is built by DuckDB's ``md5(concat(...))``, so every split
    derived from it has an exact SQL twin.
    """
    parts = [F.lit(str(seed))]
    for k in keys:
        kc = F.col(k) if isinstance(k, str) else k
        parts += [F.lit(":"), kc.cast("string")]
    return F.md5(F.concat(*parts))


def _cols(names: Sequence[str] | None) -> list[str]:
    return list(names or [])


def ordinal_by_hash(df: DataFrame, hash_col: str, tiebreak: Sequence[str] = (),
                    partition_cols: Sequence[str] | None = None, out: str = "rn",
                    total_out: str | None = None, bucket_chars: int = 3) -> DataFrame:
    """0-based ordinal of each row in ``(hash_col, *tiebreak)`` order within
    ``partition_cols`` (WIN-02), plus optionally the group size.  NULL is a
    group like any other.

    ``hash_col`` must be a lower-case hex string (md5): its first
    ``bucket_chars`` characters are a bucket with the same order as the key,
    and md5 spreads rows evenly over the ``16**bucket_chars`` buckets.
    """
    pcols = _cols(partition_cols)
    d = df.withColumn("_hb", F.substring(F.col(hash_col), 1, bucket_chars))
    counts = d.groupBy(*pcols, "_hb").agg(F.count(F.lit(1)).alias("_hc"))
    before = Window.partitionBy(*pcols).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    sel = [*pcols, "_hb", F.coalesce(F.sum("_hc").over(before), F.lit(0)).alias("_ho")]
    if total_out:
        sel.append(F.sum("_hc").over(Window.partitionBy(*pcols)).alias(total_out))
    inner = Window.partitionBy(*pcols, "_hb").orderBy(F.col(hash_col), *[F.col(c) for c in tiebreak])
    ranked = d.withColumn("_hr", F.row_number().over(inner) - 1)
    return (null_safe_join(ranked, counts.select(*sel), [*pcols, "_hb"])
            .withColumn(out, (F.col("_ho") + F.col("_hr")).cast("long"))
            .drop("_hb", "_hr", "_ho"))


def quantile_cuts(df: DataFrame, col: str, n_buckets: int, rel_err: float = 1e-3) -> list[float]:
    """Sorted distinct cut points that split ``col`` into about ``n_buckets``
    equal-count ranges (one pass; the result is ``n_buckets`` numbers)."""
    if n_buckets <= 1:
        return []
    probs = [i / n_buckets for i in range(1, n_buckets)]
    cuts = df.select(F.col(col).cast("double").alias(col)).approxQuantile(col, probs, min(rel_err, 0.25 / n_buckets))
    return sorted(set(c for c in cuts if c is not None))


def with_value_bucket(df: DataFrame, col: str, cuts: list[float], out: str = "_vb") -> DataFrame:
    """Bucket index of ``col`` between ``cuts``: monotone in the value, so equal
    values share a bucket and bucket order is value order."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    tmp = "_vb_in"
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep")
    return (b.transform(df.withColumn(tmp, F.col(col).cast("double")))
            .withColumn(out, F.col(out).cast("int")).drop(tmp))


def _bucketed(df: DataFrame, order_col: str, n_buckets: int | None) -> DataFrame:
    """``df`` with its value range ``_vb``.  The input is written once to the
    shared checkpoint folder, so the cuts, the totals and the window read it
    instead of computing it three times."""
    df = reliable_checkpoint(df)
    n = n_buckets or ranges_for(df, df.count())
    return with_value_bucket(df, order_col, quantile_cuts(df, order_col, n))


def running_totals(df: DataFrame, order_col: str, sum_cols: Sequence[str],
                   partition_cols: Sequence[str] | None = None, descending: bool = False,
                   prefix: str = "cum_", n_buckets: int | None = None, exclusive: bool = False) -> DataFrame:
    """Running totals of ``sum_cols`` in ``order_col`` order (WIN-03).

    Inclusive totals count every row whose value is before or equal to the
    row's value (ties are peers, as in a RANGE frame); ``exclusive=True``
    counts only strictly earlier values.  NULL is a group like any other.
    Work is split into value ranges (as many as the row count asks for) from
    approximate quantiles: the window runs per (group, range) and the range
    offsets come from a table of ``groups x ranges`` rows.  Pass grouped
    values, not raw rows, where a few values may hold most rows.
    """
    pcols = _cols(partition_cols)
    d = _bucketed(df, order_col, n_buckets)
    okey = F.col(order_col).desc() if descending else F.col(order_col).asc()
    bkey = F.col("_vb").desc() if descending else F.col("_vb").asc()

    totals = d.groupBy(*pcols, "_vb").agg(*[F.sum(c).alias(f"_bt_{c}") for c in sum_cols])
    before = Window.partitionBy(*pcols).orderBy(bkey).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*pcols, "_vb", *[
        F.coalesce(F.sum(f"_bt_{c}").over(before), F.lit(0)).alias(f"_bo_{c}") for c in sum_cols])

    frame = Window.partitionBy(*pcols, "_vb").orderBy(okey).rangeBetween(Window.unboundedPreceding, 0)
    inner = d
    for c in sum_cols:
        inner = inner.withColumn(f"_bi_{c}", F.sum(c).over(frame))
        if exclusive:
            peers = Window.partitionBy(*pcols, "_vb", order_col)
            inner = inner.withColumn(f"_bi_{c}", F.col(f"_bi_{c}") - F.sum(c).over(peers))
    out = null_safe_join(inner, offsets, [*pcols, "_vb"])
    for c in sum_cols:
        out = out.withColumn(f"{prefix}{c}", F.col(f"_bo_{c}") + F.col(f"_bi_{c}"))
    drop = ["_vb"] + [f"_bi_{c}" for c in sum_cols] + [f"_bo_{c}" for c in sum_cols]
    return out.drop(*drop)


def ordinal_by_value(df: DataFrame, order_cols: str | Sequence[str], partition_cols: Sequence[str] | None = None,
                     out: str = "rn", n_buckets: int | None = None) -> DataFrame:
    """0-based ordinal by ``order_cols`` (WIN-02 for a given order), the first
    of them numeric.  Rows with equal keys get positions of their own, one
    after another (in no set order), so no position is missing or double."""
    pcols, order = _cols(partition_cols), [order_cols] if isinstance(order_cols, str) else list(order_cols)
    d = _bucketed(df, order[0], n_buckets)
    counts = d.groupBy(*pcols, "_vb").agg(F.count(F.lit(1)).alias("_bc"))
    before = Window.partitionBy(*pcols).orderBy("_vb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*pcols, "_vb", F.coalesce(F.sum("_bc").over(before), F.lit(0)).alias("_bo"))
    inner = d.withColumn("_bi", F.row_number().over(Window.partitionBy(*pcols, "_vb").orderBy(*order)) - 1)
    return (null_safe_join(inner, offsets, [*pcols, "_vb"])
            .withColumn(out, (F.col("_bo") + F.col("_bi")).cast("long")).drop("_vb", "_bi", "_bo"))


def mid_ranks(df: DataFrame, value_col: str, partition_cols: Sequence[str] | None = None,
              out: str | None = None, n_buckets: int | None = None) -> DataFrame:
    """1-based average rank of ``value_col`` (ties share the mean of their
    positions), per group (WIN-01); NULL is a group like any other.  Ranks are
    computed on the distinct values and joined back, so a value held by many
    rows is one row in the window; both sides of the join are exchanged, so
    the rows of a hot value are split by the skew-join handling."""
    pcols = _cols(partition_cols)
    out = out or f"{value_col}_rank"
    return null_safe_join(df, rank_table(df, value_col, pcols, out, n_buckets), [*pcols, value_col], "left")


def rank_table(df: DataFrame, value_col: str, pcols: Sequence[str], out: str, n_buckets: int | None = None,
               weight: str | None = None) -> DataFrame:
    """``(*pcols, value_col, out)``: the average rank of each distinct value,
    where a row stands for ``weight`` rows."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    distinct = df.where(F.col(value_col).isNotNull()).groupBy(*pcols, value_col).agg(n.alias("_tc"))
    cum = running_totals(distinct, value_col, ["_tc"], pcols, n_buckets=n_buckets)
    return reliable_checkpoint(cum.select(*pcols, value_col, (F.col("cum__tc") - (F.col("_tc") - 1) / 2.0).alias(out)))


def exclusive_prefix_sum(df: DataFrame, value_col: str, order_cols: Sequence[str],
                         partition_cols: Sequence[str], out: str = "offset") -> DataFrame:
    """Start offset of each row inside its group: the sum of ``value_col`` over
    earlier rows (``cumsum - size``, WIN-04).  Groups are batches of bounded
    size, so a plain partitioned window is the right tool."""
    w = (Window.partitionBy(*partition_cols).orderBy(*[F.col(c) for c in order_cols])
         .rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(out, F.coalesce(F.sum(value_col).over(w), F.lit(0)).cast("long"))
