"""Reshape, select and combine (PRJ, FLT, JON, SET)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.ranks import null_safe_join, ordinal_by_value

SPLIT_ORDER = {"train": 0, "valid": 1, "test": 2}


def spread_rows(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin rows over at least ``min_partitions`` tasks (default: the
    cluster's parallelism) when the scan yields fewer, e.g. one small file
    with one row group.  A scan that is already wide is left alone, so a
    large input pays no extra shuffle."""
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


def quote(name: str) -> str:
    """Backtick a column name so dotted names (``surf.sequence``) resolve."""
    return "`" + name.replace("`", "``") + "`"


def unpivot_pairs(df: DataFrame, first: str, second: str, key: str = "row_id",
                  keep: Sequence[str] = ()) -> DataFrame:
    """Pair rows to labelled rows (SET-01, PRJ-07): the first column gets
    label 0, the second label 1, in one scan.  The reference's row order (all
    of column 1, then all of column 2) is ``(label, key)``.  The text is
    picked by label above the generator, so a query that does not use it never
    reads the two columns."""
    labels = df.select(*[F.col(quote(c)) for c in (key, *keep, first, second)],
                       F.explode(F.array(F.lit(0), F.lit(1))).alias("label"))
    return labels.select(*[F.col(quote(c)) for c in (key, *keep)], "label",
                         F.when(F.col("label") == 0, F.col(quote(first))).otherwise(F.col(quote(second))).alias("text"))


def select_rows(df: DataFrame, positions: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows at given positions (FLT-01 / JON-01 single fold): a left-semi join
    on the key; the planner broadcasts the positions where they are small."""
    return df.join(positions.select(key), key, "left_semi")


def attach_splits(df: DataFrame, split_index: DataFrame, key: str = "row_id") -> DataFrame:
    """Data x split index on the key, all folds in one pass (JON-01).  Both
    sides shuffle on the key once, or not at all where both are bucketed on it
    (:func:`helixframe.sources.writers.write_bucketed`); the index has k rows per key."""
    return df.join(split_index, key, "inner")


def append_columns(df: DataFrame, cols: Sequence[str], out: str = "text",
                   key: str = "row_id") -> DataFrame:
    """Stack columns of one type into one column, bag semantics (SET-02):
    UNION ALL of the columns, tagged with the source column, written as one
    ``stack`` generator so the input is scanned once, not once per column."""
    pairs = ", ".join(f"'{c}', {quote(c)}" for c in cols)
    return df.selectExpr(quote(key), f"stack({len(cols)}, {pairs}) AS (source_col, {quote(out)})")


def concat_splits(df: DataFrame, key: str = "row_id", split_col: str = "split",
                  out: str = "position") -> DataFrame:
    """Train, then valid, then test, with a running position (SET-03)."""
    order = F.create_map(*[x for k, v in SPLIT_ORDER.items() for x in (F.lit(k), F.lit(v))])
    return position_by(df.withColumn("_major", order[F.col(split_col)]), "_major", key, out).drop("_major")


def position_by(df: DataFrame, major: str, key: str | Sequence[str], out: str = "position") -> DataFrame:
    """0-based position in ``(major, key)`` order, where ``major`` has few
    values: the ordinal of ``key`` within each of them, which no task sees
    whole, after the rows of those before it (a table of one row each)."""
    counts = df.groupBy(major).agg(F.count(F.lit(1)).alias("_mc"))
    before = Window.orderBy(major).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(major, F.coalesce(F.sum("_mc").over(before), F.lit(0)).alias("_mo"))
    d = null_safe_join(ordinal_by_value(df, key, [major], out="_mp"), offsets, [major])
    return d.withColumn(out, (F.col("_mo") + F.col("_mp")).cast("long")).drop("_mo", "_mp")


def batches(df: DataFrame, order_col: str, size: int, out: str = "batch_id",
            position: str = "position") -> DataFrame:
    """Fixed-size batches in ``order_col`` order (SET-04): position div size.
    Every row is kept; the last batch may be short."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    d = ordinal_by_value(df, order_col, out=position)
    return d.withColumn(out, F.floor(F.col(position) / size).cast("long"))


def batch_rows(df: DataFrame, order_col: str, size: int, cols, out: str = "rows") -> DataFrame:
    """Each fixed-size batch as one row ``(batch_id, rows)`` with the batch's
    rows in order (SET-04 grouped).  A group holds at most ``size`` rows, so
    collecting it is bounded by the caller's batch size, not by the data."""
    b = batches(df, order_col, size)
    item = F.struct(F.col("position"), *[F.col(c) for c in cols])
    g = b.groupBy("batch_id").agg(F.array_sort(F.collect_list(item)).alias("_r"))
    return g.select("batch_id", F.transform("_r", lambda x: x.dropFields("position")).alias(out))


def latest_by(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """id -> value map where the later entry wins (JON-02): the value with the
    greatest ``order`` per key (a partial aggregate, safe on hot keys)."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def longest_in_batch(df: DataFrame, size_col: str, batch_col: str = "batch_id",
                     out: str = "batch_max") -> DataFrame:
    """Longest item of each batch (padding='longest'); batches are bounded,
    so a window per batch is cheap."""
    return df.withColumn(out, F.max(size_col).over(Window.partitionBy(batch_col)))
