"""Deterministic, key-hashed splits (SPL-01..09).

A numpy permutation cannot be reproduced, so the random order is
``md5(seed:key)`` then the key itself.  Fold and hold-out sizes follow the
scikit-learn rules (fold sizes differ by at most one, the first ``n mod k``
folds are larger; a hold-out of fraction f has ``ceil(f*n)`` rows).  A split
needs only the few boundary positions of that order: they are found from
md5-bucket counts and a sort of the boundary buckets alone, and each row's
side is then a comparison with them (no shuffle or sort of the rows).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.ranks import hash_key, null_safe_join
from helixframe.session import reliable_checkpoint

TRAIN, VALID, TEST = "train", "valid", "test"


# ---- cut points instead of ranks ----
#
# A split only needs to know, per row, on which side of a few positions of the
# md5 order it falls.  The (hash, key) value at position m is found from the
# bucket counts (the bucket holding m) and one sort of that bucket only, so
# assigning folds is a per-row comparison: no shuffle or sort of the rows.


def _cuts(df: DataFrame, hash_col: str, key: str, pcols: list[str], targets, bucket_chars: int = 3) -> DataFrame:
    """One row per group: ``pcols``, ``_n`` (its rows) and ``_cuts``, an array
    of the (hash, key) at each requested 0-based position (``targets(n column)
    -> list of position columns``), NULL at or past the end of the group.

    Rows are counted per (group, md5-prefix bucket); a running count over that
    small table finds the bucket that holds each target, and only those
    buckets are sorted.  Nothing comes to the driver, and NULL is a group like
    any other.  The result is written once to the checkpoint folder.
    """
    names = [f"_p{i}" for i in range(len(pcols))]
    d = df.select(*[F.col(c).alias(n) for c, n in zip(pcols, names, strict=True)],
                  F.substring(F.col(hash_col), 1, bucket_chars).alias("_b"), F.col(hash_col).alias("_ch"), F.col(key).alias("_ck"))
    counts = reliable_checkpoint(d.groupBy(*names, "_b").agg(F.count(F.lit(1)).alias("_bn")))
    group = Window.partitionBy(*names)
    cum = counts.select("*", F.sum("_bn").over(group).alias("_n"), F.coalesce(F.sum("_bn").over(
        group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_c0"))
    wanted = cum.select(*names, "_b", "_c0", "_bn", "_n", F.posexplode(F.array(
        *[t.cast("long") for t in targets(F.col("_n"))])).alias("_t", "_m"))
    need = wanted.where((F.col("_m") >= F.col("_c0")) & (F.col("_m") < F.col("_c0") + F.col("_bn"))).select(
        *names, "_b", "_t", (F.col("_m") - F.col("_c0")).alias("_o"))
    buckets = need.select(*names, "_b").distinct()
    ranked = null_safe_join(d, buckets, [*names, "_b"], "left_semi").withColumn(
        "_o", F.row_number().over(Window.partitionBy(*names, "_b").orderBy("_ch", "_ck")) - 1)
    hits = null_safe_join(ranked, need, [*names, "_b", "_o"]).groupBy(*names).agg(
        F.map_from_entries(F.collect_list(F.struct("_t", F.struct("_ch", "_ck")))).alias("_found"))
    sizes = counts.groupBy(*names).agg(F.sum("_bn").alias("_n"))
    n_targets = len(targets(F.lit(1)))
    found = null_safe_join(sizes, hits, names, "left") if names else sizes.join(hits, how="left")
    return reliable_checkpoint(found.select(
        *[F.col(n).alias(c) for c, n in zip(pcols, names, strict=True)], "_n",
        F.array(*[F.try_element_at("_found", F.lit(t)) for t in range(n_targets)]).alias("_cuts")))


def _before(hash_col: str, key: str, i: int) -> Column:
    """Row sorts before cut ``i`` of its group; a NULL cut is past the end."""
    at = F.get(F.col("_cuts"), F.lit(i))
    return F.coalesce((F.col(hash_col) < at["_ch"]) | ((F.col(hash_col) == at["_ch"]) & (F.col(key) < at["_ck"])), F.lit(True))


def _assign(d: DataFrame, pcols: list[str], cuts: DataFrame, value: Column, out: str) -> DataFrame:
    """Add ``out = value``, which compares each row with the ``_cuts`` of its
    group: a NULL-safe join with the table of groups, whose way (broadcast or
    shuffle) the planner picks from its size.  Without groups the one row of
    cuts is a scalar subquery."""
    if pcols:
        d = null_safe_join(d, cuts, pcols, "left")
    else:
        one = cuts.agg(F.max("_n").alias("_n"), F.first("_cuts").alias("_cuts"))
        d = d.withColumn("_n", one.select("_n").scalar()).withColumn("_cuts", one.select("_cuts").scalar())
    return d.withColumn(out, value).drop("_n", "_cuts")


def _fold_starts(n: Column, k: int) -> list[Column]:
    q, r = F.floor(n / k), n % k
    return [F.lit(j) * q + F.least(F.lit(j), r) for j in range(1, k)]


def _ceil_frac(fraction, n: Column) -> Column:
    """ceil(fraction * n) in exact integer arithmetic (0.1 * 230 is 23)."""
    from fractions import Fraction
    f = fraction if isinstance(fraction, Fraction) else Fraction(str(fraction))
    whole = n.cast("decimal(38,0)") * F.lit(f.numerator).cast("decimal(18,0)") + F.lit(f.denominator - 1)
    return F.floor(whole / F.lit(f.denominator).cast("decimal(18,0)")).cast("long")


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 1234, repeats: int | None = None,
          same_seed: bool = False, out: str = "fold") -> DataFrame:
    """Shuffled K-fold assignment (SPL-01), one row per input row with its
    test fold.  With ``repeats`` (SPL-02) every row appears once per repeat;
    repeat r uses seed ``seed + r`` unless ``same_seed`` (the reference reused
    one seed, so its repeats were identical).

    Rows are ordered by ``md5(seed:key)`` then key and cut into k contiguous
    folds; the k-1 fold boundaries are found as cut points, so the fold is a
    per-row comparison (see :func:`_cuts`)."""
    if k < 2:
        raise ValueError("k must be at least 2")
    d = df
    pcols: list[str] = []
    if repeats is not None:
        d = d.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        seed_col = F.lit(seed) if same_seed else (F.lit(seed) + F.col("repeat"))
        d = d.withColumn("_h", F.md5(F.concat(seed_col.cast("string"), F.lit(":"),
                                              F.col(key).cast("string"))))
        pcols = ["repeat"]
    else:
        d = d.withColumn("_h", hash_key(seed, key))
    cuts = _cuts(d, "_h", key, pcols, lambda n: _fold_starts(n, k))
    fold = sum(((~_before("_h", key, i)).cast("int") for i in range(k - 1)), F.lit(0)).cast("int")
    return _assign(d, pcols, cuts, fold, out).drop("_h")


def split_index(assign: DataFrame, key: str, k: int, fold_col: str = "fold") -> DataFrame:
    """Expand a fold assignment to the split-index table
    ``(repeat, fold, key, split)``: each row is ``test`` in its own fold and
    ``train`` in the other k-1 (what the reference pickles per fold)."""
    has_repeat = "repeat" in assign.columns
    d = assign.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    rep = F.col("repeat").cast("int") if has_repeat else F.lit(0)
    return d.select(rep.alias("repeat"), F.col("_f").cast("int").alias("fold"), F.col(key),
                    F.when(F.col("_f") == F.col(fold_col), F.lit(TEST)).otherwise(F.lit(TRAIN))
                    .alias("split"))


def holdout(df: DataFrame, key: str, fraction: float, seed: int = 1234,
            partition_cols: list[str] | None = None, held: str = TEST, rest: str = TRAIN,
            out: str = "split") -> DataFrame:
    """Hold-out split (SPL-03): the first ``ceil(fraction * n)`` rows of the
    md5 order (per group) get ``held``, the others ``rest``.  One cut point
    per group; the split itself is a per-row comparison."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must be in (0, 1)")
    pcols = list(partition_cols or [])
    d = df.withColumn("_h", hash_key(seed, key))
    cuts = _cuts(d, "_h", key, pcols, lambda n: [_ceil_frac(fraction, n)])
    side = F.when(_before("_h", key, 0), F.lit(held)).otherwise(F.lit(rest))
    return _assign(d, pcols, cuts, side, out).drop("_h")


def nested_holdout(df: DataFrame, key: str, val_size: float, test_size: float, seed: int = 1234,
                   second_seed: int | None = None, nested_ratio: str = "stated",
                   out: str = "split") -> DataFrame:
    """Three-way split by two hold-outs (SPL-04).

    First ``val_size + test_size`` is held out; inside it a second ordering
    takes the validation rows.  ``nested_ratio="stated"`` takes
    ``val/(val+test)`` of the held part, so the fractions are the stated
    ones; ``"reference"`` takes ``val/test`` of it, as the reference did
    (2.75% instead of 2.5% for 0.025/0.25).
    """
    from fractions import Fraction
    if nested_ratio == "stated":
        inner = Fraction(str(val_size)) / (Fraction(str(val_size)) + Fraction(str(test_size)))
    elif nested_ratio == "reference":
        inner = Fraction(str(val_size)) / Fraction(str(test_size))
    else:
        raise ValueError("nested_ratio must be 'stated' or 'reference'")
    first = holdout(df, key, float(Decimal(str(val_size)) + Decimal(str(test_size))), seed,
                    held="_held", rest=TRAIN, out="_s1")
    s2 = seed if second_seed is None else second_seed
    # second cut among the held rows only
    d = first.withColumn("_h2", F.when(F.col("_s1") == "_held", hash_key(s2, key)))
    cuts = _cuts(d.where(F.col("_s1") == "_held"), "_h2", key, [], lambda n: [_ceil_frac(inner, n)])
    side = (F.when(F.col("_s1") == TRAIN, F.lit(TRAIN))
            .when(_before("_h2", key, 0), F.lit(VALID)).otherwise(F.lit(TEST)))
    return _assign(d, [], cuts, side, out).drop("_s1", "_h2")


def kfold_with_valid(split_idx: DataFrame, key: str, valid_fraction: float = 0.1,
                     seed: int = 1234) -> DataFrame:
    """K-fold with a validation cut from each training part (SPL-05): inside
    every (repeat, fold) the first ``ceil(f * n_train)`` training rows of a
    second md5 order become ``valid``.  One cut point per (repeat, fold)."""
    d = split_idx.withColumn("_h", F.when(F.col("split") == TRAIN,
                                          hash_key(seed, F.col("repeat"), F.col("fold"), F.col(key))))
    train = d.where(F.col("split") == TRAIN)
    cuts = _cuts(train, "_h", key, ["repeat", "fold"], lambda n: [_ceil_frac(valid_fraction, n)])
    d = _assign(d, ["repeat", "fold"], cuts, _before("_h", key, 0), "_v")
    is_valid = (F.col("split") == TRAIN) & F.col("_v")
    return d.withColumn("split", F.when(is_valid, F.lit(VALID)).otherwise(F.col("split"))).drop("_h", "_v")


def resolve_split(df: DataFrame, key: str, split_table: DataFrame | None = None,
                  repeat: int | None = None, fold: int | None = None,
                  fixed_split: DataFrame | None = None, val_size: float = 0.02,
                  test_size: float = 0.2, inner_valid: float = 0.05, seed: int = 1234,
                  nested_ratio: str = "stated") -> DataFrame:
    """Split choice by priority (SPL-06): a stored (repeat, fold) from a split
    index, with a validation cut from its training part; else a stored fixed
    split ``(key, split)``; else a fresh nested hold-out.  Returns
    ``df`` with a ``split`` column."""
    if split_table is not None and fold is not None:
        sel = split_table.where((F.col("repeat") == (repeat or 0)) & (F.col("fold") == fold))
        part = sel.select(key, "split")
        train = part.where(F.col("split") == TRAIN)
        cut = holdout(train, key, inner_valid, seed, held=VALID, rest=TRAIN)
        part = cut.unionByName(part.where(F.col("split") != TRAIN))
        return df.join(part, key, "inner")
    if fixed_split is not None:
        return df.join(fixed_split.select(key, "split"), key, "inner")
    return nested_holdout(df, key, val_size, test_size, seed, nested_ratio=nested_ratio)


def exact_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows without replacement (SPL-07): the first n of the md5
    order.  Plans as TakeOrderedAndProject (a per-partition top-n)."""
    if seed is None:
        raise ValueError("a seed is required")
    return df.withColumn("_h", hash_key(seed, key)).orderBy("_h", key).limit(n).drop("_h")


def split_sizes(labelled: DataFrame, group_cols=("repeat", "fold", "split", "label"),
                expected: DataFrame | None = None) -> DataFrame:
    """Row counts per split (SPL-08).  With ``expected``, a table of the
    groups that must be there (``group_cols``), a group of it without rows is
    an error that names it."""
    out = labelled.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n_rows"))
    if expected is not None:
        empty = null_safe_join(expected.select(*group_cols).distinct(), out, list(group_cols), "left_anti").first()
        if empty is not None:
            raise ValueError(f"empty split group: {empty.asDict()}")
    return out


def pair_leaks(labelled: DataFrame, pair_key: str = "row_id") -> DataFrame:
    """Per (repeat, fold): pairs and pairs seen in more than one split (SPL-09);
    the second number must be 0."""
    per_pair = labelled.groupBy("repeat", "fold", pair_key).agg(
        F.countDistinct("split").alias("_ns"))
    return per_pair.groupBy("repeat", "fold").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum(F.when(F.col("_ns") > 1, 1).otherwise(0)).cast("long").alias("n_leaks"))


def range_subset(df: DataFrame, pos_col: str, start: int, end: int, n_rows: int) -> DataFrame:
    """Contiguous position range ``[start, end)`` with a bounds check (FLT-02):
    an end beyond the row count is an error, not a silently short split."""
    if start < 0 or end < start or end > n_rows:
        raise ValueError(f"range [{start}, {end}) outside 0..{n_rows}")
    return df.where((F.col(pos_col) >= start) & (F.col(pos_col) < end))
