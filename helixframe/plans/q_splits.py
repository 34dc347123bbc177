"""Queries: pair table, splits, reshape (SPL, SET, FLT, JON-01, WIN-02)."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions.text import overlap_words
from helixframe.operators import reshape, splits
from helixframe.operators.ranks import hash_key, ordinal_by_hash
from helixframe.plans.inputs import PAIRS_SQL, SEED, kfold_sql, labelled_sql, pairs
from helixframe.plans.registry import query

_PAIRS = f"pairs AS ({PAIRS_SQL})"
_LAB = f"lab AS ({labelled_sql()})"
_FOLDS = f"folds AS ({kfold_sql('pairs', 'row_id', 5, SEED)})"


def _word_stats(text, w, o):
    words = overlap_words(text, w, o)
    return words, F.size(words), F.aggregate(words, F.lit(0).cast("long"),
                                             lambda acc, x: acc + F.char_length(x))


def _sql_words(text: str, w: int, o: int) -> str:
    return (f"(CASE WHEN length({text}) <= {o} THEN []::VARCHAR[] ELSE "
            f"list_transform(range(0, length({text}) - {o}, {w - o}), "
            f"lambda i: substring({text}, i + 1, {w})) END)")


FLAGSHIP_SQL = f"""
WITH {_PAIRS}, {_FOLDS}, {_LAB},
w AS (SELECT f.fold, l.label, {_sql_words('l.text', 5, 2)} AS words
      FROM lab l JOIN folds f ON l.row_id = f.row_id)
SELECT fold, label, count(*) AS n_texts,
       CAST(sum(len(words)) AS BIGINT) AS n_words,
       CAST(sum(list_sum(list_transform(words, lambda x: length(x)))) AS BIGINT) AS n_word_chars
FROM w GROUP BY fold, label
"""


@query("flagship", FLAGSHIP_SQL)
def flagship(spark, sf_dir):
    """Pairs -> 5 md5 folds -> labelled rows -> (5,2) overlapping words ->
    word totals per fold and label."""
    p = splits.kfold(pairs(spark, sf_dir), "row_id", k=5, seed=SEED)   # a per-row fold column
    lab = reshape.unpivot_pairs(p, "surf_sequence", "deep_sequence", keep=["fold"])
    _, n_words, n_chars = _word_stats(F.col("text"), 5, 2)
    return (lab.groupBy("fold", "label")
            .agg(F.count(F.lit(1)).alias("n_texts"), F.sum(n_words).cast("long").alias("n_words"),
                 F.sum(n_chars).cast("long").alias("n_word_chars")))


@query("spl_01", f"WITH {_PAIRS}, {_FOLDS} SELECT row_id, fold FROM folds")
def spl_01(spark, sf_dir):
    """K-fold (k=5) over the pair key."""
    return splits.kfold(pairs(spark, sf_dir).select("row_id"), "row_id", k=5, seed=SEED)


_REPEATS_SQL = f"""
WITH {_PAIRS},
rep AS (SELECT p.row_id, CAST(r.repeat AS INTEGER) AS repeat FROM pairs p,
        (SELECT unnest(range(0, 5)) AS repeat) r),
folds AS ({kfold_sql('rep', 'row_id', 5, "CAST(1234 + repeat AS VARCHAR)", 'repeat')})
"""


@query("spl_02", _REPEATS_SQL + " SELECT repeat, row_id, fold FROM folds")
def spl_02(spark, sf_dir):
    """Repeated K-fold: 5 repeats x 5 folds, seed = 1234 + repeat."""
    return splits.kfold(pairs(spark, sf_dir).select("row_id"), "row_id", k=5, seed=SEED, repeats=5)


def _holdout_sql(src: str, key: str, frac: str, seed: int, held: str, rest: str) -> str:
    return f"""
SELECT *, CASE WHEN rn < CAST(ceil({frac} * n) AS BIGINT) THEN '{held}' ELSE '{rest}' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY md5(concat('{seed}', ':', CAST({key} AS VARCHAR))), {key}) - 1 AS rn,
             count(*) OVER () AS n FROM {src}) r
"""


@query("spl_03", f"SELECT doc_id, split FROM ({_holdout_sql('documents', 'doc_id', '0.1', SEED, 'test', 'train')}) h")
def spl_03(spark, sf_dir):
    """Hold-out of 10% of the documents (test size = ceil(0.1 n))."""
    from helixframe.plans.registry import table
    return splits.holdout(table(spark, sf_dir, "documents", "doc_id"), "doc_id", 0.1, SEED)


@query("spl_03_grouped", """
SELECT doc_id, grp, CASE WHEN rn < CAST(ceil(0.2 * n) AS BIGINT) THEN 'test' ELSE 'train' END AS split
FROM (SELECT doc_id, nullif(lang, 'de') AS grp,
             row_number() OVER (PARTITION BY nullif(lang, 'de') ORDER BY md5(concat('1234', ':', CAST(doc_id AS VARCHAR))), doc_id) - 1 AS rn,
             count(*) OVER (PARTITION BY nullif(lang, 'de')) AS n FROM documents) r
""")
def spl_03_grouped(spark, sf_dir):
    """Hold-out of 20% of each language, where one language is NULL: NULL is a
    group like any other."""
    from helixframe.plans.registry import table
    d = table(spark, sf_dir, "documents", "doc_id", "lang").select("doc_id", F.expr("nullif(lang, 'de')").alias("grp"))
    return splits.holdout(d, "doc_id", 0.2, SEED, ["grp"])


def nested_sql(src: str, key: str = "doc_id") -> str:
    """SQL twin of ``splits.nested_holdout(.., 0.02, 0.25)``: the valid part
    is ceil(2/27 of the held rows), in integer arithmetic."""
    return f"""
WITH h1 AS ({_holdout_sql(src, key, '0.27', SEED, 'held', 'train')}),
h2 AS (SELECT {key}, rn2, count(*) OVER () AS n2 FROM
       (SELECT {key}, row_number() OVER (ORDER BY md5(concat('{SEED}', ':', CAST({key} AS VARCHAR))), {key}) - 1 AS rn2
        FROM h1 WHERE split = 'held') x)
SELECT {key}, 'train' AS split FROM h1 WHERE split = 'train'
UNION ALL
SELECT {key}, CASE WHEN rn2 < (2 * n2 + 26) // 27 THEN 'valid' ELSE 'test' END FROM h2
"""


_NESTED_SQL = nested_sql("documents")


@query("spl_04", _NESTED_SQL)
def spl_04(spark, sf_dir):
    """Nested three-way hold-out: valid 0.02, test 0.25 (stated fractions)."""
    from helixframe.plans.registry import table
    return splits.nested_holdout(table(spark, sf_dir, "documents", "doc_id"), "doc_id",
                                 0.02, 0.25, SEED)


_KFV_SQL = _REPEATS_SQL.replace("range(0, 5)", "range(0, 2)") + """,
idx AS (SELECT repeat, CAST(f.fold_no AS INTEGER) AS fold, row_id,
               CASE WHEN folds.fold = f.fold_no THEN 'test' ELSE 'train' END AS split
        FROM folds, (SELECT unnest(range(0, 5)) AS fold_no) f),
tr AS (SELECT *, row_number() OVER (PARTITION BY repeat, fold ORDER BY
                 md5(concat('1234', ':', CAST(repeat AS VARCHAR), ':', CAST(fold AS VARCHAR), ':',
                            CAST(row_id AS VARCHAR))), row_id) - 1 AS rn,
              count(*) OVER (PARTITION BY repeat, fold) AS n
       FROM idx WHERE split = 'train')
SELECT repeat, fold, row_id, CASE WHEN rn < CAST(ceil(0.1 * n) AS BIGINT) THEN 'valid' ELSE 'train' END AS split
FROM tr
UNION ALL SELECT repeat, fold, row_id, split FROM idx WHERE split = 'test'
"""


def _kfold_valid(spark, sf_dir, repeats=2):
    p = pairs(spark, sf_dir).select("row_id")
    idx = splits.split_index(splits.kfold(p, "row_id", 5, SEED, repeats=repeats), "row_id", 5)
    return splits.kfold_with_valid(idx, "row_id", 0.1, SEED)


@query("spl_05", _KFV_SQL)
def spl_05(spark, sf_dir):
    """5-fold x 2 repeats; 10% of each training part becomes validation."""
    return _kfold_valid(spark, sf_dir)


@query("spl_06", f"WITH fresh AS ({_NESTED_SQL}) SELECT split, count(*) AS n_rows FROM fresh GROUP BY split")
def spl_06(spark, sf_dir):
    """Split by priority with neither a stored fold nor a fixed split: a fresh
    nested hold-out; sizes per split."""
    from helixframe.plans.registry import table
    d = splits.resolve_split(table(spark, sf_dir, "documents", "doc_id"), "doc_id",
                             val_size=0.02, test_size=0.25, seed=SEED)
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@query("spl_06_fold", f"""
WITH kfv AS ({_REPEATS_SQL.replace("range(0, 5)", "range(0, 2)")} SELECT repeat, row_id, fold FROM folds),
part AS (SELECT row_id, CASE WHEN fold = 3 THEN 'test' ELSE 'train' END AS split FROM kfv WHERE repeat = 1),
tr AS (SELECT row_id, row_number() OVER (ORDER BY md5(concat('1234', ':', CAST(row_id AS VARCHAR))), row_id) - 1 AS rn,
              count(*) OVER () AS n FROM part WHERE split = 'train'),
sp AS (SELECT row_id, CASE WHEN rn < (n + 19) // 20 THEN 'valid' ELSE 'train' END AS split FROM tr
       UNION ALL SELECT row_id, split FROM part WHERE split = 'test')
SELECT row_id, split FROM sp
""")
def spl_06_fold(spark, sf_dir):
    """Split by priority with a stored (repeat, fold): that fold's test part,
    and 5% of its training part as validation."""
    p = pairs(spark, sf_dir).select("row_id")
    idx = splits.split_index(splits.kfold(p, "row_id", 5, SEED, repeats=2), "row_id", 5)
    return splits.resolve_split(p, "row_id", split_table=idx, repeat=1, fold=3, seed=SEED).select("row_id", "split")


@query("spl_06_fixed", f"""
WITH fixed AS ({_NESTED_SQL}) SELECT d.doc_id, d.lang, f.split FROM documents d JOIN fixed f ON d.doc_id = f.doc_id
""")
def spl_06_fixed(spark, sf_dir):
    """Split by priority with a stored fixed split."""
    from helixframe.plans.registry import table
    d = table(spark, sf_dir, "documents", "doc_id", "lang")
    fixed = splits.nested_holdout(d.select("doc_id"), "doc_id", 0.02, 0.25, SEED)
    return splits.resolve_split(d, "doc_id", fixed_split=fixed)


@query("spl_07", """
SELECT doc_id, n_chars FROM documents
ORDER BY md5(concat('7', ':', CAST(doc_id AS VARCHAR))), doc_id LIMIT 100
""")
def spl_07(spark, sf_dir):
    """Exactly 100 documents without replacement, seed 7 (a sampling operator:
    the limit is the feature)."""
    from helixframe.plans.registry import table
    return splits.exact_sample(table(spark, sf_dir, "documents", "doc_id", "n_chars"),
                               "doc_id", 100, seed=7)


_LAB_SPLIT_SQL = f"""
WITH {_PAIRS}, {_LAB}, {_FOLDS},
idx AS (SELECT 0 AS repeat, CAST(f.fold_no AS INTEGER) AS fold, row_id,
               CASE WHEN folds.fold = f.fold_no THEN 'test' ELSE 'train' END AS split
        FROM folds, (SELECT unnest(range(0, 5)) AS fold_no) f),
ls AS (SELECT i.repeat, i.fold, i.split, l.label, l.row_id FROM lab l JOIN idx i ON l.row_id = i.row_id)
"""


def _labelled_and_index(spark, sf_dir):
    p = pairs(spark, sf_dir)
    idx = splits.split_index(splits.kfold(p.select("row_id"), "row_id", 5, SEED), "row_id", 5)
    return reshape.unpivot_pairs(p, "surf_sequence", "deep_sequence"), idx


def _labelled_splits(spark, sf_dir):
    return reshape.attach_splits(*_labelled_and_index(spark, sf_dir))


@query("spl_08", _LAB_SPLIT_SQL + """
SELECT repeat, fold, split, label, count(*) AS n_rows FROM ls GROUP BY repeat, fold, split, label
""")
def spl_08(spark, sf_dir):
    """Labelled-row counts per (repeat, fold, split, label)."""
    return splits.split_sizes(_labelled_splits(spark, sf_dir))


@query("spl_09", _LAB_SPLIT_SQL + """
SELECT repeat, fold, count(*) AS n_pairs,
       CAST(sum(CASE WHEN ns > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaks
FROM (SELECT repeat, fold, row_id, count(DISTINCT split) AS ns FROM ls GROUP BY repeat, fold, row_id) t
GROUP BY repeat, fold
""")
def spl_09(spark, sf_dir):
    """Pairs on both sides of a split (must be 0 per fold)."""
    return splits.pair_leaks(_labelled_splits(spark, sf_dir))


@query("jon_01", _LAB_SPLIT_SQL + """
SELECT repeat, fold, split, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM (SELECT i.repeat, i.fold, i.split, l.text FROM lab l JOIN idx i ON l.row_id = i.row_id) t
GROUP BY repeat, fold, split
""")
def jon_01(spark, sf_dir):
    """Labelled rows x split index, all folds in one join."""
    d = _labelled_splits(spark, sf_dir)
    return d.groupBy("repeat", "fold", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.char_length("text")).cast("long").alias("n_chars"))


@query("jon_01_bucketed", _LAB_SPLIT_SQL + """
SELECT repeat, fold, split, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM (SELECT i.repeat, i.fold, i.split, l.text FROM lab l JOIN idx i ON l.row_id = i.row_id) t
GROUP BY repeat, fold, split
""")
def jon_01_bucketed(spark, sf_dir):
    """Labelled rows and split index stored bucketed on the row key: the join
    of all folds needs no exchange."""
    d = bucketed_join(spark, *_labelled_and_index(spark, sf_dir))
    return d.groupBy("repeat", "fold", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.char_length("text")).cast("long").alias("n_chars"))


def bucketed_join(spark, rows, index, buckets: int = 16):
    from helixframe.session import scratch_path
    from helixframe.sources.writers import write_bucketed
    stored = [write_bucketed(d, "row_id", buckets, scratch_path(spark, f"bucketed-{n}")) for d, n in ((rows, "rows"), (index, "index"))]
    return reshape.attach_splits(stored[0].hint("merge"), stored[1])


@query("flt_01", f"""
WITH {_PAIRS}, {_FOLDS}
SELECT p.row_id, length(p.surf_sequence) AS surf_len FROM pairs p
WHERE p.row_id IN (SELECT row_id FROM folds WHERE fold = 2)
""")
def flt_01(spark, sf_dir):
    """Rows at the positions of fold 2's test part (left semi join)."""
    p = pairs(spark, sf_dir)
    folds = splits.kfold(p.select("row_id"), "row_id", 5, SEED)
    sel = reshape.select_rows(p, folds.where(F.col("fold") == 2))
    return sel.select("row_id", F.char_length("surf_sequence").cast("long").alias("surf_len"))


@query("flt_02", f"""
WITH {_PAIRS}, {_LAB},
o AS (SELECT row_id, label, row_number() OVER (ORDER BY label, row_id) - 1 AS position,
             count(*) OVER () AS n FROM lab)
SELECT row_id, label, position FROM o
WHERE position >= CAST(floor(n * 0.72) AS BIGINT) AND position < CAST(floor(n * 0.8) AS BIGINT)
""")
def flt_02(spark, sf_dir):
    """Contiguous range [72%, 80%) of the labelled rows in reference order
    (label, row_id), with the bounds checked against the row count."""
    p = pairs(spark, sf_dir)
    lab = reshape.unpivot_pairs(p, "surf_sequence", "deep_sequence")
    o = reshape.position_by(lab.select("row_id", "label"), "label", "row_id")
    n = p.count() * 2
    start, end = int(n * 0.72), int(n * 0.8)
    return splits.range_subset(o, "position", start, end, n).select("row_id", "label", "position")


@query("set_01", f"""
WITH {_PAIRS}, {_LAB}
SELECT row_id, label, length(text) AS n_chars, md5(coalesce(text, '')) AS text_md5 FROM lab
""")
def set_01(spark, sf_dir):
    """Unpivot pairs to labelled rows: surface -> 0, deep -> 1."""
    lab = reshape.unpivot_pairs(pairs(spark, sf_dir), "surf_sequence", "deep_sequence")
    return lab.select("row_id", "label", F.char_length("text").cast("long").alias("n_chars"),
                      F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@query("set_02", f"""
WITH {_PAIRS}
SELECT row_id, 'surf_sequence' AS source_col, length(surf_sequence) AS n_chars FROM pairs
UNION ALL
SELECT row_id, 'deep_sequence' AS source_col, length(deep_sequence) AS n_chars FROM pairs
""")
def set_02(spark, sf_dir):
    """Append the two sequence columns into one (bag union)."""
    a = reshape.append_columns(pairs(spark, sf_dir), ["surf_sequence", "deep_sequence"])
    return a.select("row_id", "source_col", F.char_length("text").cast("long").alias("n_chars"))


@query("set_03", f"""
WITH sp AS ({_NESTED_SQL})
SELECT doc_id, split, row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END,
                                         doc_id) - 1 AS position
FROM sp
""")
def set_03(spark, sf_dir):
    """Train, valid, test concatenated with a running position."""
    from helixframe.plans.registry import table
    sp = splits.nested_holdout(table(spark, sf_dir, "documents", "doc_id"), "doc_id", 0.02, 0.25, SEED)
    return reshape.concat_splits(sp, "doc_id").select("doc_id", "split", "position")


@query("set_04", """
SELECT batch_id, count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS n_chars,
       min(doc_id) AS first_doc, max(doc_id) AS last_doc
FROM (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch_id FROM documents) t
GROUP BY batch_id
""")
def set_04(spark, sf_dir):
    """Documents cut into batches of 64 in id order; the last batch is short."""
    from helixframe.plans.registry import table
    b = reshape.batches(table(spark, sf_dir, "documents", "doc_id", "n_chars"), "doc_id", 64)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.sum("n_chars").cast("long").alias("n_chars"),
                                     F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("win_02", """
SELECT doc_id, row_number() OVER (ORDER BY md5(concat('99', ':', CAST(doc_id AS VARCHAR))), doc_id) - 1 AS rn
FROM documents
""")
def win_02(spark, sf_dir):
    """Global ordinal in md5 order from 4,096 hash buckets (no one-task sort)."""
    from helixframe.plans.registry import table
    d = table(spark, sf_dir, "documents", "doc_id").withColumn("_h", hash_key(99, "doc_id"))
    return ordinal_by_hash(d, "_h", ["doc_id"]).select("doc_id", "rn")
