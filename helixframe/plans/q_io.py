"""Queries: sources and sinks as round trips through files under the shared
checkpoint folder (SRC, SNK, JON-02)."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions.text import overlap_string, strip_non_word
from helixframe.operators import reshape, splits
from helixframe.plans import sqlparts as Q
from helixframe.plans.inputs import (METRIC_RECORDS_SQL, PAIR_STRIDE, PAIRS_SQL, SEED, metric_records, pairs)
from helixframe.plans.q_splits import _KFV_SQL, _kfold_valid, nested_sql
from helixframe.plans.q_tokens import _WP_ENC_SQL, _WP_WORDS_SQL, _wp_vocab
from helixframe.plans.registry import query, table
from helixframe.session import scratch_path
from helixframe.sources import readers as RD
from helixframe.sources import tokenizer_file as TF
from helixframe.sources import writers as WR

_STRIP = "regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"


def _strip_sql(x: str) -> str:
    return _STRIP.format(x=x)


@query("src_01", f"""
WITH pairs AS ({PAIRS_SQL})
SELECT row_number() OVER (ORDER BY CAST(row_id // 429496729600 AS VARCHAR), row_id) - 1 AS row_id,
       length(surf_sequence) AS surf_len, md5(surf_sequence) AS surf_md5, md5(deep_sequence) AS deep_md5
FROM pairs
""")
def src_01(spark, sf_dir):
    """Pair table written as CSV with dotted headers (one file per chunk of
    conversations), read back with an explicit schema; row_id = position."""
    p = pairs(spark, sf_dir).withColumn("chunk", F.expr(f"row_id div {100 * PAIR_STRIDE}"))
    out = scratch_path(spark, "pairs-csv")
    w = p.select("chunk", "row_id", F.col("surf_sequence").alias("surf.sequence"),
                 F.col("deep_sequence").alias("deep.sequence"))
    # the files hold only the two sequence columns, as the reference's does
    ordered = w.repartition("chunk").sortWithinPartitions("chunk", "row_id").drop("row_id")
    ordered.write.option("header", True).partitionBy("chunk").csv(out)
    back = RD.read_pair_csv(spark, out, multiline=True)  # turns may hold line breaks
    return back.select("row_id", F.char_length("surf_sequence").cast("long").alias("surf_len"),
                       F.md5("surf_sequence").alias("surf_md5"), F.md5("deep_sequence").alias("deep_md5"))


_REC_SQL = f"""
SELECT row_number() OVER (ORDER BY CAST(doc_id // 100 AS VARCHAR), doc_id) - 1 AS row_id,
       {_strip_sql("'>doc' || CAST(doc_id AS VARCHAR) || ' ' || lang")} AS yeast_id,
       md5({_strip_sql("regexp_replace(text, '\\r\\n|\\r|\\n', ' ', 'g')")}) AS reference_md5,
       {_strip_sql("source || ' ' || CAST(n_chars AS VARCHAR)")} AS evolved_sequence
FROM documents
"""


@query("src_02", _REC_SQL)
def src_02(spark, sf_dir):
    """Documents written as three-line records (id line with '>' and spaces,
    text on one line, a third line), read back with non-word characters
    stripped; row_id numbers records across files in path order."""
    d = reshape.spread_rows(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars"))
    d = d.select(F.floor(F.col("doc_id") / 100).alias("chunk"), "doc_id",
                 F.concat(F.lit(">doc"), F.col("doc_id").cast("string"), F.lit(" "), F.col("lang")).alias("l1"),
                 F.replace(F.replace(F.replace("text", F.lit("\r\n"), F.lit(" ")), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" ")).alias("l2"),
                 F.concat_ws(" ", F.col("source"), F.col("n_chars").cast("string")).alias("l3"))
    out = scratch_path(spark, "records")
    WR.write_three_line_records(d, out, "l1", "l2", "l3", file_col="chunk", order=["doc_id"])
    r = RD.read_three_line_records(spark, out)
    return r.select("row_id", "yeast_id", F.md5("reference_sequence").alias("reference_md5"), "evolved_sequence")


def _fasta_dir(spark, sf_dir):
    d = reshape.spread_rows(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    d = d.select(F.floor(F.col("doc_id") / 100).alias("chunk"), "doc_id", F.col("lang").alias("id"),
                 F.concat(F.lit("doc="), F.col("doc_id").cast("string"), F.lit(" source="), F.col("source")).alias("desc"),
                 strip_non_word("text").alias("seq"))
    out = scratch_path(spark, "fasta")
    WR.write_fasta(d, out, "id", "seq", file_col="chunk", order=["doc_id"], desc_col="desc")
    return out


_FIRST_SQL = f"""
WITH f AS (SELECT doc_id // 100 AS chunk, min(doc_id) AS first_doc FROM documents GROUP BY doc_id // 100),
firsts AS (SELECT f.chunk, d.lang AS id, {_strip_sql('d.text')} AS seq
           FROM f JOIN documents d ON d.doc_id = f.first_doc)
"""


@query("src_03", _FIRST_SQL + "SELECT CAST(chunk AS INTEGER) AS chunk, id, md5(seq) AS seq_md5 FROM firsts")
def src_03(spark, sf_dir):
    """FASTA folder (one file per 100 documents, id = language, wrapped at 60):
    the first record of every file."""
    r = RD.read_fasta_first(spark, _fasta_dir(spark, sf_dir))
    return r.select(F.regexp_extract("path", r"chunk=(\d+)", 1).cast("int").alias("chunk"), "id",
                    F.md5("seq").alias("seq_md5"))


@query("jon_02", _FIRST_SQL + """
SELECT id, md5(arg_max(seq, CAST(chunk AS VARCHAR))) AS seq_md5 FROM firsts GROUP BY id
""")
def jon_02(spark, sf_dir):
    """id -> sequence map over the first FASTA records; the later file path
    wins for an id seen in several files."""
    m = RD.fasta_map(RD.read_fasta_first(spark, _fasta_dir(spark, sf_dir)))
    return m.select("id", F.md5("seq").alias("seq_md5"))


@query("src_04", f"WITH kfv AS ({_KFV_SQL}) SELECT repeat, fold, row_id, split FROM kfv WHERE repeat = 1 AND fold = 3")
def src_04(spark, sf_dir):
    """Split index stored partitioned by (repeat, fold); one fold loaded with
    partition pruning."""
    out = scratch_path(spark, "splits")
    WR.write_split_index(_kfold_valid(spark, sf_dir), out)
    return RD.read_split_index(spark, out, repeat=1, fold=3).select("repeat", "fold", "row_id", "split")


@query("src_04_npy", f"WITH kfv AS ({_KFV_SQL}) SELECT repeat, fold, row_id, split FROM kfv")
def src_04_npy(spark, sf_dir):
    """All folds' positions stored as .npy arrays (one or more a repeat, fold
    and split) and read back by byte ranges."""
    out = scratch_path(spark, "splits-npy")
    WR.write_npy_splits(_kfold_valid(spark, sf_dir), out)
    return RD.read_npy_splits(spark, out)


@query("src_03_all", f"""
SELECT CAST(doc_id // 100 AS INTEGER) AS chunk, CAST(row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS INTEGER) AS rec,
       lang AS id, 'doc=' || CAST(doc_id AS VARCHAR) || ' source=' || source AS description, md5({_strip_sql('text')}) AS seq_md5
FROM documents
""")
def src_03_all(spark, sf_dir):
    """Every record of the FASTA folder with its number in its file."""
    r = RD.read_fasta_all(spark, _fasta_dir(spark, sf_dir))
    return r.select(F.regexp_extract("path", r"chunk=(\d+)", 1).cast("int").alias("chunk"), "rec", "id", "description",
                    F.md5("seq").alias("seq_md5"))


@query("snk_04", f"WITH kfv AS ({_KFV_SQL}) SELECT repeat, fold, split, count(*) AS n_rows FROM kfv GROUP BY repeat, fold, split")
def snk_04(spark, sf_dir):
    """Persist a split assignment (parquet by repeat/fold) and read it all back."""
    out = scratch_path(spark, "splits")
    WR.write_split_index(_kfold_valid(spark, sf_dir), out)
    back = RD.read_split_index(spark, out)
    return back.groupBy("repeat", "fold", "split").agg(F.count(F.lit(1)).alias("n_rows"))


@query("src_05", f"""
WITH dl AS (SELECT l.doc_id, l.quality, l.toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
sp AS ({nested_sql('dl')}),
t AS (SELECT doc_id, 'quality' AS task, quality AS target FROM dl
      UNION ALL SELECT doc_id, 'toxic' AS task, toxic AS target FROM dl)
SELECT sp.split, t.task, count(*) AS n, CAST(sum(t.target) AS BIGINT) AS n_pos
FROM sp JOIN t ON sp.doc_id = t.doc_id GROUP BY sp.split, t.task
""")
def src_05(spark, sf_dir):
    """Benchmark set with its own split (train/valid/test) and two targets
    (quality, toxic): rows and positives per split and task."""
    lab = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    docs = table(spark, sf_dir, "documents", "doc_id")
    ds = lab.join(docs, "doc_id")
    sp = splits.nested_holdout(ds, "doc_id", 0.02, 0.25, SEED)
    long = sp.selectExpr("doc_id", "split", "stack(2, 'quality', quality, 'toxic', toxic) AS (task, target)")
    return long.groupBy("split", "task").agg(F.count(F.lit(1)).alias("n"), F.sum("target").cast("long").alias("n_pos"))


@query("src_05_stored", f"""
WITH dl AS (SELECT l.doc_id, l.quality, l.toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
sp AS ({nested_sql('dl')})
SELECT sp.split, dl.quality, dl.toxic, count(*) AS n FROM sp JOIN dl ON sp.doc_id = dl.doc_id GROUP BY ALL
""")
def src_05_stored(spark, sf_dir):
    """Benchmark set with a stored split: its index lists (.npy) are read and
    joined to the rows with their two targets."""
    ds = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").join(table(spark, sf_dir, "documents", "doc_id"), "doc_id")
    out = scratch_path(spark, "benchmark-split")
    sp = splits.nested_holdout(ds, "doc_id", 0.02, 0.25, SEED)
    WR.write_npy_splits(sp.select(F.lit(0).alias("repeat"), F.lit(0).alias("fold"), F.col("doc_id").alias("row_id"), "split"), out)
    stored = RD.read_npy_splits(spark, out).select(F.col("row_id").alias("doc_id"), "split")
    return ds.join(stored, "doc_id").groupBy("split", "quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("src_06", f"WITH {_WP_WORDS_SQL[1:]} SELECT token, id FROM vocab")
def src_06(spark, sf_dir):
    """Vocabulary loaded from a tokenizer JSON file (written by SNK-05 from
    the WordPiece vocabulary)."""
    base = scratch_path(spark, "vocab")
    WR.write_vocab(_wp_vocab(spark, sf_dir), base + "/parquet", json_path=base + "/json")
    return RD.read_vocab_json(spark, base + "/json")


@query("src_06_file", _WP_ENC_SQL + f"SELECT doc_id, len(ids) AS n_ids, {Q.md5_ints('ids')} AS ids_md5 FROM enc")
def src_06_file(spark, sf_dir):
    """Documents encoded by a whole tokenizer file (normaliser, pre-tokeniser,
    special tokens, model), written with the trained vocabulary and read back."""
    path = scratch_path(spark, "tokenizer")
    TF.write_tokenizer(_wp_vocab(spark, sf_dir), path)
    docs = reshape.spread_rows(table(spark, sf_dir, "documents", "doc_id", "text"))
    ids = TF.read_tokenizer(spark, path).ids(spark, overlap_string("text", 2, 0))
    e = docs.select("doc_id", ids.alias("ids"))
    return e.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


@query("snk_05", f"WITH {_WP_WORDS_SQL[1:]} SELECT token, id FROM vocab")
def snk_05(spark, sf_dir):
    """Vocabulary saved as parquet (token, id) and read back."""
    base = scratch_path(spark, "vocab")
    WR.write_vocab(_wp_vocab(spark, sf_dir), base + "/parquet")
    return spark.read.parquet(base + "/parquet")


@query("snk_01", """
SELECT doc_id, n_chars FROM documents
ORDER BY md5(concat('7', ':', CAST(doc_id AS VARCHAR))), doc_id LIMIT 100
""")
def snk_01(spark, sf_dir):
    """The 100-document sample written as CSV without an index, read back."""
    s = splits.exact_sample(table(spark, sf_dir, "documents", "doc_id", "n_chars"), "doc_id", 100, seed=7)
    out = scratch_path(spark, "sample-csv")
    WR.write_csv(s, out)
    return spark.read.schema("doc_id long, n_chars long").option("header", True).csv(out)


@query("snk_02", f"""
WITH mr AS ({METRIC_RECORDS_SQL})
SELECT dataset, model, metric, count(*) AS n, round(avg(value), 6) AS mean FROM mr GROUP BY dataset, model, metric
""")
def snk_02(spark, sf_dir):
    """Metric records written as JSON per (dataset, model), read back and
    summarised."""
    out = scratch_path(spark, "metrics")
    mr = metric_records(spark, sf_dir).withColumn("split", F.lit("test")).withColumn("task", F.lit(None).cast("string"))
    WR.write_metric_records(mr, out)
    back = RD.read_metric_records(spark, out)
    return back.groupBy("dataset", "model", "metric").agg(F.count(F.lit(1)).alias("n"),
                                                          F.round(F.avg("value"), 6).alias("mean"))


@query("snk_02_files", f"""
WITH mr AS ({METRIC_RECORDS_SQL})
SELECT dataset || '/' || model || '_test_' || CAST(fold AS VARCHAR) || '.json' AS file, count(*) AS n, round(sum(value), 6) AS total
FROM mr GROUP BY dataset, model, fold
""")
def snk_02_files(spark, sf_dir):
    """Metric records as one JSON file for each (dataset, model, split, run),
    committed in two phases; rows and sum of each file read back."""
    out = scratch_path(spark, "metric-files")
    WR.write_metric_files(metric_records(spark, sf_dir).withColumn("split", F.lit("test")), out)
    back = spark.read.schema("value double").option("recursiveFileLookup", True).json(out)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1)
    return back.groupBy(name.alias("file")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("snk_03", """
SELECT vec_id, label, len(embedding) AS dim,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total
FROM embeddings
""")
def snk_03(spark, sf_dir):
    """Embeddings (float arrays) with labels to parquet and back."""
    out = scratch_path(spark, "arrays")
    WR.write_arrays(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), out)
    back = spark.read.parquet(out)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return back.select("vec_id", "label", F.size("embedding").cast("long").alias("dim"), F.round(total, 6).alias("total"))
