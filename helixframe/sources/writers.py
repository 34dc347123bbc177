"""Writers (SNK-01..05 and the text formats the readers take).

Paths should live under the shared checkpoint folder
(:func:`helixframe.session.scratch_path`) or a table location; never a
machine-local folder on a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.sources import byte_ranges


def write_csv(df: DataFrame, path: str, file_col: str | None = None, order: list[str] | None = None) -> None:
    """Comma-separated text with a header, no index column (SNK-01).  With
    ``file_col`` each value gets its own folder and file, rows in ``order``."""
    w = df
    if file_col:
        w = w.repartition(file_col)
    if order:
        w = w.sortWithinPartitions(*([file_col] if file_col else []), *order)
    writer = w.write.option("header", True).mode("errorifexists")
    if file_col:
        writer = writer.partitionBy(file_col)
    writer.csv(path)


def write_three_line_records(df: DataFrame, path: str, id_line: str, ref_line: str, evo_line: str,
                             file_col: str, order: list[str]) -> None:
    """One record = three lines; ``file_col`` chooses the file."""
    text = F.concat_ws("\n", F.col(id_line), F.col(ref_line), F.col(evo_line)).alias("value")
    (df.select(file_col, *order, text).repartition(file_col).sortWithinPartitions(file_col, *order)
     .select(file_col, "value").write.partitionBy(file_col).mode("errorifexists").text(path))


def fasta_text(id_col, seq_col, desc_col=None, width: int = 60):
    """``>id desc`` then the sequence wrapped at ``width`` characters."""
    header = F.concat(F.lit(">"), F.coalesce(F.col(id_col), F.lit("")))
    if desc_col is not None:  # a record without a description has none, it is not lost
        header = F.concat_ws(" ", header, F.col(desc_col))
    wrapped = F.regexp_replace(F.coalesce(F.col(seq_col), F.lit("")), f"(.{{{width}}})(?=.)", "$1\n")
    return F.concat(header, F.lit("\n"), wrapped)


def write_fasta(df: DataFrame, path: str, id_col: str, seq_col: str, file_col: str,
                order: list[str], desc_col: str | None = None, width: int = 60) -> None:
    """FASTA files, one per ``file_col`` value, records in ``order``."""
    text = fasta_text(id_col, seq_col, desc_col, width).alias("value")
    (df.select(file_col, *order, text).repartition(file_col).sortWithinPartitions(file_col, *order)
     .select(file_col, "value").write.partitionBy(file_col).mode("errorifexists").text(path))


def write_metric_records(df: DataFrame, path: str) -> None:
    """Metric records as JSON lines, one folder per (dataset, model, split)
    (SNK-02: the reference writes one file per model, split and run)."""
    df.write.partitionBy("dataset", "model", "split").mode("errorifexists").json(path)


def write_arrays(df: DataFrame, path: str) -> None:
    """Array columns (embeddings, attributions) to parquet (SNK-03)."""
    df.write.mode("errorifexists").parquet(path)


def write_split_index(df: DataFrame, path: str) -> None:
    """Split index partitioned by (repeat, fold) so a reader of one fold
    touches one folder (SNK-04).  Rows are rebalanced by folder: small folders
    share tasks, and a folder above the advisory partition size is written by
    several tasks into several files."""
    (df.select("row_id", "split", F.col("repeat").cast("int"), F.col("fold").cast("int"))
     .hint("rebalance", "repeat", "fold").write.partitionBy("repeat", "fold").mode("errorifexists").parquet(path))


def write_bucketed(df: DataFrame, key: str, buckets: int, path: str) -> DataFrame:
    """``df`` as a table bucketed and sorted on ``key`` under ``path``, read
    back (JON-01): joins of such tables on the key, with the same number of
    buckets, need no exchange, however often they are repeated.  Equal keys
    share a bucket, so the key should be one that few rows share."""
    import uuid
    name = f"helix_bucketed_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def write_npy_splits(df: DataFrame, path: str) -> None:
    """Split positions as ``.npy`` arrays (SNK-04), in folders
    ``repeat=<r>/fold=<f>``: ``<split>_split-<task>.npy``, with ``valid``
    named ``val``.  Rows are rebalanced by folder, so a large split is several
    arrays; the files appear when all tasks have succeeded."""
    byte_ranges.save(df.select(F.col("repeat").cast("int"), F.col("fold").cast("int"), F.col("row_id").cast("long"),
                               F.when(F.col("split") == "valid", "val").otherwise(F.col("split")).alias("split"))
                     .hint("rebalance", "repeat", "fold"), "helix_npy", path)


def write_metric_files(df: DataFrame, path: str, run_col: str = "fold") -> None:
    """Metric records as one JSON-lines file for each dataset, model, split
    and run (SNK-02): ``<dataset>/<model>_<split>_<run>.json``.  A run's records
    are few and go to one task; a task that fails or runs twice leaves no
    second file."""
    name = F.concat_ws("", *[x for c, end in (("dataset", "/"), ("model", "_"), ("split", "_"), (run_col, ".json"))
                             for x in (F.url_encode(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(end))])
    named = df.select(name.alias("file"), F.to_json(F.struct(*df.columns)).alias("line"))
    byte_ranges.save(named.repartition("file").sortWithinPartitions("file", "line"), "helix_files", path)


def write_vocab(vocab: DataFrame, path: str, json_path: str | None = None, max_entries: int = 1_000_000) -> None:
    """Vocabulary as parquet ``(token, id)`` (SNK-05); optionally also as a
    tokenizer-style JSON object ``{"model": {"vocab": {...}}}``.  The JSON
    form is one object in one file by its format, so its size is checked first
    (``max_entries``); the parquet form has no bound."""
    vocab.select("token", F.col("id").cast("int")).write.mode("errorifexists").parquet(path)
    if json_path:
        if vocab.limit(max_entries + 1).count() > max_entries:
            raise ValueError("vocabulary too large for a single JSON object")
        obj = vocab.agg(F.map_from_entries(F.collect_list(F.struct("token", F.col("id").cast("int")))).alias("vocab"))
        (obj.select(F.to_json(F.struct(F.struct("vocab").alias("model"))).alias("value"))
         .coalesce(1).write.mode("errorifexists").text(json_path))
