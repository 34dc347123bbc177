"""Readers (SRC-01..06).  Explicit schemas everywhere; no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions.text import NON_WORD, explode_items
from helixframe.operators.reshape import latest_by
from helixframe.sources import byte_ranges

# Python's universal newlines: \r\n, \r and \n all end a line.
LINE_BREAK = r"\r\n|\r|\n"


def with_file_position(df: DataFrame, out: str = "row_id") -> DataFrame:
    """0-based position of each row in file order (files by path, rows in
    file order), the pandas row index of the reference.

    Works for whole-file scans (``multiLine`` CSV, ``wholetext``) and for
    scans that split large files: rows of one split are read by one task in
    order, so they have consecutive ``monotonically_increasing_id`` values,
    and the offset of each (file, split) comes from a table with one row per
    split.
    """
    d = df.select("*", F.col("_metadata.file_path").alias("_fp"),
                  F.col("_metadata.file_block_start").alias("_blk"),
                  F.monotonically_increasing_id().alias("_mid"))
    splits_t = d.groupBy("_fp", "_blk").agg(F.count(F.lit(1)).alias("_c"), F.min("_mid").alias("_m0"))
    before = Window.orderBy("_fp", "_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits_t.select("_fp", "_blk", "_m0", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    return (d.join(offsets, ["_fp", "_blk"])
            .withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("long"))
            .drop("_fp", "_blk", "_mid", "_m0", "_off"))


def read_pair_csv(spark: SparkSession, path: str, first: str = "surf.sequence",
                  second: str = "deep.sequence", out_first: str = "surf_sequence",
                  out_second: str = "deep_sequence", with_row_id: bool = True,
                  multiline: bool = False) -> DataFrame:
    """Pair table from comma-separated text with a header (SRC-01).  Dotted
    header names are renamed on read; ``row_id`` is the file position.
    Large files are split between tasks, unless ``multiline`` asks for quoted
    fields with line breaks (each file is then parsed by one task)."""
    schema = T.StructType([T.StructField(first, T.StringType()), T.StructField(second, T.StringType())])
    df = (spark.read.schema(schema).option("header", True).option("multiLine", multiline)
          .option("enforceSchema", False).csv(path))
    df = df.select(F.col(f"`{first}`").alias(out_first), F.col(f"`{second}`").alias(out_second))
    if with_row_id:
        df = with_file_position(df)
        df = df.select("row_id", out_first, out_second)
    return df


def line_numbers(lines: DataFrame, out: str = "line_no") -> DataFrame:
    """0-based line number inside its file for a ``spark.read.text`` scan that
    may split large files.

    Each split (``_metadata.file_block_start``) is read by one task in file
    order, so rows of a split have consecutive ``monotonically_increasing_id``
    values; a split's first line number is the line count of the earlier
    splits of the same file, from a table with one row per split.
    """
    d = lines.select("*", F.col("_metadata.file_path").alias("path"),
                     F.col("_metadata.file_block_start").alias("_blk"),
                     F.monotonically_increasing_id().alias("_mid"))
    per_split = d.groupBy("path", "_blk").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    before = Window.partitionBy("path").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_split.select("path", "_blk", "_m0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (d.join(offsets, ["path", "_blk"])
            .withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("long"))
            .drop("_blk", "_mid", "_m0", "_off"))


def read_three_line_records(spark: SparkSession, path: str, names=("yeast_id", "reference_sequence",
                                                                   "evolved_sequence"),
                            keep_partial: bool = False, whole_files: bool = False,
                            split_bytes: int | None = None) -> DataFrame:
    """Three-line records (SRC-02): lines 3k, 3k+1, 3k+2 of each file are one
    record; non-word characters are stripped from every line (Unicode-aware).
    Lines end at ``\n``, ``\r\n`` or ``\r``, as Python's universal newlines.

    Byte ranges of the files (``split_bytes``) are read by tasks of their own,
    each from the first record that starts in it; see
    :mod:`helixframe.sources.byte_ranges`; no row is shuffled.
    ``whole_files=True`` reads each file as one row and cuts it with array
    functions (for paths that only Spark opens).  A short last record (the
    reference's IndexError) is dropped; with ``keep_partial`` it is returned
    with NULLs for the missing lines.  ``row_id`` numbers records across files
    in path order.
    """
    if whole_files:
        return _records_whole_files(spark, path, names, keep_partial)
    recs = byte_ranges.load(spark, "helix_line_triples", path, split_bytes, keepPartial=str(keep_partial).lower())
    return recs.select("row_id", *[F.regexp_replace(F.col(f"line_{k}"), NON_WORD, "").alias(c) for k, c in enumerate(names)])


def _records_whole_files(spark, path, names, keep_partial) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    lines = F.split(F.col("value"), LINE_BREAK)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    d = raw.select(F.col("_metadata.file_path").alias("path"), lines.alias("lines"))
    n = F.size("lines")
    n_rec = F.ceil(n / 3) if keep_partial else F.floor(n / 3)
    recs = F.transform(F.sequence(F.lit(0), n_rec.cast("int") - 1),
                       lambda i: F.struct(*[F.get(F.col("lines"), i * 3 + k).alias(names[k]) for k in range(3)]))
    recs = F.when(n_rec > 0, recs).otherwise(F.array())
    ex = explode_items(d, recs, "r", keep=["path"], with_pos="rec")
    files = d.select("path", n_rec.cast("long").alias("_nr"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("path", F.coalesce(F.sum("_nr").over(before), F.lit(0)).alias("_off"))
    out = ex.join(offsets, "path")
    return out.select((F.col("_off") + F.col("rec")).cast("long").alias("row_id"),
                      *[F.regexp_replace(F.col(f"r.{c}"), NON_WORD, "").alias(c) for c in names])


def partial_records(spark: SparkSession, path: str) -> DataFrame:
    """Files whose line count is not a multiple of three, with the number of
    lines left over (what ``read_three_line_records`` dropped)."""
    raw = spark.read.text(path, wholetext=True)
    lines = F.split(F.col("value"), LINE_BREAK)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return (raw.select(F.col("_metadata.file_path").alias("path"), (F.size(lines) % 3).alias("left_over"))
            .where("left_over > 0"))


# One rule for both FASTA modes: a header is a line that begins with ">"; what
# stands before the first header of a file is no record; a record's other
# lines are joined without white space.
_HEADER = r"(?:\A|(?<=[\r\n]))>"


def read_fasta_first(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """First FASTA record of every file in a folder (SRC-03):
    ``(id, seq, path)``.  Reading a file stops at its second header."""
    if whole_files:
        return read_fasta_all(spark, path, True).where(F.col("rec") == 0).select("id", "seq", "path")
    return byte_ranges.load(spark, "helix_fasta_first", path).select("id", "seq", "path")


def read_fasta_all(spark: SparkSession, path: str, whole_files: bool = False,
                   split_bytes: int | None = None) -> DataFrame:
    """Every FASTA record of every file: ``(id, description, seq, path, rec)``
    with ``rec`` the 0-based record number in its file and the id the first
    word after ``>``.

    Byte ranges of the files are read by tasks of their own, each from the
    first header in it; a table of the headers in each range gives the record
    numbers.  Nothing is shuffled (a record is one row of the result, so it
    must fit in one).  ``whole_files=True`` reads each file as one row (for
    paths that only Spark opens); both give the same records."""
    if whole_files:
        raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
        parts = F.split("value", _HEADER)
        ex = explode_items(raw.select(F.col("_metadata.file_path").alias("path"),
                                      F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("_recs")),
                           F.col("_recs"), "body", keep=["path"], with_pos="rec")
        header = F.regexp_extract("body", r"\A([^\r\n]*)", 1)
        return ex.where(F.col("body").isNotNull()).select(
            F.regexp_extract(header, r"^(\S*)", 1).alias("id"),
            F.trim(F.regexp_extract(header, r"^\S*\s*(.*)$", 1)).alias("description"),
            F.regexp_replace(F.regexp_replace("body", r"\A[^\r\n]*", ""), r"\s+", "").alias("seq"),
            "path", F.col("rec").cast("int").alias("rec"))
    return byte_ranges.load(spark, "helix_fasta", path, split_bytes)


def fasta_map(records: DataFrame) -> DataFrame:
    """id -> sequence where the later path wins (JON-02, Q16)."""
    return latest_by(records, "id", "seq", "path")


def read_npy(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """Rows of the ``.npy`` arrays below ``path`` (SRC-04): ``(path, position,
    value)``, ``value`` a number, or an array of them for a table.  A huge
    array is read by several tasks; nothing is unpickled."""
    return byte_ranges.load(spark, "helix_npy", path, split_bytes)


def read_npy_splits(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """Split positions stored as ``train_split.npy``, ``val_split.npy`` and
    ``test_split.npy`` (SRC-04), in one folder or in folders
    ``repeat=<r>/fold=<f>``: ``(repeat, fold, row_id, split)``.  A split may
    have several files (``train_split-00001.npy``); ``val`` reads as
    ``valid``; without such folders repeat and fold are 0."""
    name = F.regexp_extract("path", r"([a-z]+)_split[^/]*\.npy$", 1)
    number = lambda key: F.coalesce(F.regexp_extract("path", rf"/{key}=(\d+)/", 1).try_cast("int"), F.lit(0))
    return read_npy(spark, path, split_bytes).select(
        number("repeat").alias("repeat"), number("fold").alias("fold"), F.col("value").alias("row_id"),
        F.when(name == "val", "valid").otherwise(name).alias("split"))


def read_split_index(spark: SparkSession, path: str, repeat: int | None = None,
                     fold: int | None = None) -> DataFrame:
    """Stored split positions (SRC-04), pruned to one (repeat, fold) by the
    partition folders."""
    df = spark.read.schema("row_id long, split string, repeat int, fold int").parquet(path)
    if repeat is not None:
        df = df.where(F.col("repeat") == repeat)
    if fold is not None:
        df = df.where(F.col("fold") == fold)
    return df


def read_vocab_json(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary from a tokenizer JSON file (SRC-06): ``model.vocab`` map
    exploded to ``(token, id)``."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", "model struct<vocab: map<string, int>>").alias("j"))
    return parsed.select(F.explode("j.model.vocab").alias("token", "id"))


def read_metric_records(spark: SparkSession, path: str) -> DataFrame:
    """Metric records written by ``write_metric_records`` (partition folders
    dataset=/model=/split=)."""
    schema = "split string, fold int, epoch int, task string, metric string, value double, dataset string, model string"
    return spark.read.schema(schema).json(path)
