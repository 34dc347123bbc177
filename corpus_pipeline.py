"""Corpus pipeline: the documents table through five of the operators.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stages
before it kept; its result is written to the shared folder and read again as
the next one's documents.  All but the last return the columns of documents.
The keys that a stage takes out are written before the anti join, so the
planner knows their size when it chooses between a broadcast and a shuffle of
the texts.  Every stage judges rows by their own texts and carries its verdicts
by a row key, so neither a null id nor a repeated one stands for another
document.  SQL can express neither the
fitted language model nor the hashes of the fingerprints, so there is no
ORACLE_SQL;
``tests/llm/test_pipeline.py`` holds the stages against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import lang_fusion, line_bloom, piece_nbest, simhash_bk, tiling_decontam
from helixframe.llm.common import cut, with_row_key
from helixframe.llm.queries import piece_model, table

#: words that the segmentation keeps in a worker, which serves all stages
CACHE_ENTRIES = 300_000
#: segmentations of each document, as many as op5_piece_nbest finds
N_BEST = 2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (9): documents that it rejects go.  The documents' declared
    language and source are evidence beside the text; rows keep their own
    ``lang``."""
    rows, key = with_row_key(docs)
    rejected = cut(lang_fusion.identify(rows, id_col=key).filter("NOT kept").select(F.col(key).alias("__bad")), "rejected")
    return rows.join(rejected, rows[key] == rejected["__bad"], "left_anti").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (10): later occurrences of a line that several documents
    hold leave the texts; ``n_chars`` follows the text where there is one."""
    kept = line_bloom.dedup_lines(docs, n_lines="__n_lines", n_dropped="__n_dropped")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, F.length("text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (8): of each group of linked rows one stays, that
    with the smallest id (null ids last; of rows with one id, any of them)."""
    rows, key = with_row_key(docs)
    # a row's name: ordered by id, then by row, so the smallest of a group is one row
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("row"))
    members = simhash_bk.near_duplicates(rows.select(name.alias("doc_id"), "text"))
    later = cut(members.filter("doc_id <> component_id").select(F.col("doc_id.row").alias("__bad")), "later-copies")
    return rows.join(later, rows[key] == later["__bad"], "left_anti").select(*docs.columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (2): documents that hold a benchmark item go."""
    return tiling_decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding (5): each document with the ids of
    its best segmentation, its N best ones' scores and the others' ids, whether
    the best decodes to its text, and, as the vocabulary's scores are merge
    ranks, the ids that its own library gives."""
    return piece_nbest.encode(docs, piece_model(), n=N_BEST, keep=("lang", "source"), cache_entries=CACHE_ENTRIES, compare=True).select(
        "doc_id", "lang", "source", "ids", "scores", "alternatives", "library_ids", "decoded_ok")


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_copies),
    ("decontamination", clean_of_benchmark),
    ("sentencepiece", segmented),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
