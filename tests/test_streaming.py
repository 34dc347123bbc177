"""Row operators on a file stream (availableNow), incremental with a checkpoint."""

import os

from pyspark.sql import functions as F

from helixframe.functions import text as T
from helixframe.streaming import run_available, stream_parquet


def _words(df):
    return df.select("doc_id", F.size(T.overlap_words("text", 5, 2)).alias("n_words"))


def test_stream_processes_new_files_once(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    sink, ckpt = os.path.join(tmp_dir, "sink"), os.path.join(tmp_dir, "ckpt")
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "ABCDEFGHIJ"), (2, "AB")], schema).write.parquet(os.path.join(src, "a"))
    out = run_available(spark, stream_parquet(spark, os.path.join(src, "a"), schema), _words, sink, ckpt)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 3), (2, 0)]
    # same source folder, one more file: only it is processed on the next run
    spark.createDataFrame([(3, "ABCDEFG")], schema).write.mode("append").parquet(os.path.join(src, "a"))
    out = run_available(spark, stream_parquet(spark, os.path.join(src, "a"), schema), _words, sink, ckpt)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 3), (2, 0), (3, 2)]
