"""Per-row operators on Structured Streaming sources.

The reference has no streams; the row-local operators (projections,
overlapping words, residue ids, padding to a fixed length) are plain Column
expressions, so the same functions run on a streaming DataFrame.  This module
wires a file source to a file sink with an exactly-once checkpoint under the
shared checkpoint folder.  Operators that need the whole table (vocabulary
fits, medians, batch-longest padding, ranks) are not streamable as such.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe.session import scratch_path


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def stream_parquet(spark: SparkSession, path: str, schema: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A parquet file/folder as a streaming source with an explicit schema."""
    r = spark.readStream.schema(schema)
    if _is_file(spark, path):
        # a single file: the stream source watches its folder, filtered to it
        folder, name = path.rsplit("/", 1)
        r = r.option("basePath", folder).option("pathGlobFilter", name)
        path = folder
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def run_available(spark: SparkSession, stream: DataFrame, transform: Callable[[DataFrame], DataFrame],
                  sink_path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Apply a row-wise ``transform`` to everything the source holds now
    (``availableNow`` trigger), append it to a parquet sink, and return the
    sink as a batch DataFrame.  Rerunning with the same checkpoint processes
    only new files."""
    sink_path = sink_path or scratch_path(spark, "stream-sink")
    checkpoint = checkpoint or scratch_path(spark, "stream-ckpt")
    q = (transform(stream).writeStream.format("parquet").option("path", sink_path)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.parquet(sink_path)
