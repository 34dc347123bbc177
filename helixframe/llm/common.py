"""Small helpers the operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.session import scratch_path

#: the ASCII white space that separates words: space, \t, \n, \v, \f, \r
ASCII_SPACE = " \t\n\x0b\x0c\r"
_SLICE = 512
_BATCH_ROWS = 1024


def worker_state(name: str, make: Callable):
    """A value kept for the life of a Python worker (caches, parsed models).

    The package's functions travel by value, so their module globals are new
    for every task; this lives in a module of its own in ``sys.modules``.
    """
    mod = sys.modules.setdefault("helixframe_worker_state", types.ModuleType("helixframe_worker_state"))
    if not hasattr(mod, name):
        setattr(mod, name, make())
    return getattr(mod, name)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: a reliable
    lineage cut, so a lost executor never recomputes what lies before it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, ``name`` if it can be."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a key for each row, and the key's name.  The rows are
    written with it, so it is the same wherever they are read."""
    key = fresh(df, "__row")
    return cut(df.withColumn(key, F.monotonically_increasing_id()), "row-keys"), key


def bounded_batches(df: DataFrame) -> None:
    """Rows with whole texts go to Python in Arrow batches of at most
    ``_BATCH_ROWS``: both sides hold a batch in memory, and the default of
    10,000 rows is for narrow ones.  A smaller setting of the session stays."""
    key, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession
    if not 0 < int(spark.conf.get(key)) <= _BATCH_ROWS:
        spark.conf.set(key, str(_BATCH_ROWS))


def docs_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str) -> DataFrame:
    """Only the columns an operator needs, under its own names, so extra
    columns of the input can neither clash nor be read."""
    bounded_batches(df)
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                     *[F.col(c).alias(a) for a, c in more.items()])


def by_rows(fn: Callable, names: list[str], out, done: Callable | None = None):
    """Body for ``mapInArrow``: ``fn(*columns as lists) -> dict of lists`` is
    called on slices of each Arrow batch, so few texts are Python objects at
    once.  ``out`` is the Arrow schema of the result; ``done`` is called when
    the task ends."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, _SLICE):
                    part = batch.slice(at, _SLICE)
                    cols = fn(*[part.column(part.schema.get_field_index(n)).to_pylist() for n in names])
                    yield pa.RecordBatch.from_pydict(cols, schema=out)
        finally:
            if done:
                done()
    return run


def arrow_schema(ddl_schema) -> object:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(ddl_schema)


def schema(ddl: str):
    from pyspark.sql.types import StructType
    return StructType.fromDDL(ddl)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
