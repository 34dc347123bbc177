"""Row generators for user code (UDF-04): a Python table function with a
planned schema over a table argument."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def generate_rows(df: DataFrame, make: Callable[[object], Iterable[tuple]], returns: str, keep: Sequence[str] = (),
                  partition_by: Sequence[str] = (), order_by: Sequence[str] = ()) -> DataFrame:
    """For every row of ``df`` its ``keep`` columns with each tuple that
    ``make(row)`` gives, named and typed by ``returns``.

    The result's columns are planned from the table's before anything runs.
    Without ``partition_by`` rows are worked on where they are; with it the
    rows of a key come to one task, one after another in ``order_by`` order,
    each key with a fresh copy of ``make`` if that is a class (so it may hold state: give keys of
    bounded size), and what its ``finish`` method returns follows."""
    wanted, table_schema = StructType.fromDDL(returns), df.schema
    kept = StructType([table_schema[c] for c in keep])
    clash = set(kept.names) & set(wanted.names)
    if clash:
        raise ValueError(f"generated columns {sorted(clash)} are kept ones, too")
    stateful = isinstance(make, type)

    class Generator:
        @staticmethod
        def analyze(table):
            from pyspark.sql.udtf import AnalyzeResult
            return AnalyzeResult(schema=StructType([*kept.fields, *wanted.fields]))

        def __init__(self):
            self.make, self.last = make() if stateful else make, ()

        def eval(self, row):
            self.last = tuple(row[c] for c in keep)
            for made in self.make(row) or ():
                yield (*self.last, *made)

        def terminate(self):
            end = getattr(self.make, "finish", None) if stateful else None
            for made in end() if end else ():
                yield (*self.last, *made)

    table = df.asTable()
    if partition_by:
        table = table.partitionBy(*partition_by)
        if order_by:
            table = table.orderBy(*order_by)
    return F.udtf(Generator)(table)
