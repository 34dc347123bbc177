"""Every registered query against its DuckDB oracle at sf0.001 (the driver's
correctness gate, run locally on the smallest tables)."""

import os
import sys

import duckdb
import pytest

from conftest import SF001

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from oracle_check import TABLES, rows_of  # noqa: E402
from type_check import spark_type  # noqa: E402

import __spark_entry__ as E  # noqa: E402

QS, SQL = E.queries(), E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(QS))
def test_query_matches_oracle(spark, con, key):
    df = QS[key](spark, SF001)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    if key not in SQL:
        assert len(cols) > 0
        return
    rel = con.sql(SQL[key])
    ocols = rel.columns
    assert sorted(cols) == sorted(ocols)
    assert {f.name: spark_type(f.dataType) for f in df.schema.fields} == \
        {n: str(t) for n, t in zip(rel.columns, rel.types)}
    assert rows_of(cols, rows) == rows_of(ocols, rel.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["fold", "label", "n_texts", "n_words", "n_word_chars"]
