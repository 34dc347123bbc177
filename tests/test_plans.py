"""Plan checks (SURVEY 5(e)): no single-task exchange over raw rows, no
Python in expression operators, pruning reaches the scan."""

import pytest

from conftest import SF001
from helixframe.plans import QUERIES
from helixframe.plans.inspect import plan_text, python_nodes, raw_single_partition_exchanges

# operators that must stay JVM-side (expression / aggregate / window kinds)
JVM_ONLY = ["flagship", "spl_01", "spl_02", "spl_03", "spl_04", "spl_05", "spl_08", "spl_09", "jon_01",
            "set_01", "set_03", "set_04", "win_01", "win_02", "win_03", "win_04", "met_01", "met_03",
            "met_04", "met_05", "met_08", "met_11", "agg_01", "agg_03", "tok_01", "tok_02", "tok_03",
            "tok_05", "tok_06", "tok_12", "tok_13", "tok_16", "prj_03", "prj_04", "vec_01", "vec_03"]

# queries whose plans can be built without running writes or fits
PLANNABLE = [k for k in QUERIES if not k.startswith(("src_", "snk_", "ml_", "jon_02"))
             and k not in ("tok_09", "tok_10", "tok_11", "tok_01_stream", "vec_05")]


@pytest.mark.parametrize("key", JVM_ONLY)
def test_no_python_in_expression_operators(spark, key):
    assert python_nodes(QUERIES[key](spark, SF001)) == []


@pytest.mark.parametrize("key", PLANNABLE)
def test_no_single_task_exchange_over_raw_rows(spark, key):
    assert raw_single_partition_exchanges(QUERIES[key](spark, SF001)) == []


def test_column_pruning_reaches_scan(spark):
    text = plan_text(QUERIES["spl_03"](spark, SF001))
    assert "ReadSchema: struct<doc_id:bigint>" in text or "struct<doc_id:bigint>" in text


def test_naive_global_window_is_detected(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = spark.range(100).withColumn("rn", F.row_number().over(Window.orderBy("id")))
    assert raw_single_partition_exchanges(df)  # the checker sees the anti-pattern
