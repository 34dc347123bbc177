"""Plan checks used by the tests: where rows meet one task, and where rows go
through Python."""

from __future__ import annotations

from pyspark.sql import DataFrame

PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
                "PythonUDF", "MapInArrow")
REDUCERS = ("Aggregate", "Limit", "TakeOrdered", "LocalTableScan")


def plan_text(df: DataFrame) -> str:
    """Physical plan with its exchanges (AQE's initial plan when adaptive)."""
    qe = df._jdf.queryExecution()
    plan = qe.executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    return plan.treeString()


def _subtrees(text: str, marker: str):
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if marker in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            sub = []
            for nxt in lines[i + 1:]:
                if len(nxt) - len(nxt.lstrip(" :+-")) <= depth:
                    break
                sub.append(nxt)
            yield line, sub


def raw_single_partition_exchanges(df: DataFrame) -> list[str]:
    """``Exchange SinglePartition`` nodes whose input was not reduced first
    (no aggregate or limit below them): all raw rows would meet in one task."""
    bad = []
    for line, sub in _subtrees(plan_text(df), "Exchange SinglePartition"):
        if not any(r in s for s in sub for r in REDUCERS):
            bad.append(line.strip())
    return bad


def python_nodes(df: DataFrame) -> list[str]:
    """Plan nodes that evaluate Python."""
    return [ln.strip() for ln in plan_text(df).splitlines() if any(p in ln for p in PYTHON_NODES)]
