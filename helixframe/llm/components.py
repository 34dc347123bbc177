"""Connected components of a large graph, by Spark joins and aggregates.

Large-star and small-star steps alternate until nothing changes: each node's
neighbours above it, then those below it, are linked to the smallest of all.
Every step is a grouped minimum (partial sums on the map side, so a node with
very many neighbours is no hot group) and a join; each round's edges are
written to the shared folder, and the driver sees one number per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import cut


def _star(both: DataFrame, larger: bool) -> DataFrame:
    """``both`` holds edges (node, other).  Each node's neighbours on one side
    are linked to the smallest of the node and all its neighbours."""
    if not larger:
        both = both.filter("other <= node")
    least = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("least"))
    linked = both.join(least, "node")
    if larger:
        out = linked.filter("other > node").select(F.col("other").alias("node"), F.col("least").alias("other"))
    else:
        out = linked.select(F.col("other").alias("node"), F.col("least").alias("other")).unionByName(
            least.select("node", F.col("least").alias("other")))
    return out.filter("node <> other")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for each node of ``edges`` (columns ``a, b`` of one
    orderable type; null ends and loops are left out): root is the smallest
    node that the node is connected with, itself included."""
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    held = cut(pairs.distinct(), "cc")
    sign = _sign(held)
    for _ in range(rounds):
        if sign[0] == 0:
            break
        both = held.unionByName(held.select(F.col("other").alias("node"), F.col("node").alias("other")))
        grown = _star(both, larger=True).distinct()
        held = cut(_star(grown, larger=False).distinct(), "cc")
        now = _sign(held)
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    # every edge is now (node, root)
    roots = held.select(F.col("other").alias("node")).distinct().withColumn("root", F.col("node"))
    return held.select("node", F.col("other").alias("root")).unionByName(roots)


def _sign(held: DataFrame) -> tuple[int, int]:
    """Number and checksum of the edges."""
    row = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1] or 0)
