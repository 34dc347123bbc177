"""Inputs the operators expect, derived from the driver tables, each with its
SQL twin (a CTE body) for the oracles.  See SURVEY 7.3 for the mapping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans.registry import table

SEED = 1234

# row_id = conv_id * 2^32 + turn: no two turns share it (a conv_id of 2^31 or
# more fails as an overflow, it does not collide)
PAIR_STRIDE = 1 << 32

# ---- pair table (F1): a user turn and the assistant turn that answers it ----

PAIRS_SQL = """
SELECT conv_id * 4294967296 + turn AS row_id, text AS surf_sequence, next_text AS deep_sequence
FROM (SELECT conv_id, turn, role, text,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
             lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
      FROM conversations) t
WHERE role = 'user' AND next_role = 'assistant'
"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, surf_sequence, deep_sequence)``: one user turn and the next
    assistant turn of a conversation.

    Turns are numbered 0..n-1 in each conversation, so "the next turn" is an
    equi-join on ``(conv_id, turn + 1)``.  Those keys are unique, so a very
    long conversation spreads over many tasks, where a ``lead()`` window per
    conversation would put all of it in one.  (The SQL twin uses ``lead()``
    and so also checks the numbering.)
    """
    conv = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    user = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("surf_sequence"))
    nxt = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"),
                      F.col("text").alias("deep_sequence"))
    return (user.join(nxt, ["conv_id", "turn"])
            .where(F.col("next_role") == "assistant")
            .select((F.col("conv_id") * F.lit(PAIR_STRIDE) + F.col("turn")).alias("row_id"), "surf_sequence", "deep_sequence"))


def labelled_sql(pairs_cte: str = "pairs") -> str:
    return f"""
SELECT row_id, 0 AS label, surf_sequence AS text FROM {pairs_cte}
UNION ALL
SELECT row_id, 1 AS label, deep_sequence AS text FROM {pairs_cte}
"""


def kfold_sql(src: str, key: str, k: int, seed: int | str, extra_partition: str = "") -> str:
    """K-fold by md5 order, the SQL twin of ``splits.kfold``."""
    part = f"PARTITION BY {extra_partition}" if extra_partition else ""
    seed_expr = f"'{seed}'" if isinstance(seed, int) else seed
    return f"""
SELECT *, CAST(CASE WHEN rn < (n % {k}) * (n // {k} + 1) THEN rn // (n // {k} + 1)
               ELSE (n % {k}) + (rn - (n % {k}) * (n // {k} + 1)) // (n // {k}) END AS INTEGER) AS fold
FROM (SELECT *, row_number() OVER ({part} ORDER BY md5(concat({seed_expr}, ':', CAST({key} AS VARCHAR))), {key}) - 1 AS rn,
             count(*) OVER ({part}) AS n
      FROM {src}) r
"""


# ---- scored rows (F9): labels joined to documents ----

SCORED_SQL = """
SELECT l.doc_id, l.quality AS label, d.lang, d.n_chars,
       (d.n_chars % 97) / 97.0 AS score,
       (d.n_chars % 97) / 10.0 AS logit1
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, label, lang, n_chars, score, logit1)``; logits are
    ``(0, logit1)``.  ``n_chars % 97`` gives many ties."""
    lab = table(spark, sf_dir, "labels", "doc_id", "quality")
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "n_chars")
    return (lab.join(docs, "doc_id")
            .select("doc_id", F.col("quality").alias("label"), "lang", "n_chars",
                    (F.pmod(F.col("n_chars"), F.lit(97)) / 97.0).alias("score"),
                    (F.pmod(F.col("n_chars"), F.lit(97)) / 10.0).alias("logit1")))


# ---- regression pairs (F10): lineitem quantities ----

REGRESSION_SQL = """
SELECT l_orderkey * 10 + l_linenumber AS row_id, l_returnflag AS grp,
       l_quantity AS y, l_discount * 500 AS yhat
FROM lineitem
"""


def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag",
               "l_quantity", "l_discount")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
                     F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("y"),
                     (F.col("l_discount") * 500).alias("yhat"))


# ---- metric records (F12): events as (model, epoch, metric, value) ----

METRIC_RECORDS_SQL = """
SELECT 'events' AS dataset, event_type AS model, CAST(user_id % 5 AS INTEGER) AS fold,
       CAST(day(ts) AS INTEGER) AS epoch,
       CASE WHEN event_id % 2 = 0 THEN 'auroc' ELSE 'auprc' END || ' [' ||
       CASE WHEN event_id % 3 = 0 THEN 'deep' ELSE 'surface' END || ']' AS metric,
       value
FROM events
"""


def metric_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(dataset, model, fold, epoch, metric, value)`` long metric table; metric
    names follow the ``metric [task]`` form, two tasks per metric prefix."""
    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    name = F.concat(F.when(F.pmod("event_id", F.lit(2)) == 0, F.lit("auroc")).otherwise(F.lit("auprc")),
                    F.lit(" ["),
                    F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit("deep")).otherwise(F.lit("surface")),
                    F.lit("]"))
    return ev.select(F.lit("events").alias("dataset"), F.col("event_type").alias("model"),
                     F.pmod("user_id", F.lit(5)).cast("int").alias("fold"),
                     F.dayofmonth("ts").cast("int").alias("epoch"), name.alias("metric"),
                     F.col("value"))
