"""The registered ``opN_<name>`` queries over the driver tables and, where SQL
can express the method, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import (
    bpe_counts,
    lang_fusion,
    line_bloom,
    linear_grouping,
    max_sketch,
    overlap_dsir,
    piece_nbest,
    pieces,
    quality_rules,
    simhash_bk,
    tiling_decontam,
    toxic_gru,
    url_alias,
    warc_chunks,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def query(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def piece_model() -> bytes:
    import public_tokenizers
    return pieces.read_model(public_tokenizers.path(PIECE_MODEL))


@query("op3_token_counts")
def op3(spark, sf_dir):
    return bpe_counts.token_counts(table(spark, sf_dir, "documents"), piece_model(), limit=4096)


@query("op5_piece_nbest")
def op5(spark, sf_dir):
    return piece_nbest.round_trip(table(spark, sf_dir, "documents"), piece_model(), n=2)


@query("op8_simhash_bk")
def op8(spark, sf_dir):
    return simhash_bk.near_duplicates(table(spark, sf_dir, "documents"), words_per=3, radius=2)


@query("op10_line_bloom", r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
line AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(1, 1 + len(parts))) AS pos FROM split),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
repeated AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) <> max(doc_id)),
marked AS (
  SELECT keyed.*, coalesce(first < doc_id, false) AS gone FROM keyed LEFT JOIN repeated ON keyed.k = repeated.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(array_to_string(list(line ORDER BY pos) FILTER (WHERE NOT gone), chr(10)), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op10(spark, sf_dir):
    kept = line_bloom.dedup_lines(table(spark, sf_dir, "documents"), shortest=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op7_quality_rules")
def op7(spark, sf_dir):
    return quality_rules.quality(table(spark, sf_dir, "documents"), tails=True).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op2_tiling_decontam")
def op2(spark, sf_dir):
    return tiling_decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


URL_RULES = url_alias.parse_rules([("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
                                   ("allow", "com/fr/"), ("block", "com/de/")])


@query("op1_url_alias")
def op1(spark, sf_dir):
    return url_alias.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query("op4_warc_chunks", """
WITH page AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
first AS (SELECT digest, min(page_id) AS f FROM page WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, page.digest AS payload_digest,
       CASE WHEN f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f <> page_id THEN f END AS refers_to, true AS intact
FROM page LEFT JOIN first ON page.digest = first.digest
""")
def op4(spark, sf_dir):
    return warc_chunks.round_trip(table(spark, sf_dir, "pages"))


@query("op9_lang_fusion")
def op9(spark, sf_dir):
    return lang_fusion.identify(table(spark, sf_dir, "documents"))


@query("op6_toxic_gru")
def op6(spark, sf_dir):
    return toxic_gru.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_linear_grouping")
def op11(spark, sf_dir):
    import public_tokenizers
    tokenizer = linear_grouping.read_tokenizer(public_tokenizers.path(BYTE_TOKENIZER))
    made = linear_grouping.pieces(table(spark, sf_dir, "documents"), tokenizer, capacity=2048, end_id=0)
    return linear_grouping.place(made.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=2048)


@query("op12_overlap_dsir")
def op12(spark, sf_dir):
    return overlap_dsir.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


@query("op13_max_sketch", r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
full_doc AS (SELECT r, doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM doc WHERE len(ts) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM full_doc),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM full_doc) GROUP BY r, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
item AS (
  SELECT item_id, t, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM benchmark) GROUP BY item_id, t),
weighed AS (
  SELECT item_id, item.t, q * CAST(floor(1000 * ln((2 * CAST(docs AS DOUBLE) + 2) / (2 * CAST(df AS DOUBLE) + 1))) AS BIGINT) AS w
  FROM item JOIN df ON item.t = df.t, total),
scored AS (
  SELECT item_id, tf.r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM weighed JOIN tf ON weighed.t = tf.t JOIN full_doc ON tf.r = full_doc.r, total GROUP BY item_id, tf.r),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scored JOIN full_doc ON scored.r = full_doc.r WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 10
""")
def op13(spark, sf_dir):
    return max_sketch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
