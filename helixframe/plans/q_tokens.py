"""Queries: projections, tokenisation, vocabularies, encodings and the UDF
surface (PRJ, TOK, JON-03/04, TOP-03, UDF-01/02/04)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from helixframe.functions import text as T
from helixframe.operators import reshape, splits
from helixframe.operators import tokens as K
from helixframe.operators.generators import generate_rows
from helixframe.plans import sqlparts as Q
from helixframe.plans.inputs import PAIRS_SQL, SEED, kfold_sql, labelled_sql, pairs
from helixframe.plans.registry import query, table

_PAIRS = f"pairs AS ({PAIRS_SQL})"
_LAB = f"lab AS ({labelled_sql()})"


def _docs(spark, sf_dir, *cols):
    """Documents, spread over the cluster: whole texts are the heavy part."""
    return reshape.spread_rows(table(spark, sf_dir, "documents", "doc_id", *(cols or ("text",))))


def _md5_join(arr, sep=","):
    return F.md5(F.array_join(arr, sep))


# ---------------- projections ----------------

@query("prj_01", f"WITH {_PAIRS} SELECT row_id, surf_sequence AS surf, length(deep_sequence) AS deep_len FROM pairs")
def prj_01(spark, sf_dir):
    """Column pick through a dotted name (`surf.sequence`)."""
    p = pairs(spark, sf_dir).withColumnRenamed("surf_sequence", "surf.sequence") \
        .withColumnRenamed("deep_sequence", "deep.sequence")
    return p.select("row_id", F.col("`surf.sequence`").alias("surf"),
                    F.char_length(F.col("`deep.sequence`")).cast("long").alias("deep_len"))


@query("prj_02", f"WITH {_PAIRS} SELECT row_id, length(surf_sequence) AS surf_len, length(deep_sequence) AS deep_len FROM pairs")
def prj_02(spark, sf_dir):
    """String length columns."""
    p = pairs(spark, sf_dir)
    return p.select("row_id", F.char_length("surf_sequence").cast("long").alias("surf_len"),
                    F.char_length("deep_sequence").cast("long").alias("deep_len"))


_STRIP_SQL = "regexp_replace(text, '[^\\p{L}\\p{N}_]+', '', 'g')"


@query("prj_03", f"SELECT doc_id, length({_STRIP_SQL}) AS n_chars, md5({_STRIP_SQL}) AS text_md5 FROM documents")
def prj_03(spark, sf_dir):
    """Strip non-word characters (Unicode-aware, accents kept)."""
    s = T.strip_non_word("text")
    return _docs(spark, sf_dir).select("doc_id", F.char_length(s).cast("long").alias("n_chars"), F.md5(s).alias("text_md5"))


@query("prj_04", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       TRY_CAST(value AS DECIMAL(12, 2)) AS value_dec FROM events
""")
def prj_04(spark, sf_dir):
    """Cast to declared types: JSON field to INT, value to DECIMAL(12,2)."""
    ev = table(spark, sf_dir, "events", "event_id", "props", "value")
    return ev.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"),
                     F.col("value").try_cast("decimal(12,2)").alias("value_dec"))


@query("prj_05", """
SELECT doc_id, length(text) AS n_chars, length(substring(text, 1, 1024)) AS n_kept,
       md5(substring(text, 1, 1024)) AS kept_md5 FROM documents
""")
def prj_05(spark, sf_dir):
    """Keep the first 1,024 characters (the operator truncates; the whole
    text is read, its full length reported alongside)."""
    s = F.substring("text", 1, 1024)
    return _docs(spark, sf_dir).select("doc_id", F.char_length("text").cast("long").alias("n_chars"),
                                       F.char_length(s).cast("long").alias("n_kept"), F.md5(s).alias("kept_md5"))


@query("prj_06", """
SELECT doc_id, least(length(text), 2046) AS n_kept, length(text) > 2046 AS was_truncated,
       md5(substring(text, 1, 2046)) AS kept_md5 FROM documents
""")
def prj_06(spark, sf_dir):
    """Cap at 2,046 characters with a truncation flag."""
    n = F.char_length("text")
    return _docs(spark, sf_dir).select("doc_id", F.least(n, F.lit(2046)).cast("long").alias("n_kept"),
                                       (n > 2046).alias("was_truncated"),
                                       F.md5(F.substring("text", 1, 2046)).alias("kept_md5"))


@query("prj_07", f"WITH {_PAIRS}, {_LAB} SELECT label, count(*) AS n_rows FROM lab GROUP BY label")
def prj_07(spark, sf_dir):
    """Constant class label per source column (0 surface, 1 deep)."""
    lab = reshape.unpivot_pairs(pairs(spark, sf_dir), "surf_sequence", "deep_sequence")
    return lab.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))


@query("prj_08", """
SELECT event_id, CASE WHEN ends_with(raw, 'm') THEN raw ELSE raw || 'm' END AS model_size
FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) || 'm'
                            ELSE CAST(user_id AS VARCHAR) END AS raw FROM events) t
""")
def prj_08(spark, sf_dir):
    """Model-size alias: append 'm' when missing."""
    ev = table(spark, sf_dir, "events", "event_id", "user_id")
    raw = F.when(F.pmod("event_id", F.lit(2)) == 0, F.concat(F.col("user_id").cast("string"), F.lit("m"))) \
        .otherwise(F.col("user_id").cast("string"))
    return ev.select("event_id", T.add_m_suffix(raw).alias("model_size"))


# ---------------- overlapping words ----------------

@query("tok_01", f"""
SELECT doc_id, len(w) AS n_words, md5(array_to_string(w, '|')) AS words_md5
FROM (SELECT doc_id, {Q.overlap_words('text', 5, 2)} AS w FROM documents) t
""")
def tok_01(spark, sf_dir):
    """Overlapping words (5, 2) of every document, whole text."""
    w = T.overlap_words("text", 5, 2)
    return _docs(spark, sf_dir).select("doc_id", F.size(w).cast("long").alias("n_words"), _md5_join(w, "|").alias("words_md5"))


@query("tok_02", f"SELECT doc_id, md5({Q.overlap_string('text', 4, 1)}) AS text_md5 FROM documents")
def tok_02(spark, sf_dir):
    """Overlapping words (4, 1) joined by spaces."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.overlap_string("text", 4, 1)).alias("text_md5"))


# ---------------- character vocabulary ----------------

_SPLIT_SQL = f"""sp AS (SELECT doc_id, CASE WHEN rn < CAST(ceil(0.1 * n) AS BIGINT) THEN 'test' ELSE 'train' END AS split
     FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('{SEED}', ':', CAST(doc_id AS VARCHAR))), doc_id) - 1 AS rn,
                  count(*) OVER () AS n FROM documents) r)"""


def _char_vocab_sql(where: str = "") -> str:
    return f"""
cc AS (SELECT doc_id, pos, substring(t, pos, 1) AS token
       FROM (SELECT d.doc_id, lower(d.text) AS t, unnest(range(1, length(lower(d.text)) + 1)) AS pos
             FROM documents d {where}) x),
cv AS (SELECT token, CAST(row_number() OVER (ORDER BY count(*) DESC, min(doc_id * 100000000 + pos)) AS INTEGER) AS id,
              count(*) AS count FROM cc GROUP BY token)"""


def _char_vocab(spark, sf_dir, train_only: bool = False):
    d = _docs(spark, sf_dir)
    if train_only:
        d = splits.holdout(d, "doc_id", 0.1, SEED).where(F.col("split") == "train")
    return K.fit_char_vocab(d, "text", ["doc_id"])


@query("tok_03", f"WITH {_char_vocab_sql()[1:]} SELECT token, id, count FROM cv")
def tok_03(spark, sf_dir):
    """Character vocabulary: lower-case, id 1 = most frequent, ties by first
    appearance (doc order, then position)."""
    return _char_vocab(spark, sf_dir)


_ENC_SQL = f"""
WITH {_SPLIT_SQL}, {_char_vocab_sql("JOIN sp ON d.doc_id = sp.doc_id WHERE sp.split = 'train'")[1:]},
ec AS (SELECT doc_id, pos, substring(t, pos, 1) AS token
       FROM (SELECT doc_id, lower(text) AS t, unnest(range(1, length(lower(text)) + 1)) AS pos FROM documents) x),
enc AS (SELECT d.doc_id, coalesce(list(cv.id ORDER BY ec.pos) FILTER (WHERE cv.id IS NOT NULL), []::INTEGER[]) AS ids
        FROM documents d LEFT JOIN ec ON d.doc_id = ec.doc_id LEFT JOIN cv ON ec.token = cv.token
        GROUP BY d.doc_id)
"""


def _encoded(spark, sf_dir):
    m = K.vocab_map(_char_vocab(spark, sf_dir, train_only=True))
    return _docs(spark, sf_dir).select("doc_id", K.encode_chars("text", m).alias("ids"),
                                       F.char_length("text").alias("n_chars"))


@query("tok_04", _ENC_SQL + f"SELECT doc_id, len(ids) AS n_ids, {Q.md5_ints('ids')} AS ids_md5 FROM enc")
def tok_04(spark, sf_dir):
    """Encode every document with the vocabulary fitted on the training split."""
    e = _encoded(spark, sf_dir)
    return e.select("doc_id", F.size("ids").cast("long").alias("n_ids"), _md5_join("ids").alias("ids_md5"))


@query("jon_03", _ENC_SQL + """
SELECT doc_id, len(ids) AS n_known, (SELECT length(text) FROM documents x WHERE x.doc_id = enc.doc_id) - len(ids) AS n_dropped
FROM enc
""")
def jon_03(spark, sf_dir):
    """Token -> id lookup with unknown characters dropped: kept and dropped
    counts per document."""
    return _encoded(spark, sf_dir).select("doc_id", F.size("ids").cast("long").alias("n_known"),
                                          (F.col("n_chars") - F.size("ids")).cast("long").alias("n_dropped"))


def _keras_class() -> str:
    return "[" + "".join({"\t": "\\t", "\n": "\\n"}.get(c, "\\" + c)
                         for c in K.KERAS_FILTERS).replace("'", "''") + "]"


@query("tok_03_word", f"""
WITH ws AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '{_keras_class()}', ' ', 'g'), ' '),
                                       lambda x: x <> '') AS w FROM documents),
ww AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM ws)
SELECT token, CAST(row_number() OVER (ORDER BY count(*) DESC, min(doc_id * 100000000 + pos)) AS INTEGER) AS id,
       count(*) AS count
FROM ww GROUP BY token
""")
def tok_03_word(spark, sf_dir):
    """Word vocabulary (Keras default filters, lower-case, split on spaces):
    id 1 = most frequent word, ties by first appearance."""
    return K.fit_word_vocab(_docs(spark, sf_dir), "text", ["doc_id"])


@query("top_03", f"WITH {_char_vocab_sql()[1:]} SELECT token, id FROM cv WHERE id < 20")
def top_03(spark, sf_dir):
    """Vocabulary capped to ids below 20 (Keras num_words)."""
    return K.cap_vocab(_char_vocab(spark, sf_dir), 20).select("token", "id")


@query("tok_05", _ENC_SQL + f"""
, p AS (SELECT doc_id, CASE WHEN len(ids) > 64 THEN ids[len(ids) - 63:] ELSE ids END AS cut FROM enc)
SELECT doc_id, {Q.md5_ints("list_concat(cut, list_transform(range(64 - len(cut)), lambda x: 0))")} AS post_pre_md5,
       {Q.md5_ints("list_concat(list_transform(range(64 - len(ids[1:64])), lambda x: 0), ids[1:64])")} AS pre_post_md5
FROM p JOIN enc USING (doc_id)
""")
def tok_05(spark, sf_dir):
    """Pad or cut encoded documents to 64: (padding post, truncating pre)
    and (pre, post)."""
    e = _encoded(spark, sf_dir)
    return e.select("doc_id",
                    _md5_join(T.pad_truncate("ids", 64, "post", "pre")).alias("post_pre_md5"),
                    _md5_join(T.pad_truncate("ids", 64, "pre", "post")).alias("pre_post_md5"))


@query("tok_06", f"WITH {_PAIRS} SELECT greatest(max(length(surf_sequence)), max(length(deep_sequence))) AS max_len FROM pairs")
def tok_06(spark, sf_dir):
    """Longest sequence over both columns."""
    return K.longest(pairs(spark, sf_dir), ["surf_sequence", "deep_sequence"])


@query("tok_07", f"""
WITH {_PAIRS}, {_LAB}, folds AS ({kfold_sql('pairs', 'row_id', 5, SEED)})
SELECT CAST(floor(median(length({Q.overlap_string('l.text', 2, 0)}))) AS INTEGER) AS model_max_length
FROM lab l JOIN folds f ON l.row_id = f.row_id WHERE f.fold <> 0
""")
def tok_07(spark, sf_dir):
    """Integer median length of the (2,0) word strings of fold 0's training
    rows (the reference's model_max_length)."""
    p = splits.kfold(pairs(spark, sf_dir), "row_id", 5, SEED)
    lab = reshape.unpivot_pairs(p, "surf_sequence", "deep_sequence", keep=["fold"])
    train = lab.where(F.col("fold") != 0).select(T.overlap_string("text", 2, 0).alias("s"))
    return K.median_length(train, "s")


# ---------------- BERT normaliser, WordPiece ----------------

@query("tok_08", f"""
SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT doc_id, {Q.bert_pretokenize(Q.bert_normalize('text'))} AS t FROM documents) x
""")
def tok_08(spark, sf_dir):
    """BERT clean + lower-case + accent strip, split on spaces and punctuation."""
    t = K.bert_pretokenize(K.bert_normalize(F.col("text")))
    return _docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"),
                                       F.md5(F.array_join(t, " ")).alias("tokens_md5"))


_WP_WORDS_SQL = f"""
ww AS (SELECT doc_id, {Q.bert_pretokenize(Q.bert_normalize(Q.overlap_string('text', 2, 0)))} AS words FROM documents),
wc AS (SELECT word, count(*) AS c FROM (SELECT unnest(words) AS word FROM ww) u GROUP BY word),
alpha AS (SELECT DISTINCT substring(word, 1, 1) AS tok, 0 AS kind FROM wc
          UNION SELECT '##' || substring(word, 2, 1), 1 FROM wc WHERE length(word) = 2),
specials AS (SELECT s AS tok, CAST(i - 1 AS BIGINT) AS id FROM
             (SELECT unnest({Q.SPECIALS_LIST}) AS s, unnest(range(1, 6)) AS i) z),
alpha_ids AS (SELECT tok, 4 + row_number() OVER (ORDER BY kind, tok) AS id FROM alpha),
merges AS (SELECT word AS tok, (SELECT count(*) FROM alpha) + 4 +
                  row_number() OVER (ORDER BY c DESC, substring(word, 1, 1), '##' || substring(word, 2, 1)) AS id
           FROM wc WHERE length(word) = 2),
vocab AS (SELECT tok AS token, CAST(id AS INTEGER) AS id FROM specials UNION ALL
          SELECT tok, CAST(id AS INTEGER) FROM alpha_ids UNION ALL SELECT tok, CAST(id AS INTEGER) FROM merges)
"""


def _wp_words(spark, sf_dir):
    """Raw (accents kept) BERT words of the (2,0) word string of each document."""
    s = T.overlap_string("text", 2, 0)
    return _docs(spark, sf_dir).select("doc_id", K.bert_raw_words(s).alias("words"))


def _wp_vocab(spark, sf_dir):
    words = T.explode_items(_wp_words(spark, sf_dir), F.col("words"), "word")
    raw_counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    return K.train_wordpiece(K.strip_word_counts(raw_counts), vocab_size=30000)


@query("tok_09", f"WITH {_WP_WORDS_SQL[1:]} SELECT token, id FROM vocab")
def tok_09(spark, sf_dir):
    """WordPiece vocabulary trained on the (2,0) word strings of all
    documents (specials, alphabet, then merges by frequency)."""
    return _wp_vocab(spark, sf_dir)


_WP_ENC_SQL = f"""
WITH {_WP_WORDS_SQL[1:]},
ex AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM ww),
enc AS (SELECT w.doc_id, coalesce(list(v.id ORDER BY ex.pos) FILTER (WHERE v.id IS NOT NULL), []::INTEGER[]) AS ids
        FROM ww w LEFT JOIN ex ON w.doc_id = ex.doc_id LEFT JOIN vocab v ON v.token = ex.word
        GROUP BY w.doc_id)
"""


def _wp_encoded(spark, sf_dir):
    vocab = _wp_vocab(spark, sf_dir)
    return _wp_words(spark, sf_dir).select("doc_id", K.wordpiece_ids("words", vocab).alias("ids"))


@query("tok_10", _WP_ENC_SQL + f"SELECT doc_id, len(ids) AS n_ids, {Q.md5_ints('ids')} AS ids_md5 FROM enc")
def tok_10(spark, sf_dir):
    """WordPiece-encode every document with the trained vocabulary."""
    e = _wp_encoded(spark, sf_dir)
    return e.select("doc_id", F.size("ids").cast("long").alias("n_ids"), _md5_join("ids").alias("ids_md5"))


@query("tok_11", _WP_ENC_SQL + f"""
, b AS (SELECT doc_id, len(ids) AS n_ids, ids[1:256] AS cut,
              (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch_id FROM enc),
m AS (SELECT *, max(len(cut)) OVER (PARTITION BY batch_id) AS batch_max FROM b)
SELECT doc_id, batch_id, CAST(n_ids AS BIGINT) AS n_ids,
       {Q.md5_ints("list_concat(list_transform(range(batch_max - len(cut)), lambda x: 1), cut)")} AS input_ids_md5,
       {Q.md5_ints("list_concat(list_transform(range(batch_max - len(cut)), lambda x: 0), list_transform(cut, lambda x: 1))")} AS mask_md5
FROM m
""")
def tok_11(spark, sf_dir):
    """Truncate right at 256, pad left with [PAD] (id 1) to the longest row
    of each batch of 64, with the attention mask.  Whole documents are
    encoded (``n_ids``); the model input is then cut, as the tokenizer does."""
    e = _wp_encoded(spark, sf_dir).withColumn("cut", F.slice("ids", 1, 256)) \
        .withColumn("n_ids", F.size("ids").cast("long"))
    b = reshape.batches(e, "doc_id", 64)
    b = reshape.longest_in_batch(b.withColumn("_n", F.size("cut")), "_n")
    ids, mask = K.pad_left_truncate_right("cut", F.col("batch_max"), pad_id=1)
    return b.select("doc_id", "batch_id", "n_ids", _md5_join(ids).alias("input_ids_md5"),
                    _md5_join(mask).alias("mask_md5"))


# ---------------- residue tokens ----------------

def _residues(spark, sf_dir):
    seq = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return _docs(spark, sf_dir).select("doc_id", seq.alias("seq"))


_RES_IDS_SQL = f"list_transform({Q.chars('seq')}, lambda c: coalesce(list_position({Q.ESM_LIST}, c) - 1, 3))"
_RES_SQL = f"WITH r AS (SELECT doc_id, {Q.residue_seq('text')} AS seq FROM documents), ri AS (SELECT doc_id, seq, {_RES_IDS_SQL} AS body FROM r)"


@query("tok_12", _RES_SQL + f" SELECT doc_id, len(body) + 2 AS n_ids, {Q.md5_ints('list_concat([0], body, [2])')} AS ids_md5 FROM ri")
def tok_12(spark, sf_dir):
    """Residue tokens with <cls>/<eos> markers through the ESM-2 alphabet."""
    r = _residues(spark, sf_dir).select("doc_id", K.residue_ids("seq").alias("ids"))
    return r.select("doc_id", F.size("ids").cast("long").alias("n_ids"), _md5_join("ids").alias("ids_md5"))


@query("jon_04", _RES_SQL + " SELECT doc_id, len(list_filter(body, lambda x: x <> 3)) AS n_known, len(list_filter(body, lambda x: x = 3)) AS n_unknown FROM ri")
def jon_04(spark, sf_dir):
    """Residue alphabet remap: known and <unk> counts per document."""
    r = _residues(spark, sf_dir).select("doc_id", K.residue_ids("seq", bos=None, eos=None).alias("b"))
    return r.select("doc_id", F.size(F.filter("b", lambda x: x != 3)).cast("long").alias("n_known"),
                    F.size(F.filter("b", lambda x: x == 3)).cast("long").alias("n_unknown"))


@query("tok_13", _RES_SQL + f"""
SELECT doc_id, {Q.md5_ints("list_concat([0], list_transform(range(greatest(len(body), 0)), lambda x: 1), [2])")} AS baseline_md5 FROM ri
""")
def tok_13(spark, sf_dir):
    """Attribution baseline rows: <cls>, <pad> x (n-2), <eos>."""
    r = _residues(spark, sf_dir).select("doc_id", K.residue_ids("seq").alias("ids"))
    return r.select("doc_id", _md5_join(K.baseline_ids("ids")).alias("baseline_md5"))


@query("tok_14", _RES_SQL + f" SELECT doc_id, {Q.md5_ints('body')} AS body_md5 FROM ri")
def tok_14(spark, sf_dir):
    """Per-position values with the marker positions dropped (here the ids)."""
    r = _residues(spark, sf_dir).select("doc_id", K.residue_ids("seq").alias("ids"))
    return r.select("doc_id", _md5_join(K.drop_markers("ids")).alias("body_md5"))


@query("tok_15", _RES_SQL + f" SELECT doc_id, md5(array_to_string(list_transform(list_concat([0], body, [2]), lambda i: {Q.ESM_LIST}[i + 1]), '')) AS tokens_md5 FROM ri")
def tok_15(spark, sf_dir):
    """Ids back to tokens with the inverse alphabet."""
    r = _residues(spark, sf_dir).select("doc_id", K.residue_ids("seq").alias("ids"))
    return r.select("doc_id", F.md5(F.array_join(K.ids_to_tokens("ids"), "")).alias("tokens_md5"))


@query("tok_16", f"""
WITH r AS (SELECT doc_id, {Q.residue_seq('text')} AS seq FROM documents),
k AS (SELECT doc_id, length(seq) AS n, [{', '.join(f"length(seq) - length(replace(seq, '{a}', ''))" for a in K.RESIDUE_ORDER)}] AS known FROM r)
SELECT doc_id, array_to_string(list_concat(known, [n - CAST(list_sum(known) AS BIGINT)]), ',') AS counts FROM k
""")
def tok_16(spark, sf_dir):
    """Summed 21-wide one-hot residue features (counts per residue type)."""
    r = _residues(spark, sf_dir)
    return r.select("doc_id", F.array_join(K.residue_counts("seq"), ",").alias("counts"))


# ---------------- UDF surface ----------------

def _py_overlap_string(s: pd.Series) -> pd.Series:
    def one(x):
        if x is None:
            return None
        return " ".join(x[i:i + 2] for i in range(0, len(x), 2))
    return s.map(one)


@query("udf_01", f"SELECT doc_id, md5({Q.overlap_string('text', 2, 0)}) AS text_md5 FROM documents")
def udf_01(spark, sf_dir):
    """A user function on a column through an Arrow-batched pandas UDF (the
    (2,0) word string); the native form is TOK-02."""
    f = F.pandas_udf(_py_overlap_string, "string")
    return _docs(spark, sf_dir).select("doc_id", F.md5(f("text")).alias("text_md5"))


def _add_counts(batches):
    for pdf in batches:
        yield pdf.assign(n_chars=pdf["text"].str.len().astype("int64"),
                         n_spaces=pdf["text"].str.count(" ").astype("int64")).drop(columns=["text"])


@query("udf_02", f"""
WITH {_PAIRS}, {_LAB}
SELECT row_id, label, CAST(length(text) AS BIGINT) AS n_chars,
       CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS n_spaces FROM lab
""")
def udf_02(spark, sf_dir):
    """Batched map that adds columns (mapInPandas over Arrow batches)."""
    lab = reshape.unpivot_pairs(pairs(spark, sf_dir), "surf_sequence", "deep_sequence")
    return lab.mapInPandas(_add_counts, "row_id long, label int, n_chars long, n_spaces long")


@query("udf_04", f"""
WITH {_PAIRS}, {_LAB}
SELECT word, count(*) AS n FROM (SELECT unnest({Q.overlap_words('text', 5, 2)}) AS word FROM lab) u GROUP BY word
""")
def udf_04(spark, sf_dir):
    """Row generator: one labelled row to its (5,2) words, counted."""
    lab = reshape.unpivot_pairs(pairs(spark, sf_dir), "surf_sequence", "deep_sequence")
    words = T.explode_items(lab, T.overlap_words("text", 5, 2), "word")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("udf_04_table", f"""
WITH {_PAIRS}, {_LAB}
SELECT row_id, word, count(*) AS n FROM (SELECT row_id, unnest({Q.overlap_words('text', 5, 2)}) AS word FROM lab) u GROUP BY row_id, word
""")
def udf_04_table(spark, sf_dir):
    """A user's row generator as a table function with a planned schema, over
    the labelled rows partitioned by pair."""
    lab = reshape.unpivot_pairs(pairs(spark, sf_dir), "surf_sequence", "deep_sequence")
    words = generate_rows(lab, _py_overlap_words, "word string", keep=["row_id"], partition_by=["row_id"])
    return words.groupBy("row_id", "word").agg(F.count(F.lit(1)).alias("n"))


def _py_overlap_words(row):
    """Words of 5 characters, each beginning 3 after the one before (TOK-01)."""
    text = row["text"] or ""
    for at in range(0, max(len(text) - 2, 0), 3):
        yield (text[at:at + 5],)


# ---------------- the same row operators on a stream ----------------

@query("tok_01_stream", f"""
SELECT doc_id, len(w) AS n_words, md5(array_to_string(w, '|')) AS words_md5
FROM (SELECT doc_id, {Q.overlap_words('text', 5, 2)} AS w FROM documents) t
""")
def tok_01_stream(spark, sf_dir):
    """TOK-01 over the documents file read as a stream (availableNow) into a
    parquet sink with a checkpoint: the row operators are stream-safe."""
    from helixframe.streaming import run_available, stream_parquet
    src = stream_parquet(spark, f"{sf_dir.rstrip('/')}/documents.parquet",
                         "doc_id long, text string, lang string, source string, n_chars long")

    def words(df):
        w = T.overlap_words("text", 5, 2)
        return df.select("doc_id", F.size(w).cast("long").alias("n_words"), _md5_join(w, "|").alias("words_md5"))
    return run_available(spark, src, words)


# residues are letters A-Z: the rows of the alphabet one after another
_ONE_HOT_SQL = "".join("".join(str(int(a == c)) for a in K.RESIDUE_ORDER) + str(int(c not in K.RESIDUE_ORDER))
                       for c in map(chr, range(ord("A"), ord("Z") + 1)))


@query("tok_16_rows", f"""
WITH r AS (SELECT doc_id, regexp_extract_all({Q.residue_seq('text')}, '.') AS cs FROM documents)
SELECT doc_id, CAST(len(cs) AS BIGINT) AS n_residues,
       md5(array_to_string(list_transform(cs, lambda c: substring('{_ONE_HOT_SQL}', (ascii(c) - 65) * 21 + 1, 21)), ' ')) AS rows_md5
FROM r
""")
def tok_16_rows(spark, sf_dir):
    """Per-residue one-hot rows, 21 wide, of whole sequences (as one digest a
    document)."""
    rows = K.one_hot("seq", digits=True)
    return _residues(spark, sf_dir).select(
        "doc_id", F.char_length("seq").cast("long").alias("n_residues"), F.md5(F.array_join(rows, " ")).alias("rows_md5"))
