"""Column expressions over strings and token arrays.

Everything here returns a ``Column`` built from Spark built-ins (higher-order
array functions included), so it runs inside the JVM, on batch and streaming
DataFrames alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's Unicode ``\W`` (PRJ-03).  Java's ``\W`` is ASCII-only and would
# strip accented letters; this class keeps them, and RE2 (DuckDB) reads it too.
NON_WORD = r"[^\p{L}\p{N}_]+"

# BERT punctuation: ASCII 33-47, 58-64, 91-96, 123-126 and Unicode class P.
BERT_PUNCT = r"[\p{P}!-/:-@\[-`{-~]"
BERT_TOKEN = BERT_PUNCT + r"|[^ \p{P}!-/:-@\[-`{-~]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_non_word(s) -> Column:
    """Remove every run of non-word characters (PRJ-03)."""
    return F.regexp_replace(_c(s), NON_WORD, "")


def overlap_words(s, word_length: int, overlap: int) -> Column:
    """Overlapping words (TOK-01): starts 0, step ``w-o``, while
    ``start < len - o``; the last word may be short; ``o >= w`` or
    ``len <= o`` gives an empty array.

    One linear regex scan: each match consumes ``w-o`` characters and a
    look-ahead captures the ``w`` characters from its start.  (A
    ``substring`` per start would rescan the UTF-8 string from its first
    byte every time: quadratic on a long document.)  Matches starting at or
    after ``len - o`` lie inside the previous word and are cut off.
    """
    if word_length <= 0 or overlap < 0:
        raise ValueError("word_length must be > 0 and overlap >= 0")
    s = _c(s)
    empty = F.array().cast("array<string>")
    if overlap >= word_length:
        return F.when(s.isNull(), F.lit(None)).otherwise(empty)
    step = word_length - overlap
    if overlap == 0:
        return F.regexp_extract_all(s, F.lit(f"(?s).{{1,{word_length}}}"), 0)
    words = F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{1,{word_length}}})).{{1,{step}}}"), 1)
    n = F.char_length(s)
    count = F.floor((n - overlap - 1) / step).cast("int") + 1
    return F.when(n <= overlap, empty).otherwise(F.slice(words, 1, count))


def overlap_string(s, word_length: int, overlap: int) -> Column:
    """The overlapping words joined by single spaces (TOK-02)."""
    return F.array_join(overlap_words(s, word_length, overlap), " ")


def chars(s) -> Column:
    """Characters of a string as an array; the empty string gives ``[]``."""
    s = _c(s)
    return F.filter(F.split(s, ""), lambda c: c != "")


def explode_items(df, arr, alias: str, keep=(), with_pos: str | None = None):
    """Rows of ``df`` exploded to one row per item of ``arr``, empty and null
    arrays giving no row.

    Written as ``explode_outer`` plus a null filter on purpose: a plain
    ``explode`` makes Catalyst infer ``size(arr) > 0`` and push that
    predicate towards the scan, past a repartition, so an expensive array
    expression runs twice, and before the rows are spread.
    """
    keep = list(keep)
    if with_pos:
        out = df.select(*keep, F.posexplode_outer(arr).alias(with_pos, alias))
        return out.where(F.col(with_pos).isNotNull())
    out = df.select(*keep, F.explode_outer(arr).alias(alias))
    return out.where(F.col(alias).isNotNull())


def pad_truncate(a, length: int, padding: str = "pre", truncating: str = "pre",
                 value: int = 0) -> Column:
    """Cut or pad an array to ``length`` (TOK-05).  ``truncating='pre'``
    keeps the last ``length`` items, ``'post'`` the first; ``padding`` puts
    ``value`` before (``'pre'``) or after (``'post'``) the items.  The sides
    are independent, as in Keras ``pad_sequences``."""
    if padding not in ("pre", "post") or truncating not in ("pre", "post"):
        raise ValueError("padding and truncating must be 'pre' or 'post'")
    a = _c(a)
    n = F.size(a)
    if truncating == "post":
        cut = F.slice(a, 1, length)
    else:
        cut = F.when(n > length, F.slice(a, n - length + 1, length)).otherwise(a)
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(cut), F.lit(0)))
    return F.concat(fill, cut) if padding == "pre" else F.concat(cut, fill)


def add_m_suffix(name) -> Column:
    """Model size alias: append ``m`` when missing (PRJ-08)."""
    name = _c(name)
    return F.when(name.endswith("m"), name).otherwise(F.concat(name, F.lit("m")))
