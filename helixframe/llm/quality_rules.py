"""Operator 7, quality rules with adaptive thresholds.

One map measures each text.  Measures become integers, and each (language,
source, measure) gets a mergeable quantile sketch: counts over fixed buckets
(exact up to 16, then eight buckets an octave, so a quantile is read within
one eighth).  Sketches are rows of counts: they merge by adding, on the map
side, in the shuffle and again from sources to languages to all documents, so
a source with a third of all rows is no hot group.

The fence of a group is read from its sketch.  Most documents have no symbols,
duplicate lines or repeats, so the quartiles of these measures are 0 and say
nothing; ``tail_fences``, which op7 uses, takes the mean of a part of the
sketch (``PARTS``: the upper tail without its end, so the oddest documents do
not widen their own fence; for word lengths all but both ends) plus a number
of that part's standard deviations.  What is read from a group is shrunk
towards its language's, and that towards all documents', as if ``weight``
documents of the wider sketch were added.  No distance is a constant of the
measure: a group that does not vary has the spread of all documents, and no
fence stands closer than the sketch can tell (a quarter of the mean, an eighth
for word lengths).  ``fences`` is the plain quartile version with least
distances, in which a group of fewer than ``enough`` documents takes its
language's sketch whole.  Documents are joined with their group's fences (one
row for each language and source) and kept if no measure lies beyond its fence.

Defined cases: null and empty texts have no words and fail the base rules;
null languages and sources are groups like any other; repeated rows count and
are returned repeatedly; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import ASCII_SPACE, arrow_schema, by_rows, cut, docs_of, schema

SYMBOLS = "#*$%&|<>"
_EXACT = 16

#: measure -> (spread, least distance, whether small values are odd too)
MEASURES = {
    "symbol_permille": (6, 40, False),
    "dup_line_permille": (6, 600, False),
    "repeat_permille": (6, 300, False),
    "word_centichars": (6, 150, True),
}
#: measure -> (the part of its sketch that is read, from and to per cent, and
#: how many of that part's standard deviations the fence stands off its mean)
PARTS = {
    "symbol_permille": (75, 95, 1),
    "dup_line_permille": (75, 99, 6),
    "repeat_permille": (75, 99, 6),
    "word_centichars": (1, 99, 6),
}


#: measures of which only large values are odd
UPPER = [m for m, (_, _, both) in MEASURES.items() if not both]


def repeated_words(words: list[bytes], per: int = 3) -> int:
    """How many words lie in a window of ``per`` words that occurs twice or
    more."""
    import numpy as np
    n = len(words)
    if n <= per:
        return 0
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    window = ids[:n - per + 1]
    for k in range(1, per):             # number the windows, one word more each time
        _, window = np.unique(window * len(index) + ids[k:n - per + 1 + k], return_inverse=True)
    twice = np.bincount(window)[window] > 1
    inside = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + per, -1)
    return int((np.cumsum(inside[:n]) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines
    with a word)."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()       # bytes: ASCII white space only
    chars = len(text) - sum([text.count(c) for c in ASCII_SPACE])
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    return (len(words), chars, sum([text.count(c) for c in SYMBOLS]), len(lines) - len(set(lines)),
            repeated_words(words), len(lines))


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             source_col: str = "source") -> DataFrame:
    docs = docs_of(df, id_col, text_col, lang=lang_col, source=source_col)
    types = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "lang", "source")}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    out = schema(", ".join(f"{c} {t}" for c, t in types.items()) + "".join(f", {n} bigint" for n in names))

    def rows(ids, texts, langs, sources):
        got = [measure(t) for t in texts]
        return {"doc_id": ids, "lang": langs, "source": sources,
                **{n: [g[k] for g in got] for k, n in enumerate(names)}}

    return docs.mapInArrow(by_rows(rows, ["doc_id", "text", "lang", "source"], arrow_schema(out)), out)


def _per(a: str, factor: int, b: str) -> Column:
    return F.expr(f"{factor} * {a} div greatest({b}, 1)")


def bucket(v: Column) -> Column:
    """The bucket of a measure: itself up to 16, then eight an octave."""
    octave = F.length(F.bin(v)).cast("bigint") - 1
    return F.when(v < _EXACT, v).otherwise(octave * 8 + F.floor(v / F.pow(F.lit(2.0), octave - 3)).cast("bigint") - 24)


def bucket_value(b: Column) -> Column:
    """The smallest measure in a bucket."""
    high = F.floor((b - 16) / 8).cast("bigint")
    return F.when(b < _EXACT, b).otherwise(((b - 16) % 8 + 8) * F.pow(F.lit(2.0), high + 1).cast("bigint"))


def _quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """25 %, 50 % and 75 % points of merged sketches (rows of bucket counts),
    and the mean and standard deviation of their parts (``PARTS``; a bucket
    counts as its largest measure, for word lengths as its middle)."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "measure")
    upto = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    at = [F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bucket"))) for k in (1, 2, 3)]
    start, end = F.lit(0), F.lit(100)
    for m, (first, last, _) in PARTS.items():
        start = F.when(F.col("measure") == m, first).otherwise(start)
        end = F.when(F.col("measure") == m, last).otherwise(end)
    # hundredths of documents of a bucket that lie in the part
    inside = F.greatest(F.lit(0), F.least(100 * F.col("upto"), end * F.col("total"))
                        - F.greatest(100 * (F.col("upto") - F.col("n")), start * F.col("total")))
    top = bucket_value(F.col("bucket") + 1) - 1
    value = F.when(F.col("measure") == "word_centichars", (bucket_value(F.col("bucket")) + top) / 2).otherwise(top)
    held = F.max((end - start) * F.col("total"))
    tail, square = F.sum(inside * value) / held, F.sum(inside * value * value) / held
    return upto.groupBy(*by, "measure").agg(
        F.max("total").alias("total"), *[bucket_value(q).alias(f"q{k}") for k, q in zip((1, 2, 3), at, strict=True)],
        tail.alias("tail"), F.sqrt(F.greatest(F.lit(0.0), square - tail * tail)).alias("sd"))


def _levels(docs: DataFrame) -> DataFrame:
    """What the sketches over ``docs`` (columns lang, source and the measures)
    say for each group and measure: ``o_`` of the group, ``l_`` of its
    language, ``e_`` of every document."""
    long = docs.select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES])).alias("x"))
    sketch = cut(long.groupBy("lang", "source", F.col("x.measure").alias("measure"), F.col("x.bucket").alias("bucket"))
                 .agg(F.count(F.lit(1)).alias("n")), "quality-sketch")
    own, lang, every = _quantiles(sketch, "lang", "source"), _quantiles(sketch, "lang"), _quantiles(sketch)
    own, lang, every = [d.select(*[F.col(c).alias(f"{p}_{c}") for c in d.columns])
                        for p, d in (("o", own), ("l", lang), ("e", every))]
    return (own.join(lang, F.col("o_lang").eqNullSafe(F.col("l_lang")) & (F.col("o_measure") == F.col("l_measure")))
            .join(every, F.col("o_measure") == F.col("e_measure")))


def _by_group(level: DataFrame, bounds: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``lang, source`` and the low and high fence of each measure."""
    cols = []
    for m, (low, high) in bounds.items():
        here = F.col("measure") == m
        cols += [F.max(F.when(here, high)).alias(f"high_{m}"), F.max(F.when(here, low)).alias(f"low_{m}")]
    return level.groupBy("lang", "source").agg(*cols)


def _quartile_bounds(m: str) -> tuple[Column, Column]:
    spread, least, both = MEASURES[m]
    high = F.col("q3") + F.greatest(F.lit(least), spread * (F.col("q3") - F.col("q2")))
    return F.col("q1") - F.greatest(F.lit(least), spread * (F.col("q2") - F.col("q1"))) if both else F.lit(-1), high


def fences(docs: DataFrame, enough: int = 200) -> DataFrame:
    """``lang, source`` and for each measure ``low_<measure>, high_<measure>``
    from sketches over ``docs`` (columns lang, source and the measures)."""
    def q(k: int) -> Column:
        return (F.when(F.col("o_total") >= enough, F.col(f"o_q{k}"))
                .when(F.col("l_total") >= enough, F.col(f"l_q{k}")).otherwise(F.col(f"e_q{k}")))

    level = _levels(docs).select(F.col("o_lang").alias("lang"), F.col("o_source").alias("source"),
                                 F.col("o_measure").alias("measure"), *[q(k).alias(f"q{k}") for k in (1, 2, 3)])
    return _by_group(level, {m: _quartile_bounds(m) for m in MEASURES})


def tail_fences(docs: DataFrame, weight: int = 20) -> DataFrame:
    """The same columns, from the sketches' upper tails."""
    def shrunk(c: str) -> Column:
        wide = (F.col("l_total") * F.col(f"l_{c}") + weight * F.col(f"e_{c}")) / (F.col("l_total") + weight)
        return (F.col("o_total") * F.col(f"o_{c}") + weight * wide) / (F.col("o_total") + weight)

    level = _levels(docs).select(F.col("o_lang").alias("lang"), F.col("o_source").alias("source"), F.col("o_measure").alias("measure"),
                                 shrunk("tail").alias("tail"), shrunk("sd").alias("sd"), "e_sd")
    bounds = {}
    for m, (_, _, spread) in PARTS.items():
        # a group that does not vary has all documents' spread, and no fence is finer than the sketch
        off = F.greatest(F.col("tail") / 4 if m in UPPER else F.col("tail") / 8, spread * F.col("sd"), F.col("e_sd"))
        bounds[m] = (F.lit(-1.0) if m in UPPER else F.col("tail") - off, F.col("tail") + off)
    return _by_group(level, bounds)


def quality(df: DataFrame, enough: int = 200, id_col: str = "doc_id", text_col: str = "text",
            lang_col: str = "lang", source_col: str = "source", tails: bool = False) -> DataFrame:
    """One row per row of ``df``: the counts, ``base_failed``, the measures,
    and ``kept``, by ``tail_fences`` where ``tails`` is set."""
    docs = cut(measured(df, id_col, text_col, lang_col, source_col).withColumns({
        "base_failed": F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"),
        "symbol_permille": _per("n_symbols", 1000, "word_chars"),
        "dup_line_permille": _per("n_dup_lines", 1000, "n_lines"),
        "repeat_permille": _per("n_repeat_words", 1000, "n_words"),
        "word_centichars": _per("word_chars", 100, "n_words")}), "quality-measures")
    # the fences come from documents that pass the base rules
    passed = docs.filter("NOT base_failed")
    group = (tail_fences(passed) if tails else fences(passed, enough)).select(
        F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "*").drop("lang", "source")
    joined = docs.join(group, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")),
                       "left").drop("g_lang", "g_source")
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(F.col(m).between(F.col(f"low_{m}"), F.col(f"high_{m}")), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside)
