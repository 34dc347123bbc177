"""Operator 9, language ID by Bayesian evidence fusion.

log P(language | row) is, up to a constant, the sum of

* the text's likelihood: hashed three-byte grams of its letters under each
  language's gram counts, tempered (grams overlap, so they are worth less than
  as many independent draws).  ``und`` stands beside the languages with
  uniform grams, so text of none of them is not forced into one;
* the language that the markup declares, through P(declared | language),
  which is counted against what the text alone says;
* the address suffix (a country code top level), in the same way, where the
  host has one that hints at a language;
* the host's prior: shares of languages among the host's rows, smoothed
  towards the parent domain's, which are smoothed towards all rows'.

Gram counts, agreement counts and host counts are grouped aggregates over all
rows with partial sums, so a host with a third of all rows is no hot group.
A language has a gram model if the rows that declare it hold ``MIN_GRAMS``
grams, however many rows there are beside them.  Rows that declare a rarer one
have one more candidate, their own declared language: its text is worth what
``und``'s is, so declared and host evidence decide, and where it wins it is the
row's language.  Gram counts are written; what comes to the driver and goes to
the tasks is the model, 128 KB a language with one (and as a table of languages
x languages the agreement), whatever the number of rows.

A row is rejected (``kept`` is false) if its text has no letters, ``und`` wins
or the best language stays below ``least``, or the best is not in ``accept``
where that is given.

Defined cases: null and empty texts have no letters and are rejected; a null
declared language, one outside ``languages`` where that is given, ``und``, a
null host and a suffix without a hint are no evidence; rows with a null host share the prior of all rows; repeated rows
count and are returned repeatedly; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import arrow_schema, by_rows, cut, schema

GRAMS = 1 << 15
#: grams from which a declared language has a model of its own
MIN_GRAMS = 4096
TEMPER = 0.1
#: top levels that hint at a language (fixed values)
SUFFIX_HINTS = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en",
                "au": "en", "ie": "en"}
UND = "und"
#: stands for the row's own declared language where that has no gram model
RARE = "*"
_HELD = 64
_MIX = 2654435761


def grams(text: str | None):
    """Numbers of the three-byte grams of a text's letters (lower case, with
    other ASCII characters as spaces), and the number of letter bytes."""
    import numpy as np
    table = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
    raw = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-8", "surrogatepass").translate(table), "u1")
    space = raw == 32
    letters = len(raw) - int(space.sum())
    wide = raw.astype("u4")
    h = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(_MIX) >> np.uint32(17)
    return h[~(space[:-2] & space[1:-1])], letters              # without runs of spaces


def gram_counts(docs: DataFrame) -> DataFrame:
    """``declared, gram, n`` over all rows (columns text, declared)."""
    out = schema("declared string, gram int, n bigint")

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        held: dict[str, np.ndarray] = {}

        def partial() -> Iterator:
            for lang, counts in held.items():
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_pydict({"declared": [lang] * len(some), "gram": some, "n": counts[some]},
                                                 schema=arrow_schema(out))
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for text, lang in zip(*[part.column(k).to_pylist() for k in (0, 1)], strict=True):
                    if lang not in held:
                        if len(held) == _HELD:
                            yield from partial()
                        held[lang] = np.zeros(GRAMS, "i8")
                    held[lang] += np.bincount(grams(text)[0], minlength=GRAMS)
        yield from partial()

    return docs.select("text", "declared").mapInArrow(run, out).groupBy("declared", "gram").agg(F.sum("n").alias("n"))


def languages_of(counts: DataFrame) -> list[str]:
    """The declared languages with at least ``MIN_GRAMS`` grams."""
    return sorted(r[0] for r in counts.groupBy("declared").agg(F.sum("n").alias("n"))
                  .filter(F.col("n") >= MIN_GRAMS).select("declared").collect())


def fit_text(gram_table: DataFrame, languages: Sequence[str], rare: bool = False):
    """Log likelihood of each gram (rows) in each language, ``und`` and, with
    ``rare``, a language without a model."""
    import numpy as np
    counts = np.full((GRAMS, len(languages)), 0.5, "f4")
    number = {lang: k for k, lang in enumerate(languages)}
    got = gram_table.filter(F.col("declared").isin(list(languages))).toArrow()
    for batch in got.to_batches():
        at = np.array([number[x] for x in batch.column("declared").to_pylist()], "i8")
        counts[batch.column("gram").to_numpy(), at] += batch.column("n").to_numpy()
    loglik = np.log(counts / counts.sum(axis=0, dtype="f8"))
    return np.hstack([loglik, np.full((GRAMS, 1 + rare), -math.log(GRAMS))]).astype("f4")


def text_evidence(docs: DataFrame, model, keep: Sequence[str], temper: float = TEMPER) -> DataFrame:
    """``keep``, ``letters`` and ``ll``, the tempered log likelihoods."""
    out = schema("".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
                 + "letters bigint, ll array<double>")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(texts, *others):
        table = shared.value
        lls, letters = [], []
        for t in texts:
            g, n = grams(t)
            total = sum((table.take(g[at:at + 65536], axis=0).sum(axis=0, dtype="f8") for at in range(0, len(g), 65536)),
                        start=0.0 * table[0].astype("f8"))
            lls.append((temper * (total - total.max())).tolist())
            letters.append(n)
        return {**dict(zip(keep, others, strict=True)), "letters": letters, "ll": lls}

    return docs.select("text", *keep).mapInArrow(by_rows(rows, ["text", *keep], arrow_schema(out)), out)


def _argmax(a: Column, names: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position(a, F.array_max(a)).cast("int"))


def agreement(rows: DataFrame, said: str, names: Sequence[str]) -> DataFrame:
    """``<said>_is, <said>_p``: log P(said | language) for each language as an
    array, from counts of what is said against what the text says."""
    known = [x for x in names if x != UND]
    n = [F.sum(F.when(F.col("heard") == x, 1.0).otherwise(0.0)).alias(f"n{k}") for k, x in enumerate(names)]
    spoken = rows.filter(F.col(said).isin(known)).groupBy(F.col(said).alias("is")).agg(*n)
    spoken = cut(spoken, f"lang-{said}")
    per = [float(v or 0) for v in spoken.agg(*[F.sum(f"n{k}") for k in range(len(names))]).first()]
    p = [F.log((F.col(f"n{k}") + F.when(F.col("is") == x, 2.0).otherwise(0.5)) / (per[k] + 1.5 + 0.5 * len(known)))
         for k, x in enumerate(names)]
    return spoken.select(F.col("is").alias(f"{said}_is"), F.array(*p).alias(f"{said}_p"))


def _log_shares(counts: Column, towards: Column, weight: float) -> Column:
    """Smoothed shares of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, towards, lambda n, p: (n + weight * p) / (total + weight))


def host_priors(rows: DataFrame, names: Sequence[str], weight: float) -> tuple[DataFrame, list[float]]:
    """``host, prior`` (shares by language), and the shares of all rows."""
    n = [F.sum(F.when(F.col("heard") == x, 1.0).otherwise(0.0)).alias(f"n{k}") for k, x in enumerate(names)]
    host = cut(rows.groupBy("host").agg(*n), "lang-hosts")
    sums = [F.sum(f"n{k}").alias(f"n{k}") for k in range(len(names))]
    every = [float(v or 0) for v in host.agg(*sums).first()]
    shares = [(v + 1.0) / (sum(every) + len(names)) for v in every]
    array = F.array(*[f"n{k}" for k in range(len(names))])
    parent = F.when(F.instr("host", ".") > 0, F.substring_index("host", ".", -2)).otherwise("")
    host = host.filter("host IS NOT NULL").withColumn("parent", parent)
    above = host.groupBy("parent").agg(*sums).select(
        "parent", _log_shares(array, F.array(*[F.lit(s) for s in shares]), weight).alias("up"))
    return host.join(above, "parent").select("host", _log_shares(array, F.col("up"), weight).alias("prior")), shares


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang",
             host_col: str | None = "source", languages: Sequence[str] | None = None, accept: Sequence[str] | None = None,
             least: float = 0.5, host_weight: float = 20.0) -> DataFrame:
    """``id, language, posterior, kept`` for every row of ``df``.  Without
    ``declared_col`` there is nothing to learn the grams from, so it must hold
    the declared language of some rows."""
    text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                     F.lower(text(declared_col)).alias("declared"), F.lower(text(host_col)).alias("host"))
    hints = F.create_map(*[F.lit(x) for kv in SUFFIX_HINTS.items() for x in kv])
    docs = docs.withColumn("hint", F.when(F.instr("host", ".") > 0, hints[F.substring_index("host", ".", -1)]))
    rare = not languages
    counts = cut(gram_counts(docs.filter(F.col("declared").isNotNull() & (F.col("declared") != UND))), "lang-grams")
    languages = list(languages or languages_of(counts))
    names = [*languages, UND, *[RARE] * rare]
    rows = text_evidence(docs, fit_text(counts, languages, rare), ["id", "declared", "host", "hint"])
    modelled = F.col("declared").isin(languages)
    rows = rows.withColumn("said", F.when(modelled, F.col("declared")).when(
        F.lit(rare) & F.col("declared").isNotNull() & (F.col("declared") != UND), RARE))
    heard = _argmax(F.col("ll"), names)                         # ``und`` stands before RARE, which has the same likelihood
    heard = F.when((heard == UND) & (F.col("said") == RARE), RARE).otherwise(heard)
    rows = cut(rows.withColumn("heard", F.when(F.col("letters") > 0, heard).otherwise(UND)), "lang-text")
    priors, shares = host_priors(rows, names, host_weight)
    priors = cut(priors.select(F.col("host").alias("p_host"), "prior"), "lang-priors")
    joined = rows.join(priors, rows["host"] == priors["p_host"], "left")
    total = F.zip_with(F.col("ll"), F.coalesce("prior", F.array(*[F.lit(s) for s in shares])), lambda a, p: a + F.log(p))
    for said in ("said", "hint"):
        # one row for each language, so sent to all tasks
        joined = joined.join(F.broadcast(agreement(rows, said, names)), F.col(said) == F.col(f"{said}_is"), "left")
        total = F.zip_with(total, F.coalesce(f"{said}_p", F.array(*[F.lit(0.0)] * len(names))), lambda a, b: a + b)
    if rare:                            # RARE is no candidate for rows that do not declare such a language
        others = F.concat(F.slice(total, 1, len(names) - 1), F.array(F.lit(float("-inf"))))
        total = F.when(F.col("said").eqNullSafe(F.lit(RARE)), total).otherwise(others)
    fused = joined.withColumn("total", total).withColumn("top", F.array_max("total"))
    fused = fused.withColumn("posterior", 1 / F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    best = _argmax(F.col("total"), names)
    best = F.when(best == RARE, F.col("declared")).otherwise(best)
    language = F.when(F.col("letters") > 0, best).otherwise(UND)
    fused = fused.withColumn("language", language)
    kept = (F.col("language") != UND) & (F.col("posterior") >= least)
    if accept is not None:
        kept = kept & F.col("language").isin(list(accept))
    return fused.select(F.col("id").alias(id_col), "language",
                        F.when(F.col("letters") > 0, F.col("posterior")).otherwise(0.0).alias("posterior"), kept.alias("kept"))
