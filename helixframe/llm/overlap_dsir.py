"""Operator 12, importance resampling towards a target by hashed n-grams that
an overlapped regex scan finds.

A text's separators are collapsed to single spaces; ``regex.finditer`` with
``overlapped=True`` then walks over it once for each n.  The pattern is n
words with a look-around at both ends, so a match starts at every word and
only there, and its span is the n-gram itself: its CRC-32 modulo ``buckets``
is counted without joining words again.

The buckets' counts over all documents and over the target give each bucket
a gain (its log ratio, in thousandths); a document's weight is the mean gain of its
features.  Gumbel noise from a hash of the id is added, and of the documents
with ``min_words`` words the best ``percent`` per cent are drawn: sampling
without replacement in proportion to the weights.

Shape: one scan of the texts writes each document's buckets (two bytes a
feature); counting and weighing read those.  Counts are added up in each task
first, so ``buckets`` rows a task are shuffled; the driver holds ``buckets``
gains (at most ``MAX_BUCKETS``).  Scores are whole numbers whose range does
not depend on the input, so a table of counts by score tells where the draw
ends; only rows from there on are shuffled to be numbered, rows that are
equal in all that is returned as one row and a count for each task.

Defined cases: a null text has no words, weight 0, no rank; a null id draws
its noise from the seed and an empty id, and comes last among ties; repeated
rows are documents of their own and take ranks of their own; an empty table
gives no rows, an empty target gives every bucket the same T and t of 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import arrow_schema, bounded_batches, cut, schema, worker_state

BUCKETS = 10_000
MAX_BUCKETS = 1 << 20
_SLICE = 256
#: other bytes than lower-case letters, digits and those of characters beyond ASCII separate words
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def collapsed(text: bytes) -> bytes:
    """Lower-case A-Z, words with single spaces between them."""
    return b" ".join(text.translate(_FOLD).split())


def scanners(orders: int) -> list:
    """For n = 1 .. ``orders`` a function from a collapsed text to an iterator
    over the matches, one at each word that has n - 1 words behind it."""
    import regex
    found = []
    for n in range(1, orders + 1):
        form = regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))
        found.append(lambda s, scan=form.finditer: scan(s, overlapped=True))
    return found


def bucketed(text: bytes | None, scans: list, buckets: int) -> list:
    """The buckets of a text's n-grams, an array for each n."""
    from operator import itemgetter
    from zlib import crc32

    import numpy as np
    s = collapsed(text or b"")
    return [np.fromiter(map(crc32, map(itemgetter(0), scan(s))), "u4") % np.uint32(buckets) for scan in scans]


def _unit(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def features(df: DataFrame, id_col: str | None, text_col: str = "text", orders: int = 2,
             buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, buckets`` (little-endian, two bytes each
    up to 65,536 buckets, else four) of each row; ``id_col`` None leaves the
    id null."""
    if not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"{buckets} buckets; 1 to {MAX_BUCKETS} are supported")
    bounded_batches(df)
    doc = F.lit(None).cast("long") if id_col is None else F.col(id_col)
    docs = df.select(doc.alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = schema(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_features bigint, buckets binary")

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        scans, form = worker_state(f"scanners_{orders}", lambda: scanners(orders)), arrow_schema(out)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                got = [bucketed(t, scans, buckets) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(g[0]) for g in got], "i8"), pa.array([sum(map(len, g)) for g in got], "i8"),
                     pa.array([np.concatenate(g).astype(_unit(buckets)).tobytes() for g in got], pa.binary())], schema=form)

    return docs.mapInArrow(run, out)


def totals(found: DataFrame, buckets: int = BUCKETS):
    """How many features fall in each bucket, as an array of ``buckets``
    numbers."""
    import numpy as np

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        held = np.zeros(buckets, "i8")
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held += np.bincount(np.frombuffer(raw, _unit(buckets)), minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": held[at]}, schema=pa.schema([("bucket", "int64"), ("n", "int64")]))

    made = found.select("buckets").mapInArrow(run, "bucket bigint, n bigint")
    got = np.zeros(buckets, "i8")
    for r in made.groupBy("bucket").agg(F.sum("n").alias("n")).collect():      # at most ``buckets`` rows
        got[r["bucket"]] = r["n"]
    return got


def gains(of_docs, of_target) -> list[int]:
    """A bucket's gain: floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))), in doubles."""
    b = len(of_docs)
    big, small = float(of_docs.sum()) + b, float(of_target.sum()) + b
    return [math.floor(1000.0 * math.log((float(t) + 1.0) * big / ((float(s) + 1.0) * small)))
            for s, t in zip(of_docs, of_target, strict=True)]


def weights(found: DataFrame, gain: list[int]) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean of the gains."""
    out = schema(f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint")
    shared = found.sparkSession.sparkContext.broadcast(gain)

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        of, form = np.array(shared.value, "i8"), arrow_schema(out)
        for batch in batches:
            each = [np.frombuffer(raw, _unit(len(of))) for raw in batch.column(3).to_pylist()]
            mean = [int(of[b].sum()) // len(b) if len(b) else 0 for b in each]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array(mean, "i8")], schema=form)

    return found.mapInArrow(run, out)


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from a hash of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... by falling score, then rising id,
    for the ``percent`` per cent of the rows with ``min_words`` words."""
    spark = scored.sparkSession
    able = F.col("n_words") >= min_words
    # whole scores: the logarithms of counts and of a 32-bit hash span some 10^5 values, whatever the input
    by_score = sorted(((r["score"], r["count"]) for r in scored.filter(able).groupBy("score").count().collect()), reverse=True)
    k, before, starts = percent * sum(n for _, n in by_score) // 100, 0, []
    for score, n in by_score:
        if before >= k:
            break
        starts.append((score, before))
        before += n
    ends = F.lit(starts[-1][0] if starts else None).cast("long")
    top = able & F.coalesce(F.col("score") >= ends, F.lit(False))
    starts = spark.createDataFrame(starts, "__score long, __before long")
    alike = [c for c in scored.columns if c != "__task"]
    groups = scored.filter(top).groupBy(*alike, "__task").agg(F.count(F.lit(1)).alias("__n"))
    order = [F.col("doc_id").asc_nulls_last(), *[F.col(c) for c in alike if c not in ("doc_id", "score")], F.col("__task")]
    sooner = Window.partitionBy("score").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (groups.withColumn("__sooner", F.coalesce(F.sum("__n").over(sooner), F.lit(0)))
              .join(F.broadcast(starts), F.col("score") == F.col("__score"))
              .withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
              .withColumn("rank", F.col("__before") + F.col("__sooner") + F.col("__k"))
              .withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))))
    rest = scored.filter(~top).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*alike, "rank").unionByName(rest.select(*alike, "rank"))


def resample(df: DataFrame, target: DataFrame, orders: int = 2, buckets: int = BUCKETS, percent: int = 25,
             min_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` (null where not
    drawn) of every row of ``df``."""
    found = cut(features(df, id_col, text_col, orders, buckets), "features")
    of_target = totals(features(target, None, target_text_col, orders, buckets), buckets)
    weighed = weights(found, gains(totals(found, buckets), of_target))
    scored = cut(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
                 .withColumn("__task", F.spark_partition_id()), "scores")
    return drawn(scored, percent, min_words)
