"""Operator 13, ranked lexical search with hashed max-sketches.

A term's impact in a document does not depend on the query, so a document's
impacts fold into a vector of ``width`` coordinates: a coordinate holds the
largest impact of the terms that hash to it.  The sketches of a batch of
documents form a matrix; looking up the coordinates of all items' terms and
weighing them is one product of two matrices and gives, for every item and
document, a bound that no score exceeds.  For each item the batch's documents
are then taken by falling bound and scored exactly, until the bound falls
below the k-th best score so far.

Scores: m = 100 - b + (b*n*N) div L with b in hundredths, impact
(10^9 tf) div (1000 tf + 8 m), weight floor(1000 ln((2N+2)/(2df+1))); a score is the
sum of weight times impact over the item's terms, repeats included.  All but
the logarithm is in whole numbers; bounds are doubles, raised by a relative 1e-9 for
their rounding.

Shape: the items are a stated query set, taken in blocks of at most
``block_terms`` terms that are sent to all tasks; a block is two scans of the
texts (counts of its terms, N and L, added up in the tasks first; then the
search) and no shuffle of documents: a task returns at most ``k`` rows an
item, and the best of these are kept by a window with a group limit.

Defined cases: null and empty texts have no terms and are never found; a null
id comes last among equal scores; repeated rows are found as rows of their
own; repeated items are items of their own and an item without terms finds
nothing; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import arrow_schema, bounded_batches, schema

WIDTH = 1 << 14
LENGTH_SHARE = 75
BLOCK_TERMS = 200_000
_BATCH_DOCS = 256
#: letters, digits and bytes of characters beyond ASCII make terms, A-Z in lower case
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def impact(tf: int, m: int) -> int:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def statistics(docs: DataFrame, wanted: list[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """N, L and the document counts of the ``wanted`` terms."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches) -> Iterator:
        import pyarrow as pa
        look, n, length, df = frozenset(shared.value), 0, 0, Counter()
        for batch in batches:
            for k in range(batch.num_rows):
                got = terms(batch.column(0)[k].as_py())
                n += bool(got)
                length += len(got)
                df.update(look.intersection(got))
        yield pa.RecordBatch.from_pydict({"term": [None, *df], "df": [n, *df.values()], "length": [length] + [0] * len(df)},
                                         schema=pa.schema([("term", pa.binary()), ("df", "int64"), ("length", "int64")]))

    made = docs.select("text").mapInArrow(run, "term binary, df bigint, length bigint")
    got = {r["term"] and bytes(r["term"]): (r["df"], r["length"])
           for r in made.groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")).collect()}
    n, length = got.pop(None, (0, 0))
    return n, length, {t: df for t, (df, _) in got.items()}


class Best:
    """The ``k`` best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.rows, self.floor = k, [], 0

    def offer(self, score: int, doc) -> None:
        row = (-score, doc is None, 0 if doc is None else doc)
        if score > 0 and (len(self.rows) < self.k or row < self.rows[-1]):
            insort(self.rows, row)
            del self.rows[self.k:]
            if len(self.rows) == self.k:
                self.floor = -self.rows[-1][0]


class Searcher:
    """A block of items over a stream of document batches."""

    def __init__(self, items: list[tuple], n: int, length: int, df: dict[bytes, int], k: int, width: int, share: int):
        import numpy as np
        from zlib import crc32
        self.n, self.length, self.width, self.share = n, length, width, share
        weight = {t: math.floor(1000.0 * math.log((2.0 * n + 2.0) / (2.0 * c + 1.0))) for t, c in df.items()}
        # a term that no document holds adds nothing to any score, so nothing to a bound
        self.items = [(i, {t: c * weight[t] for t, c in Counter(ts).items() if t in weight}) for i, ts in items]
        self.best = [Best(k) for _ in items]
        used = sorted({crc32(t) % width for _, q in self.items for t in q})
        at = {c: j for j, c in enumerate(used)}
        self.used = np.array(used, "i8")
        self.lookup = np.zeros((len(self.items), len(used)))
        for row, (_, q) in enumerate(self.items):
            for t, w in q.items():
                self.lookup[row, at[crc32(t) % width]] += w
        self.lookup *= 1 + 1e-9

    def sketches(self, held: list[tuple[Counter, int]]):
        """The batch's max-sketches: ``width`` coordinates x documents."""
        from zlib import crc32

        import numpy as np
        made = np.zeros(self.width * len(held))
        for d, (tf, m) in enumerate(held):
            n = np.fromiter(tf.values(), "i8", len(tf))
            at = np.fromiter(map(crc32, tf), "i8", len(tf)) % self.width
            np.maximum.at(made, at * len(held) + d, 1_000_000_000 * n // (1000 * n + 8 * m))
        return made.reshape(self.width, len(held))

    def batch(self, docs: list[tuple]) -> None:
        """Documents as (id, text)."""
        import numpy as np
        held, ids = [], []
        for doc, text in docs:
            if got := terms(text):
                held.append((Counter(got), 100 - self.share + self.share * len(got) * self.n // self.length))
                ids.append(doc)
        if not held or not len(self.used):
            return
        bounds = self.lookup @ self.sketches(held)[self.used]
        for (_, q), best, bound in zip(self.items, self.best, bounds, strict=True):
            near = np.flatnonzero((bound > 0) & (bound >= best.floor))
            for d in near[np.argsort(-bound[near], kind="stable")].tolist():
                if bound[d] < best.floor:
                    break
                tf, m = held[d]
                best.offer(sum([w * impact(tf[t], m) for t, w in q.items() if t in tf]), ids[d])

    def found(self) -> Iterator[tuple]:
        """(number of the item, item, document, score)."""
        for row, ((item, _), best) in enumerate(zip(self.items, self.best, strict=True)):
            for score, none, doc in best.rows:
                yield row, item, None if none else doc, -score


def blocks(items: DataFrame, item_col: str, text_col: str, block_terms: int) -> Iterator[list[tuple]]:
    """The items and their terms in runs of at most ``block_terms`` terms (an
    item above that is a run of its own); they stream by on the driver."""
    held, n = [], 0
    for item, text in items.select(item_col, F.col(text_col).cast("binary")).toLocalIterator():
        got = terms(text and bytes(text))
        if held and n + len(got) > block_terms:
            yield held
            held, n = [], 0
        held.append((item, got))
        n += len(got)
    if held:
        yield held


def search(df: DataFrame, items: DataFrame, k: int = 10, width: int = WIDTH, length_share: int = LENGTH_SHARE,
           block_terms: int = BLOCK_TERMS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's ``k`` best rows."""
    spark = df.sparkSession
    bounded_batches(df)
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = schema(f"item_id {items.schema[item_col].dataType.simpleString()}, "
                 f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint, __row bigint")
    found = spark.createDataFrame([], out)
    for number, block in enumerate(blocks(items, item_col, item_text_col, block_terms)):
        n, length, counts = statistics(docs, sorted({t for _, ts in block for t in ts}))
        shared = spark.sparkContext.broadcast((block, n, length, counts))

        def run(batches, shared=shared, number=number) -> Iterator:
            import pyarrow as pa
            block, n, length, counts = shared.value
            here = Searcher(block, n, length, counts, k, width, length_share)
            for batch in batches:
                for at in range(0, batch.num_rows, _BATCH_DOCS):
                    part = batch.slice(at, _BATCH_DOCS)
                    here.batch(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)))
            if rows := [(i, d, s, number << 40 | row) for row, i, d, s in here.found()]:
                form = arrow_schema(out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), form, strict=True)], schema=form)

        found = found.unionByName(docs.mapInArrow(run, out))
    # ``__row`` is the item's place in the query set: repeated item ids stay items of their own
    order = Window.partitionBy("__row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score")

