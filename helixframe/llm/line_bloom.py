"""Operator 10, line dedup with two Bloom filters.

Pass 1 hashes each document's distinct line keys and emits, per task and
filter segment, the bits of hashes seen once and of hashes seen in two
documents.  Segments are merged as they stream by: a bit is in the second
filter if either side has it there or both have it in the first.  A key of two
documents is therefore always in the second filter; others rarely are.  The
merged second filter has a fixed number of bits (``filter_bits``, 16 MiB to
128 MiB as it is sized here), which bounds what is sent to the driver and
broadcast; with more lines than it is meant for it only lets more suspects by.

Pass 2 shuffles only suspected lines: a grouped minimum and maximum of the
document id confirms exactly which keys occur in two documents and which
document is first.  Documents without a suspect never leave their task;
the others meet the list of keys that they lose.

Defined cases: a null or empty text is one empty line; a null text stays null
in the output; rows with a null id neither count nor lose lines; rows with
equal ids are one document; a text that loses all its lines becomes empty; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helixframe.llm.common import ASCII_SPACE, arrow_schema, bounded_batches, cut, fresh, schema

#: bits of one segment, bits set for each key, and the sizes of a filter
SEGMENT = 1 << 16
HASHES = 4
MIN_BITS, MAX_BITS = 1 << 22, 1 << 30
#: filter bits for each document: ten lines or so with four bits each, a
#: sixth of the bits set
BITS_PER_DOC = 256
_FLUSH = 1 << 20
_SLICE = 512


def filter_bits(n_docs: int) -> int:
    """The power of two for ``n_docs`` documents within the bounds."""
    return min(MAX_BITS, max(MIN_BITS, 1 << (n_docs * BITS_PER_DOC).bit_length()))


def line_key(line: str) -> str:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip(ASCII_SPACE).encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def keys_of(text: str | None, shortest: int) -> list[str]:
    """The distinct keys of at least ``shortest`` code points of a text."""
    return list(dict.fromkeys([k for line in (text or "").split("\n") if len(k := line_key(line)) >= shortest]))


def key_hashes(keys: list[str]):
    import numpy as np
    import xxhash
    return np.array([xxhash.xxh3_64_intdigest(k.encode("utf-8", "surrogatepass")) for k in keys], "u8")


def places(h, segments: int):
    """For each hash its segment, and its bits there (one row for each)."""
    import numpy as np
    mixed = h * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    bits = np.stack([(mixed >> np.uint64(16 * i)) & np.uint64(SEGMENT - 1) for i in range(HASHES)])
    return (h % np.uint64(segments)).astype("i8"), bits.astype("i8")


def packed(bits) -> bytes:
    """Sorted distinct bits of a segment: as they are, or as a bitmap if that
    is not larger."""
    import numpy as np
    if 2 * len(bits) < SEGMENT // 8:
        return bits.astype("<u2").tobytes()
    return np.packbits(np.bincount(bits, minlength=SEGMENT).astype(bool), bitorder="little").tobytes()


def bitmap(data: bytes):
    """The bitmap of what ``packed`` gives."""
    import numpy as np
    if len(data) == SEGMENT // 8:
        return np.frombuffer(data, "u1")
    return np.packbits(np.bincount(np.frombuffer(data, "<u2"), minlength=SEGMENT).astype(bool), bitorder="little")


_PARTS = "segment int, once binary, twice binary"


def _segments(h, segments: int) -> dict[str, list]:
    """The rows of the two filters for one run of hashes (one for each
    document that holds the key)."""
    import numpy as np
    distinct, counts = np.unique(h, return_counts=True)
    cols: dict[str, list] = {"segment": [], "once": [], "twice": []}
    sides = []
    for part in (distinct, distinct[counts > 1]):
        seg, bits = places(part, segments)
        at = np.unique((seg * SEGMENT + bits).ravel())
        sides.append((at & (SEGMENT - 1), np.searchsorted(at, np.arange(segments + 1) * SEGMENT)))
    (once, a), (twice, b) = sides
    for s in np.flatnonzero(np.diff(a)).tolist():
        cols["segment"].append(s)
        cols["once"].append(packed(once[a[s]:a[s + 1]]))
        cols["twice"].append(packed(twice[b[s]:b[s + 1]]))
    return cols


def twice_filter(docs: DataFrame, bits: int, shortest: int):
    """The second filter as one array of bytes, from columns ``doc_id,
    text``."""
    import numpy as np
    segments = bits // SEGMENT
    out = schema(_PARTS)

    def build(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        form, held, n = arrow_schema(out), [], 0

        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                for text in batch.column(0).slice(at, _SLICE).to_pylist():
                    if keys := keys_of(text, shortest):
                        held.append(key_hashes(keys))
                        n += len(keys)
            if n > _FLUSH:
                yield pa.RecordBatch.from_pydict(_segments(np.concatenate(held), segments), schema=form)
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_pydict(_segments(np.concatenate(held), segments), schema=form)

    merged = schema("segment int, twice binary")

    def merge(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                a, b = bitmap(a), bitmap(b)
                if s in once:
                    b = twice[s] | b | (once[s] & a)
                    a = once[s] | a
                once[s], twice[s] = a, b
        yield pa.RecordBatch.from_pydict({"segment": list(twice), "twice": [packed(np.flatnonzero(
            np.unpackbits(v, bitorder="little"))) for v in twice.values()]}, schema=arrow_schema(merged))

    # one document counts once for a key, however many rows it has
    texts = docs.filter(F.col("doc_id").isNotNull()).select("text")
    found = np.zeros((segments, SEGMENT // 8), "u1")
    for s, data in (texts.mapInArrow(build, out).repartition("segment").mapInArrow(merge, merged)).collect():
        found[s] = bitmap(bytes(data))
    return found.ravel()


def suspects(keys: list[str], seen, segments: int) -> list[str]:
    """Those of ``keys`` that the second filter may hold."""
    import numpy as np
    if not keys:
        return []
    seg, bits = places(key_hashes(keys), segments)
    at = seg * SEGMENT + bits
    hit = ((seen[at >> 3] >> (at & 7).astype("u1")) & 1).all(axis=0)
    return [keys[i] for i in np.flatnonzero(hit)]


def dedup_lines(df: DataFrame, shortest: int = 10, id_col: str = "doc_id", text_col: str = "text",
                bits: int | None = None, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``df`` with the lines taken out of ``text_col`` whose key (of at least
    ``shortest`` code points) a document with a smaller id holds too.  The
    numbers of lines before and of lines dropped come as columns ``n_lines``
    and ``n_dropped`` (which replace columns of these names)."""
    spark = df.sparkSession
    bounded_batches(df)
    df = df.drop(n_lines, n_dropped)
    keys_col, lost_col, of = (fresh(df, n) for n in ("__keys", "__lost", "__id"))
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bits = bits or filter_bits(df.count())
    segments = bits // SEGMENT
    shared = spark.sparkContext.broadcast(twice_filter(docs, bits, shortest))

    marked_schema = StructType([*df.schema.fields, *schema(f"{keys_col} array<string>").fields])

    def mark(batches) -> Iterator:
        import pyarrow as pa
        seen = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                texts, ids = [part.column(part.schema.get_field_index(c)).to_pylist() for c in (text_col, id_col)]
                keys = [suspects(keys_of(t, shortest), seen, segments) if i is not None else []
                        for i, t in zip(ids, texts, strict=True)]
                yield part.append_column(pa.field(keys_col, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.string())))

    marked = df.mapInArrow(mark, marked_schema)
    held = cut(marked.select(F.col(id_col).alias(of), F.explode(keys_col).alias("key")), "line-suspects")
    repeated = cut(held.groupBy("key").agg(F.min(of).alias("first"), F.max(of).alias("last"))
                   .filter("first <> last").select("key", "first"), "line-repeats")
    losses = (held.join(repeated, "key").filter(F.col(of) != F.col("first"))
              .groupBy(of).agg(F.collect_set("key").alias(lost_col)))
    # nothing to take out of these: only the lines are counted, in the JVM (a second Python
    # function behind the first would double the workers of an executor)
    alone = marked.filter(F.size(keys_col) == 0).drop(keys_col).withColumns({
        n_lines: F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).cast("bigint"),
        n_dropped: F.lit(0).cast("bigint")})
    none = F.array().cast("array<string>")
    others = marked.filter(F.size(keys_col) > 0).drop(keys_col)
    others = (others.join(losses, others[id_col] == losses[of], "left").drop(of)
              .withColumn(lost_col, F.coalesce(lost_col, none)))

    kept_schema = StructType([*df.schema.fields, *schema(f"`{n_lines}` bigint, `{n_dropped}` bigint").fields])

    def rebuild(batches) -> Iterator:
        import pyarrow as pa
        form = arrow_schema(kept_schema)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                texts, lost = [part.column(part.schema.get_field_index(c)).to_pylist() for c in (text_col, lost_col)]
                kept, lines, dropped = [], [], []
                for text, gone in zip(texts, lost, strict=True):
                    all_lines = (text or "").split("\n")
                    lines.append(len(all_lines))
                    if gone:
                        gone = set(gone)
                        stay = [x for x in all_lines if line_key(x) not in gone]
                        kept.append("\n".join(stay))
                        dropped.append(len(all_lines) - len(stay))
                    else:
                        kept.append(text)
                        dropped.append(0)
                cols = {f.name: part.column(part.schema.get_field_index(f.name)) for f in kept_schema.fields[:-2]}
                cols |= {text_col: pa.array(kept, pa.string()), n_lines: lines, n_dropped: dropped}
                yield pa.RecordBatch.from_pydict(cols, schema=form)

    return alone.unionByName(others.mapInArrow(rebuild, kept_schema))
