"""Operator 8, SimHash near-duplicates with BK-trees.

Fingerprints are 64-bit; two link if they differ in at most ``radius`` bits.
Exact copies of a fingerprint are folded first (one row per fingerprint with
its smallest document), so a group of copies costs one row whatever its size.

Shards: the 64 bits are cut into ``radius + 2`` blocks.  Fingerprints that
differ in at most ``radius`` bits agree in two blocks at least, so each goes to
one shard per pair of blocks, named by these blocks' bits, and every link lies
within a shard.  The shard's tree sits in the task that holds the shard's
fingerprints: the trees of all shards hold every fingerprint, so a Spark
broadcast of them would pass a set that grows with the data through the
driver.  A shard above ``shard_rows`` is cut again by the blocks of its other
bits by the same rule, with no loss.

BK-tree: the child of a node under key d holds all fingerprints at distance d
from it.  A search for radius r at a node of distance d follows only the
children with keys d - r to d + r.  Each fingerprint of a shard is searched,
then added; a union-find over the hits leaves one row per fingerprint (its
group's smallest), not the pairs.

The rows of all shards are the edges of distributed connected components
(``components.py``); the class is named by the smallest document in it.

Defined cases: null and empty texts and texts without words have fingerprint 0
and link like any other; null ids are kept and never name a class with another
id; repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import arrow_schema, by_rows, cut, docs_of, schema
from helixframe.llm.components import components

SEED = 42
_CHUNK = 65_536


def fingerprint(text: str | None, words_per: int = 3, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a text: a bit is 1 if it is 1 in over
    half the hashes of the word shingles, repeats included."""
    import numpy as np
    import xxhash
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()   # bytes: ASCII case and space only
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= words_per:
        return hashed(b" ".join(words), seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends + 1 - np.array([len(w) + 1 for w in words])).tolist()
    joined, ends = b" ".join(words), ends.tolist()
    spans = list(zip(starts, ends[words_per - 1:], strict=False))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(spans), _CHUNK):
        h = np.array([hashed(joined[a:b], seed) for a, b in spans[at:at + _CHUNK]], ">u8")
        ones += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(spans)).tobytes(), "big")


def fingerprints(df: DataFrame, words_per: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) for every row."""
    docs = docs_of(df, id_col, text_col)
    out = schema(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")

    def rows(ids, texts):
        fps = [fingerprint(t, words_per) for t in texts]
        return {"doc_id": ids, "fp": [f - (1 << 64) if f >> 63 else f for f in fps]}

    return docs.mapInArrow(by_rows(rows, ["doc_id", "text"], arrow_schema(out)), out)


class BKTree:
    """Fingerprints by Hamming distance; a node is [fingerprint, children]."""

    def __init__(self):
        self.root: list | None = None

    def add(self, fp: int) -> None:
        if self.root is None:
            self.root = [fp, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ fp).bit_count()
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = [fp, {}]
                return
            node = child

    def within(self, fp: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (value ^ fp).bit_count()
            if d <= radius:
                found.append(value)
            if len(children) <= 2 * radius + 1:
                todo += [c for k, c in children.items() if d - radius <= k <= d + radius]
            else:
                todo += [children[k] for k in range(d - radius, d + radius + 1) if k in children]
        return found


def shard_links(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning set of the links within one shard: (fingerprint, an older
    one of its group), from a BK-tree that grows as it is searched."""
    tree, parent, links = BKTree(), {}, []

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for fp in fps:
        if fp in parent:
            continue
        hits = tree.within(fp, radius)
        tree.add(fp)
        parent[fp] = fp
        for hit in hits:
            a, b = top(fp), top(hit)
            if a != b:
                parent[a] = b
                links.append((fp, hit))
    return links


def _blocks(bits: list[int], n: int) -> list[int]:
    """Masks of ``n`` blocks over the given bit positions."""
    return [sum(1 << b for b in bits[i * len(bits) // n:(i + 1) * len(bits) // n]) for i in range(n)]


def shard_masks(radius: int) -> list[int]:
    """The bits that name a fingerprint's shards: each pair of blocks."""
    return [a | b for a, b in combinations(_blocks(list(range(64)), radius + 2), 2)]


def finer_masks(mask: int, radius: int) -> list[int]:
    """Masks that cut a shard of ``mask`` again, by pairs of blocks of its
    other bits."""
    return [mask | a | b for a, b in combinations(_blocks([b for b in range(64) if not mask >> b & 1], radius + 2), 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(masks: list[int]):
    return F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits"))
                               for k, m in enumerate(masks)])).alias("shard")


def links(fps: DataFrame, radius: int = 2, shard_rows: int = 20_000) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` that, closed over
    chains, join exactly those within ``radius`` bits of each other."""
    masks = shard_masks(radius)
    keyed = fps.select("fp", _keys(masks)).select("fp", F.col("shard.mask").alias("mask"), F.col("shard.bits").alias("bits"))
    size = cut(keyed.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-shards")
    sized = keyed.join(size, ["mask", "bits"])                        # shards of one row hold no link
    usual = sized.filter(F.col("n") <= shard_rows).select("fp", "mask", "bits")
    finer, k = [], len(masks)
    for at, mask in enumerate(masks):
        inner = finer_masks(mask, radius)
        finer.append(F.when(F.col("mask") == at, F.array(*[
            F.struct(F.lit(k + i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits"))
            for i, m in enumerate(inner)])))
        k += len(inner)
    hot = (sized.filter(F.col("n") > shard_rows).select("fp", F.explode(F.coalesce(*finer)).alias("s"))
           .select("fp", F.col("s.mask").alias("mask"), F.col("s.bits").alias("bits")))
    shards = usual.unionByName(hot)
    out = schema("a bigint, b bigint")

    def run(batches) -> Iterator:
        """Rows come sorted by shard; one shard's fingerprints are held."""
        import pyarrow as pa
        full = (1 << 64) - 1
        name, held, found = None, [], []

        def flush():
            if len(held) > 1:
                found.extend(shard_links(held, radius))

        def batch_of(rows):
            return pa.RecordBatch.from_pydict({"a": [_signed(a) for a, _ in rows], "b": [_signed(b) for _, b in rows]},
                                              schema=arrow_schema(out))
        for batch in batches:
            for fp, *key in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist()
                                  for c in ("fp", "mask", "bits")], strict=True):
                if key != name:
                    flush()
                    name, held = key, []
                held.append(fp & full)
            if len(found) > 10_000:
                yield batch_of(found)
                found = []
        flush()
        yield batch_of(found)

    return (shards.repartition("mask", "bits").sortWithinPartitions("mask", "bits").mapInArrow(run, out))


def near_duplicates(df: DataFrame, words_per: int = 3, radius: int = 2, id_col: str = "doc_id",
                    text_col: str = "text", shard_rows: int = 20_000) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the
    smallest id that chains of links reach, for every row of ``df``."""
    fps = cut(fingerprints(df, words_per, id_col, text_col), "simhash-fp")
    first = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    edges = links(first.select("fp"), radius, shard_rows)
    member = components(edges)                                         # fp in a link -> root fp
    linked = member.select(F.col("node").alias("fp"), "root")
    rooted = first.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    lowest = rooted.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(rooted.join(lowest, "root").select("fp", "component_id"), "simhash-named")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


__all__ = ["BKTree", "fingerprint", "fingerprints", "links", "near_duplicates", "shard_links"]
