"""Operator 2, benchmark decontamination by greedy string tiling.

Seeds: every run of ``seed`` tokens of a benchmark item.  The items are a
stated query set; they are taken in blocks of bounded size (``block_tokens``),
each broadcast to one map over the documents, so neither the benchmark nor the
documents are ever shuffled, sampled or crossed.  Within a map the join of the
documents' seeds with the block's is a lookup in the block's sorted seeds.

Tiling: a document and an item that share a seed are tiled by running
Karp-Rabin matching.  Rolling hashes of all unmarked runs of s tokens of both
sides are compared; a common run of s tokens holds common runs of every lesser
length, so the greatest s with a common hash is found by halving, and the
matches of that length are marked, each token once.  This is repeated with
lesser lengths down to ``seed``: always the longest match that is left is
marked.  A round costs a few passes over the two sides, whatever repeats they hold,
and there are no more rounds than lengths of tiles.  Tiles do not overlap and may
come in any order, so a passage whose sentences were reordered is still
covered.  Matches of ``seed`` tokens or more lie within runs of shared seeds,
so other tokens of the document are left out before the tiling starts, which
changes nothing.

``coverage`` is the share of the item's tokens in tiles; a document is
contaminated by an item from ``threshold`` on.

Tokens are runs of word characters, lower-cased; in scripts that are written
without spaces each character is a token.

Defined cases: an item of fewer than ``seed`` tokens says too little to
convict a document and matches nothing (``unusable_items`` lists them); null and empty
texts have no tokens and match nothing; a null document id is kept in pairs;
repeated rows give repeated pairs; repeated items are items of their own; an
empty table on either side gives no pairs.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import arrow_schema, cut, docs_of, schema, with_row_key

SEED = 5
THRESHOLD = 0.5
BLOCK_TOKENS = 2_000_000
_SLICE = 512
_BASE = 0x9E3779B97F4A7C15
#: Thai to Myanmar, Khmer, Japanese syllables and Chinese characters
_NO_SPACES = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_token = re.compile(rf"[^\W{_NO_SPACES}]+|[{_NO_SPACES}]").findall


def tokens(text: str | None) -> list[str]:
    return _token((text or "").lower())


class Side:
    """One side of a tiling: tokens (0 matches nothing) and which are unmarked,
    with hashes of all runs of any length from running sums."""

    def __init__(self, ids):
        import numpy as np
        self.ids = np.asarray(ids, "u8")
        self.free = self.ids > 0
        n = len(self.ids)
        mixed = (self.ids ^ self.ids >> np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x165667B19E3779F9)
        self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _BASE, "u8"))])
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * self.power[:n])])

    def runs(self, s: int):
        """(starts, hashes) of the unmarked runs of ``s`` tokens."""
        import numpy as np
        marked = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(marked[s:] == marked[:-s])
        return at, (self.sums[at + s] - self.sums[at]) * self.power[len(self.ids) - at]


def common(pattern: Side, text: Side, s: int):
    """(pattern starts, their hashes, text starts, their hashes) of the runs
    of ``s`` tokens whose hashes occur on both sides, or None."""
    import numpy as np
    p, hp = pattern.runs(s)
    if not len(p):
        return None
    t, ht = text.runs(s)
    keys = np.unique(hp)
    near = keys[np.minimum(np.searchsorted(keys, ht), len(keys) - 1)] == ht
    return (p, hp, t[near], ht[near]) if near.any() else None


def longest(pattern: Side, text: Side, least: int, most: int):
    """The greatest run length from ``least`` to ``most`` with a common hash,
    and ``common`` for it; (0, None) if there is none."""
    if most < least:
        return 0, None
    if got := common(pattern, text, most):
        return most, got
    best, got = 0, None
    low, high = least, most - 1
    while low <= high:
        s = (low + high) // 2 if best else low          # whether any is left at all comes first
        if found := common(pattern, text, s):
            best, got, low = s, found, s + 1
        else:
            high = s - 1
    return best, got


def tile(pattern, text, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in pattern, start in text, length) of each
    tile.  Tokens are positive numbers; a 0 matches nothing."""
    import numpy as np
    one, other = Side(pattern), Side(text)
    # both sides' powers count from their own ends: bring them to the longer one's
    n = max(len(one.ids), len(other.ids))
    for side in (one, other):
        side.sums = side.sums * _power(n - len(side.ids))
    tiles: list[tuple[int, int, int]] = []
    s, got = longest(one, other, least, min(len(one.ids), len(other.ids)))
    while got:
        waiting: dict[int, list[int]] = defaultdict(list)
        for p, h in zip(got[0][::-1].tolist(), got[1][::-1].tolist(), strict=True):
            waiting[h].append(p)
        after = 0
        for t, h in zip(got[2].tolist(), got[3].tolist(), strict=True):
            if t < after:
                continue
            here, passed = waiting[h], []
            while here:
                p = here.pop()
                # all that was marked in this round is s long, so it covers an end of what it meets
                if not (one.free[p] and one.free[p + s - 1]):
                    continue
                if np.array_equal(one.ids[p:p + s], other.ids[t:t + s]):
                    tiles.append((p, t, s))
                    one.free[p:p + s] = other.free[t:t + s] = False
                    after = t + s
                    break
                passed.append(p)                        # equal hashes of other tokens
            here += passed[::-1]
        s, got = longest(one, other, least, s - 1)
    return tiles


def _power(n: int):
    import numpy as np
    return np.uint64(pow(_BASE, n, 1 << 64))


class Block:
    """Benchmark items with their token numbers and sorted seed hashes."""

    def __init__(self, items: list[tuple], seed: int):
        import numpy as np
        self.seed, self.number = seed, {}
        self.items = []                         # (item id, token numbers)
        pairs = [np.zeros((0, 2), "u8")]
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in tokens(text)]
            if len(ids) >= seed:
                h = np.unique(seed_hashes(np.array(ids, "u8"), seed))
                pairs.append(np.stack([h, np.full(len(h), len(self.items), "u8")], axis=1))
                self.items.append((item, ids))
        pairs = np.concatenate(pairs)
        self.keys, self.owner = pairs[order := np.argsort(pairs[:, 0], kind="stable"), 0], pairs[order, 1].astype("i8")

    def pairs(self, text: str | None) -> Iterator[tuple]:
        """(item id, tokens of the item, tokens in tiles, tiles) for each item
        that shares a seed with the text."""
        import numpy as np
        get = self.number.get
        ids = np.array([get(w, 0) for w in tokens(text)], "u8")
        h = seed_hashes(ids, self.seed)
        if not len(h) or not len(self.keys):
            return
        hits = np.flatnonzero(self.keys[np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)] == h)
        if not len(hits):
            return
        near = np.zeros(len(ids) + 1, np.int64)         # tokens that lie in a shared seed
        np.add.at(near, hits, 1)
        np.add.at(near, hits + self.seed, -1)
        kept = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        # runs of such tokens, with a token that matches nothing between them
        part = np.insert(ids[kept], np.flatnonzero(np.diff(kept) > 1) + 1, 0)
        shared = np.unique(h[hits])
        low, high = np.searchsorted(self.keys, shared, "left"), np.searchsorted(self.keys, shared, "right")
        for k in np.unique(np.concatenate([self.owner[a:b] for a, b in zip(low, high, strict=True)])).tolist():
            item, pattern = self.items[k]
            tiles = tile(pattern, part, self.seed)
            if tiles:
                yield item, len(pattern), sum(n for _, _, n in tiles), len(tiles)


def seed_hashes(ids, s: int):
    """A 64-bit hash of each run of ``s`` tokens; runs with an unknown token
    (0) hash to values that the benchmark lacks or that fail the tiling."""
    import numpy as np
    if len(ids) < s:
        return np.zeros(0, "u8")
    out = np.zeros(len(ids) - s + 1, "u8")
    for k in range(s):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k:len(ids) - s + 1 + k] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)
        out ^= out >> np.uint64(32)
    return out


def unusable_items(benchmark: DataFrame, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """The items of fewer than ``seed`` tokens, which no document is held
    against: rows of ``benchmark`` with ``n_tokens``."""
    n = F.udf(lambda t: len(tokens(t)), "int")
    return benchmark.withColumn("n_tokens", n(F.col(text_col))).filter(F.col("n_tokens") < seed)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_tokens: int) -> Iterator[list[tuple]]:
    """The benchmark's items in runs of at most ``block_tokens`` tokens (an
    item above that is a run of its own); they stream by on the driver."""
    held, n = [], 0
    for item, text in benchmark.select(item_col, text_col).toLocalIterator():
        size = len(tokens(text))
        if held and n + size > block_tokens:
            yield held
            held, n = [], 0
        held.append((item, text))
        n += size
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, block_tokens: int = BLOCK_TOKENS,
            id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text") -> DataFrame:
    """All pairs that share a seed: ``doc_id, item_id, item_tokens,
    tiled_tokens, tiles, coverage``."""
    spark = docs.sparkSession
    docs = docs_of(docs, id_col, text_col)
    out = schema(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
                 f"item_id {benchmark.schema[item_col].dataType.simpleString()}, item_tokens bigint, "
                 "tiled_tokens bigint, tiles bigint")
    found = spark.createDataFrame([], out)
    for items in blocks(benchmark, item_col, item_text_col, block_tokens):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared) -> Iterator:
            import pyarrow as pa
            block, form, rows = Block(shared.value, seed), arrow_schema(out), []
            for batch in batches:
                for at in range(0, batch.num_rows, _SLICE):
                    part = batch.slice(at, _SLICE)
                    for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        rows += [(doc, *p) for p in block.pairs(text)]
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), form, strict=True)], schema=form)
                        rows = []

        found = found.unionByName(docs.mapInArrow(run, out))
    return found.withColumn("coverage", F.col("tiled_tokens") / F.col("item_tokens"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """The pairs of ``matches`` whose coverage reaches ``threshold``."""
    return matches(docs, benchmark, **how).filter(F.col("coverage") >= threshold)


def decontaminate(df: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
                  **how) -> DataFrame:
    """``df`` without the rows whose own text is contaminated, whatever their
    ids (``id_col`` is not read)."""
    rows, key = with_row_key(df)
    # written first, so the planner knows how few they are when it plans the anti join
    bad = cut(contaminated(rows, benchmark, threshold, id_col=key, **how).select(
        F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    return rows.join(bad, rows[key] == bad["__bad"], "left_anti").select(*df.columns)
