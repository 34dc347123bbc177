"""Operator 3, token counts by heap-and-linked-list byte-pair merging.

The symbols of a text (characters of the vocabulary; other characters as their
UTF-8 bytes) form a linked list, every adjacent pair that is a piece waits in
a heap by (rank, position), and the lowest is popped and merged until none is
left.  The count is the initial symbols minus the merges; no identifier is
emitted.

Merges never cross a place where no piece has these two characters side by
side, so each such part is merged on its own and counts of parts repeat: they
are kept in a bounded cache per worker, which changes no result.

Shape: one map over the scan; no shuffle, nothing collected.
Defined cases: null and empty texts have 0 bytes and 0 tokens; a repeated row
gives a repeated row; a null id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame

from helixframe.llm.common import arrow_schema, by_rows, docs_of, schema, worker_state
from helixframe.llm.pieces import BoundedCache, Pieces, no_gc

CACHE_ENTRIES = 500_000
OUT = "doc_id {id}, n_bytes bigint, n_tokens bigint, over_limit boolean"


def merges_of(part: str, rank: dict[str, int]) -> int:
    """How many merges byte-pair merging does in ``part``: the pair of lowest
    rank first, the leftmost among equals.  Heap entries are
    ``rank << 32 | position of the left symbol``."""
    n = len(part)
    heap = [rank[p] << 32 | i for i in range(n - 1) if (p := part[i:i + 2]) in rank]
    if not heap:
        return 0
    heapq.heapify(heap)
    pop, push, get = heapq.heappop, heapq.heappush, rank.get
    symbol, after, before = list(part), list(range(1, n + 1)), list(range(-1, n))
    symbol.append(None)                                 # stands after the last
    merges = 0
    while heap:
        top = pop(heap)
        i = top & 0xFFFFFFFF
        left, j = symbol[i], after[i]
        right = symbol[j]
        if left is None or right is None or get(piece := left + right) != top >> 32:
            continue                                    # one side was merged meanwhile
        symbol[i], symbol[j] = piece, None
        k = after[i] = after[j]
        merges += 1
        if k < n:
            before[k] = i
            if (r := get(piece + symbol[k])) is not None:
                push(heap, r << 32 | i)
        h = before[i]
        if h >= 0 and (r := get(symbol[h] + piece)) is not None:
            push(heap, r << 32 | h)
    return merges


class Counter:
    def __init__(self, model: bytes):
        self.pieces = Pieces(model)
        self.of_word = BoundedCache(CACHE_ENTRIES)
        self.of_part = BoundedCache(CACHE_ENTRIES)

    def part(self, part: str) -> int:
        rank = self.pieces.rank
        symbols = sum([1 if c in rank else len(c.encode()) for c in part])
        return self.of_part.keep(part, symbols - merges_of(part, rank))

    def word(self, word: str) -> int:
        if self.pieces.ends_apart(word):
            head = word[:-1]
            return self.of_word.keep(word, (self.of_word.get(head) or self.word(head)) + self.part(word[-1]))
        get = self.of_part.get
        return self.of_word.keep(word, sum(get(p) or self.part(p) for p in self.pieces.parts(word)))

    def count(self, text: str | None) -> int:
        words = self.pieces.words(self.pieces.normal(text or ""))
        get = self.of_word.get
        return sum([get(w) or self.word(w) for w in words])


def token_counts(df: DataFrame, model: bytes, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``df``."""
    docs = docs_of(df, id_col, text_col)
    out = schema(OUT.format(id=docs.schema["doc_id"].dataType.simpleString()))
    key = f"bpe_{hash(model)}"

    def rows(ids, texts):
        counter = worker_state(key, lambda: Counter(model))
        with no_gc():
            tokens = [counter.count(t) for t in texts]
        return {"doc_id": ids, "n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": tokens,
                "over_limit": [n > limit for n in tokens]}

    return docs.mapInArrow(by_rows(rows, ["doc_id", "text"], arrow_schema(out)), out)
