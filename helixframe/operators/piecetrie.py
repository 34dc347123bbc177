"""Longest-match WordPiece in one pass over a word (TOK-10).

A trie holds the word-initial pieces, a second root the continuations.  Each
node knows what the longest-match rule would have cut off by the time no child
fits (``popped``) and where in the trie the rest of the text read so far stands
(``fails``), as in Aho and Corasick's automaton and its use for WordPiece
(Song et al., 2021).  Every character is read once and every step back emits
pieces, so a word costs time in proportion to its length, whatever the
vocabulary.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping

_SHIFT = 21                                             # a code point fits in so many bits


class PieceTrie:
    """``vocab``: piece -> id; continuations begin with ``prefix``."""

    def __init__(self, vocab: Mapping[str, int], unk: int, prefix: str = "##", max_chars: int = 100):
        self.unk, self.max_chars = unk, max_chars
        self.step: dict[int, int] = {}                  # node << 21 | code point -> node
        ends: list[int | None] = [None, None]           # 0: the start of a word, 1: inside a word
        children: list[list[tuple[int, int]]] = [[], []]

        def insert(node: int, piece: str, i: int) -> None:
            for c in map(ord, piece):
                at = self.step.get(node << _SHIFT | c)
                if at is None:
                    at = self.step[node << _SHIFT | c] = len(ends)
                    ends.append(None)
                    children.append([])
                    children[node].append((c, at))
                node = at
            ends[node] = i

        for piece, i in vocab.items():
            if piece:
                insert(0, piece, i)
                if piece.startswith(prefix) and len(piece) > len(prefix):
                    insert(1, piece[len(prefix):], i)
        # no way on from either root; other nodes from those above them
        self.fails: list[int | None] = [None] * len(ends)
        self.popped: list[tuple[int, ...]] = [()] * len(ends)
        todo = deque([0, 1])
        while todo:
            node = todo.popleft()
            for c, child in children[node]:
                todo.append(child)
                if ends[child] is not None:
                    self.fails[child], self.popped[child] = 1, (ends[child],)
                    continue
                at, out = self.fails[node], list(self.popped[node])
                while at is not None and at << _SHIFT | c not in self.step:
                    out += self.popped[at]
                    at = self.fails[at]
                if at is not None:
                    self.fails[child], self.popped[child] = self.step[at << _SHIFT | c], tuple(out)

    def encode(self, word: str) -> list[int]:
        """The ids of the longest pieces from the left, or the unknown id
        alone."""
        if len(word) > self.max_chars:
            return [self.unk]
        step, fails, popped, node = self.step, self.fails, self.popped, 0
        out: list[int] = []
        for c in map(ord, word):
            while (at := step.get(node << _SHIFT | c)) is None:
                back = fails[node]
                if back is None:
                    return [self.unk]
                out += popped[node]
                node = back
            node = at
        while node > 1:
            back = fails[node]
            if back is None:
                return [self.unk]
            out += popped[node]
            node = back
        return out
