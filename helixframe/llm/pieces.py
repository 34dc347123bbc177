"""A SentencePiece vocabulary as plain Python tables, and the exact split of a
text into parts that no piece can cross.

The vocabulary file is read once on the driver and travels to the tasks as
bytes (its size is checked), so executors need neither the file nor its path.
"""

from __future__ import annotations

import gc
import re
from contextlib import contextmanager
from operator import add

MAX_MODEL_BYTES = 64 << 20
SPACE = "\u2581"


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        model = f.read(MAX_MODEL_BYTES + 1)
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"{path}: a vocabulary file above {MAX_MODEL_BYTES} bytes")
    return model


class Pieces:
    """``score`` maps each piece that may occur in a segmentation to its
    score, ``ids`` to its id; ``byte_ids`` are the 256 byte pieces.

    Supported are models with byte fallback, the identity normaliser, a space
    mark put before the text and no removal of spaces; others raise.
    """

    def __init__(self, model: bytes):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        probe = sp.normalize(" a  \ufb01\u2460 ")
        if probe != f"{SPACE}{SPACE}a{SPACE}{SPACE}\ufb01\u2460{SPACE}":
            raise ValueError(f"the vocabulary's normaliser is not supported: {probe!r}")
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.score = {self.text[i]: sp.get_score(i) for i in plain}
        self.ids = {self.text[i]: i for i in plain}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(sp.is_byte(i) for i in self.byte_ids):
            raise ValueError("the vocabulary has no byte pieces")
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.longest = max(map(len, self.score))
        self.unknown_score = min(self.score.values()) - 10.0
        # merge order: 0 is merged first; equal scores share a rank
        order = {v: k for k, v in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: order[v] for p, v in self.score.items()}
        # character -> [what may follow, score or None, id]
        self.trie: dict[str, list] = {}
        for p, v in self.score.items():
            at = self.trie
            for c in p:
                node = at.setdefault(c, [{}, None, None])
                at = node[0]
            node[1:] = v, self.ids[p]
        # two characters that follow each other in no piece are never in one piece
        self.pairs = {p[i:i + 2] for p in self.score for i in range(len(p) - 1)}
        crosses = any(a != SPACE and b == SPACE for a, b in self.pairs)
        # a line feed that no piece of two characters holds is a part of its own
        alone = "" if any("\n" in p for p in self.pairs) else "\n"
        split = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|{alone}" if alone else ""))
        self.words = (lambda s: [s]) if crosses else split.findall

    def normal(self, text: str) -> str:
        """The text with spaces as marks and the mark put before it."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def parts(self, word: str) -> list[str]:
        """``word`` cut at every place that no piece crosses; any
        segmentation of it is one of each part."""
        pairs, out, start = self.pairs, [], 0
        if pairs.issuperset(map(add, word, word[1:])):
            return [word]
        for i in range(1, len(word)):
            if word[i - 1:i + 1] not in pairs:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def ends_apart(self, word: str) -> bool:
        """Whether the last character is a part of its own, as after a word
        with punctuation."""
        return 1 < len(word) <= 64 and word[-2:] not in self.pairs


@contextmanager
def no_gc():
    """The caches hold many small objects and no cycles; collecting them again
    and again would cost more than filling them."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


class BoundedCache(dict):
    """A dictionary of bounded size in two generations: when the young one is
    full it becomes the old one, and what is asked for again (``again``) moves
    back.  Long keys are not kept.  It only saves work: results never depend
    on it."""

    def __init__(self, entries: int, key_chars: int = 64):
        super().__init__()
        self.entries, self.key_chars, self.old = entries, key_chars, {}

    def keep(self, key: str, value):
        if len(key) <= self.key_chars:
            if 2 * len(self) >= self.entries:
                self.old = self.copy()
                self.clear()
            self[key] = value
        return value

    def again(self, key: str):
        """The value of a key that is only in the old generation, else None."""
        value = self.old.get(key)
        return None if value is None else self.keep(key, value)

    def forget(self) -> None:
        self.clear()
        self.old = {}
