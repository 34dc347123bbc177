"""Operator 5, SentencePiece encoding and decoding by N-best segmentation.

Over the lattice of a part of the text (every substring that is a piece is an
edge; a character that is no piece is one edge of byte pieces) a forward
Viterbi pass gives the best score of reaching each position.  A backward
A-star search from the end then uses these scores as its heuristic; they are
exact, so hypotheses leave the queue in the order of their whole scores and
the first N that reach the start are the N best.

No piece crosses from one part (``Pieces.parts``) into the next, so the
lattice of a text is the chain of its parts' lattices: the best segmentation
of the text joins the parts' best, and its N best come from the N-1 words
where a worse choice costs least, by the same best-first search over words.

Words of up to 32 characters that need no byte pieces are segmented whole, the
distinct new ones of a slice of rows together (``piece_batches``); longer or odd
ones part by part.  Only the best segmentation and the loss of the second are
kept of a word; the few words whose other choices count are searched again.

Shape: one map over the scan, with words' results in a bounded table per
worker (which changes no result; ``encode`` gives it back after each task); no
shuffle, nothing collected.
Defined cases: null and empty texts have no pieces, one empty segmentation of
score 0 and decode to the empty text; a null id stays null; repeated rows give
repeated rows; an empty table gives no rows.  A space mark (U+2581) in a text
is the same as a space, as in the library, and decodes to a space.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import insort
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import arrow_schema, by_rows, docs_of, schema, worker_state
from helixframe.llm.piece_batches import Found, Lattices
from helixframe.llm.pieces import SPACE, Pieces, no_gc

CACHE_ENTRIES = 1_000_000
_LONG = 64                                              # longer words are not kept whole
_NONE = float("inf")


def lattice(part: str, pieces: Pieces) -> tuple[list[float], list[list[tuple]]]:
    """The forward Viterbi score of each position, and for each position the
    edges that end there: (start, score, ids)."""
    n, trie, known, longest = len(part), pieces.trie, pieces.score, pieces.longest
    best = [0.0] + [-_NONE] * n
    into: list[list[tuple]] = [[] for _ in range(n + 1)]
    for i in range(n):
        so_far, at = best[i], trie
        if part[i] not in known:
            s = pieces.unknown_score
            into[i + 1].append((i, s, pack(pieces.byte_ids[b] for b in part[i].encode())))
            best[i + 1] = max(best[i + 1], so_far + s)
        j = i
        for c in part[i:i + longest]:
            if (node := at.get(c)) is None:
                break
            at, s, piece = node
            j += 1
            if s is not None:
                into[j].append((i, s, piece))
                if so_far + s > best[j]:
                    best[j] = so_far + s
    return best, into


def n_best(part: str, pieces: Pieces, n: int) -> list[tuple[float, bytes]]:
    """The ``n`` best segmentations of ``part`` as (score, ids), best first."""
    best, into = lattice(part, pieces)
    # (-(score so far + best way to the start), number, position, score so far, ids of the edge, what follows).
    # The heuristic is exact, so each entry ends in a segmentation of just that score: the agenda needs no more
    # entries than segmentations are still to be found.
    agenda: list[tuple] = [(-best[-1], 0, len(part), 0.0, b"", None)]
    found: list[tuple[float, bytes]] = []
    number, room = 0, n
    while agenda and room:
        top = agenda.pop(0)
        _, _, j, so_far, _, _ = top
        if j == 0:
            ids, at = [], top
            while at is not None:
                ids.append(at[4])
                at = at[5]
            found.append((so_far, b"".join(ids)))
            room -= 1
            continue
        for i, s, edge in into[j]:
            f = -(best[i] + s + so_far)
            s += so_far
            if len(agenda) < room or f < agenda[-1][0]:
                number += 1
                insort(agenda, (f, number, i, s, edge, top))
                if len(agenda) > room:
                    agenda.pop()
    return found


def pack(ids) -> bytes:
    """Ids are kept as little-endian 32-bit integers."""
    return b"".join([i.to_bytes(4, "little") for i in ids])


def chained(parts: list[Found], n: int) -> Found:
    """The ``n`` best of a few independent parts, from theirs."""
    best: Found = [(0.0, b"")]
    for options in parts:
        best = sorted([(t + s, i + ids) for t, i in best for s, ids in options], key=itemgetter(0), reverse=True)[:n]
    return best


class Words(dict):
    """Numbers words as they are asked for; ``new`` are those not looked at
    yet.  For each number it holds the best score, what the second best
    segmentation loses (infinite if there is none) and the best one's ids."""

    def __init__(self):
        import numpy as np
        super().__init__()
        self.new: list[str] = []
        self.score, self.gap, self.length, self.at = np.zeros(0), np.zeros(0), np.zeros(0, "i8"), np.zeros(0, "i8")
        self.ids = np.zeros(0, "<i4")

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def learn(self, found: list[tuple[float, float, bytes]]) -> None:
        """Score, gap and ids of the new words, in their order."""
        import numpy as np
        if found:
            score, gap, ids = zip(*found, strict=True)
            length = np.array([len(i) // 4 for i in ids], "i8")
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(length) - length])
            self.score, self.gap = np.concatenate([self.score, score]), np.concatenate([self.gap, gap])
            self.length = np.concatenate([self.length, length])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<i4")])
        self.new = []


class Segmenter:
    def __init__(self, model: bytes, n: int, cache_entries: int = CACHE_ENTRIES):
        import numpy as np
        self.pieces, self.n = Pieces(model), n
        for node in _nodes(self.pieces.trie):
            if node[1] is not None:
                node[2] = pack([node[2]])
        self.lattices = Lattices(self.pieces)
        self.entries, self.known, self.odd = cache_entries, Words(), False
        # for decoding: the bytes of all pieces, one after another
        raw = [bytes((self.pieces.byte_of[i],)) if i in self.pieces.byte_of else t.replace(SPACE, " ").encode()
               for i, t in enumerate(self.pieces.text)]
        self.raw = np.frombuffer(b"".join(raw), "u1")
        self.raw_len = np.array([len(r) for r in raw], "i8")
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len

    def forget(self) -> None:
        """Gives the words' memory back; a worker outlives its tasks and may
        serve other operators next."""
        self.known, self.odd = Words(), False

    def parts(self, word: str) -> list[str]:
        """What a word is segmented by: itself if it is short and plain, else
        parts that no piece crosses."""
        if self.pieces.ends_apart(word):
            return [word[:-1], word[-1]]
        return [word] if self.lattices.fits(word) else self.pieces.parts(word)

    def options(self, word: str) -> Found:
        """The ``n`` best segmentations of a word."""
        parts = self.parts(word)
        if len(parts) == 1:
            return n_best(word, self.pieces, self.n)
        return chained([self.options(p) for p in parts], self.n)

    def learn(self) -> None:
        """Segments the words asked for since the last time: short ones
        together, others from their parts."""
        known = self.known
        first = len(known) - len(known.new)
        of = [self.parts(w) for w in known.new]
        done = 0
        while done < len(known.new):                    # parts may be new words, too
            for word in known.new[done:]:
                if len(of) <= done:
                    of.append(self.parts(word))
                for p in of[done] if len(of[done]) > 1 else ():
                    known[p]
                done += 1
        got: dict[int, tuple[float, float, bytes]] = {}
        two, whole = min(self.n, 2), [k for k, p in enumerate(of) if len(p) == 1]
        short = [k for k in whole if self.lattices.fits(known.new[k])]
        found = dict(zip(short, self.lattices.n_best([known.new[k] for k in short], two), strict=True))
        for k in whole:
            f = found.get(k) or n_best(known.new[k], self.pieces, two)
            got[k] = f[0][0], f[0][0] - f[1][0] if len(f) > 1 else _NONE, f[0][1]
        for k in range(len(of) - 1, -1, -1):            # parts stand behind the word that asked for them, or were known
            if k not in got:
                each = [self.told(known[p], first, got) for p in of[k]]
                got[k] = sum([s for s, _, _ in each]), min([g for _, g, _ in each]), b"".join([i for _, _, i in each])
        known.learn([got[k] for k in range(len(of))])

    def told(self, number: int, first: int, got: dict[int, tuple]) -> tuple[float, float, bytes]:
        if number >= first:
            if number - first not in got:               # asked for by an earlier word as well
                each = [self.told(self.known[p], first, got) for p in self.parts(self.known.new[number - first])]
                got[number - first] = (sum([s for s, _, _ in each]), min([g for _, g, _ in each]),
                                       b"".join([i for _, _, i in each]))
            return got[number - first]
        known, at = self.known, self.known.at[number]
        return known.score[number], known.gap[number], known.ids[at:at + known.length[number]].tobytes()

    def texts(self, texts: list[str | None]) -> list[Found]:
        """The texts' N best segmentations as (score, ids)."""
        split = [self.words(t) for t in texts]
        number = self.known.__getitem__
        numbers = [list(map(number, words)) for words in split]
        self.learn()
        got = [self.join(words, of) for words, of in zip(split, numbers, strict=True)]
        if self.odd or len(self.known) >= self.entries:
            self.forget()
        return got

    def words(self, text: str | None) -> list[str]:
        words = self.pieces.words(self.pieces.normal(text or ""))
        if max(map(len, words), default=0) > _LONG:
            words = [p for w in words for p in (self.pieces.parts(w) if len(w) > _LONG else (w,))]
            self.odd |= max(map(len, words)) > _LONG
        return words

    def text(self, text: str | None) -> Found:
        """The text's N best segmentations as (score, ids)."""
        return self.texts([text])[0]

    def join(self, words: list[str], numbers: list[int]) -> Found:
        """The ``n`` best of a chain of words: best-first search over how far
        each is from its best.  Only the ``n - 1`` words with the cheapest
        second choice can differ from their best in any result."""
        import numpy as np
        if not words:
            return [(0.0, b"")]
        known, numbers = self.known, np.array(numbers)
        length = known.length[numbers]
        end = np.cumsum(length)
        first = known.ids[np.arange(end[-1]) + np.repeat(known.at[numbers] - end + length, length)].tobytes()
        total = float(known.score[numbers].sum())
        out = [(total, first)]
        if self.n == 1:
            return out
        gaps = known.gap[numbers]
        cheap = [int(gaps.argmin())] if self.n == 2 else np.argsort(gaps, kind="stable")[:self.n - 1].tolist()
        free = sorted(k for k in cheap if gaps[k] < _NONE)
        start, options = [4 * int(end[k] - length[k]) for k in free], [self.options(words[k]) for k in free]
        agenda, seen = [(0.0, (0,) * len(free))], set()
        while agenda and len(out) <= self.n:
            loss, choice = heapq.heappop(agenda)
            if choice in seen:
                continue
            seen.add(choice)
            if any(choice):
                ids, done = b"", 0
                for at, k, of, c in zip(start, free, options, choice, strict=True):
                    ids += first[done:at] + of[c][1]
                    done = at + 4 * int(length[k])
                out.append((total - loss, ids + first[done:]))
            for a, of in enumerate(options):
                if (c := choice[a] + 1) < len(of):
                    heapq.heappush(agenda, (loss + of[c - 1][0] - of[c][0], (*choice[:a], c, *choice[a + 1:])))
        return out[:self.n]

    def decode(self, ids) -> str:
        """The text of a segmentation (ids as an integer array), without the
        mark put before it."""
        import numpy as np
        length = self.raw_len[ids]
        end = np.cumsum(length)
        n = int(end[-1]) if len(end) else 0
        take = np.arange(n) + np.repeat(self.raw_at[ids] - end + length, length)
        return self.raw[take].tobytes()[1:].decode("utf-8", "replace")

    def same(self, ids: bytes, text: str | None) -> bool:
        """Whether packed ids decode to the text (U+2581 is a space)."""
        import numpy as np
        return self.decode(np.frombuffer(ids, "<i4")) == (text or "").replace(SPACE, " ")


def _nodes(at: dict):
    stack = list(at.values())
    while stack:
        node = stack.pop()
        yield node
        stack += node[0].values()


def _lists(rows: list[list[bytes]]):
    """Packed ids as an Arrow array of lists of lists of integers."""
    import numpy as np
    import pyarrow as pa
    flat = [b for r in rows for b in r]
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes, dtype="i8")]).astype("i4"))
    ids = pa.ListArray.from_arrays(ends([len(b) // 4 for b in flat]), pa.array(np.frombuffer(b"".join(flat), "<i4")))
    return ids, pa.ListArray.from_arrays(ends([len(r) for r in rows]), ids)


def _kept(docs: DataFrame, keep) -> str:
    return "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)


def encode(df: DataFrame, model: bytes, n: int = 2, id_col: str = "doc_id", text_col: str = "text",
           keep: tuple[str, ...] = (), cache_entries: int = CACHE_ENTRIES, compare: bool = False) -> DataFrame:
    """Every row's ``n`` best segmentations: ``doc_id``, the columns named in
    ``keep``, ``ids`` (the best), ``scores`` (of all, best first) and
    ``alternatives`` (ids of the others).  ``cache_entries`` words, of a quarter of
    a kilobyte or so each, are kept per task.

    ``compare`` adds ``library_ids``, what the model's own library gives, and
    ``decoded_ok``, whether ``ids`` decode to the text.  The two kinds of ids
    are not the same where the model's scores are merge ranks instead of log
    probabilities: the library merges in the order of the ranks, N-best adds
    them up."""
    docs = docs_of(df, id_col, text_col, **{c: c for c in keep})
    out = schema(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}{_kept(docs, keep)}, ids array<int>, "
                 "scores array<double>, alternatives array<array<int>>"
                 + ", library_ids array<int>, decoded_ok boolean" * compare)
    key = f"nbest_{hash(model)}_{n}_{cache_entries}"

    def rows(ids, texts, *others):
        seg = worker_state(key, lambda: Segmenter(model, n, cache_entries))
        with no_gc():
            got = seg.texts(texts)
        made = {"doc_id": ids, **dict(zip(keep, others, strict=True)), "ids": _lists([[g[0][1]] for g in got])[0],
                "scores": [[s for s, _ in g] for g in got],
                "alternatives": _lists([[i for _, i in g[1:]] for g in got])[1]}
        if compare:
            import numpy as np
            import sentencepiece
            library = worker_state(f"sp_{hash(model)}", lambda: sentencepiece.SentencePieceProcessor(model_proto=model))
            made["library_ids"] = _lists([[np.array(library.encode(t or ""), "<i4").tobytes()] for t in texts])[0]
            made["decoded_ok"] = [seg.same(g[0][1], t) for g, t in zip(got, texts, strict=True)]
        return made

    done = lambda: worker_state(key, lambda: Segmenter(model, n, cache_entries)).forget()
    return docs.mapInArrow(by_rows(rows, ["doc_id", "text", *keep], arrow_schema(out), done), out)


def decode(df: DataFrame, model: bytes, ids_col: str = "ids", into: str = "decoded",
           keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The texts of the segmentations in ``ids_col`` as column ``into``, next
    to the columns in ``keep``; null ids decode to null."""
    src = df.select(*keep, F.col(ids_col).alias("__ids"))
    out = schema(_kept(src, keep)[2:] + f", `{into}` string")
    key = f"nbest_{hash(model)}_1"

    def rows(ids, *others):
        import numpy as np
        seg = worker_state(key, lambda: Segmenter(model, 1))
        return {**dict(zip(keep, others, strict=True)), into: [None if i is None else seg.decode(np.array(i, "i4")) for i in ids]}

    return src.mapInArrow(by_rows(rows, ["__ids", *keep], arrow_schema(out)), out)


def round_trip(df: DataFrame, model: bytes, n: int = 2, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Digest of encoding each row and decoding its best segmentation, in one
    map: ``doc_id, n_pieces, best_score, last_score`` (of the n-th best, or
    the last there is), ``ids_sha256`` (of the ids as little-endian 32-bit
    integers) and ``decoded_ok`` (the decoded text is the text, with U+2581 as
    a space)."""
    docs = docs_of(df, id_col, text_col)
    out = schema(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pieces bigint, best_score double, "
                 "last_score double, ids_sha256 string, decoded_ok boolean")
    key = f"nbest_{hash(model)}_{n}"

    def rows(ids, texts):
        seg = worker_state(key, lambda: Segmenter(model, n))
        with no_gc():
            got = seg.texts(texts)
        return {"doc_id": ids, "n_pieces": [len(g[0][1]) // 4 for g in got], "best_score": [g[0][0] for g in got],
                "last_score": [g[-1][0] for g in got],
                "ids_sha256": [hashlib.sha256(g[0][1]).hexdigest() for g in got],
                "decoded_ok": [seg.same(g[0][1], t) for g, t in zip(got, texts, strict=True)]}

    return docs.mapInArrow(by_rows(rows, ["doc_id", "text"], arrow_schema(out)), out)
