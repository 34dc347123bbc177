"""N-best segmentation of many short words at once.

The same search as ``piece_nbest.n_best`` with an axis for the words: the
pieces' trie is a table of states, all substrings of all words are looked up
in it, a forward Viterbi pass over positions gives every word's heuristic, and
the backward A-star searches of all words take their steps together.  Entries
leave an agenda in the same order as in the search for one word, ties
included, so it does not matter which of the two a word went through.
"""

from __future__ import annotations

import re

from helixframe.llm.pieces import Pieces

LONGEST = 32
_BLOCK = 2048
Found = list[tuple[float, bytes]]


class Lattices:
    def __init__(self, pieces: Pieces):
        import numpy as np
        chars = sorted({c for p in pieces.score if len(p) > 1 for c in p} - {"\0"})
        nodes, at = [None, pieces.trie], 1              # 0: no piece begins so, 1: nothing read yet
        score, ids, links = [-np.inf, -np.inf], [0, 0], []
        while at < len(nodes):
            for c, (below, s, i) in nodes[at].items():
                links.append((at, c, len(nodes)))
                nodes.append(below)
                score.append(-np.inf if s is None else s)
                ids.append(0 if s is None else int.from_bytes(i, "little") if isinstance(i, bytes) else i)
            at += 1
        self.of_char = np.zeros(0x110000, "u2")
        self.of_char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        known = set(chars)
        self.next = np.zeros((len(nodes), len(chars) + 1), "u2" if len(nodes) < 1 << 16 else "i4")
        for a, c, b in links:
            if c in known:
                self.next[a, self.of_char[ord(c)]] = b
        self.score, self.ids, self.longest = np.array(score), np.array(ids, "<i4"), pieces.longest
        single = [c for c in chars if c in pieces.score]
        # words of these characters have a segmentation and need no byte pieces
        self.fits = re.compile(f"[{re.escape(''.join(single))}]{{1,{LONGEST}}}").fullmatch

    def n_best(self, words: list[str], n: int) -> list[Found]:
        """The ``n`` best segmentations of each word that ``fits``."""
        out: list[Found] = [[] for _ in words]
        for shortest, longest in ((1, 8), (9, 16), (17, LONGEST)):
            at = [k for k, w in enumerate(words) if shortest <= len(w) <= longest]
            for b in range(0, len(at), _BLOCK):
                block = at[b:b + _BLOCK]
                for k, found in zip(block, self._block([words[k] for k in block], longest, n), strict=True):
                    out[k] = found
        return out

    def edges(self, words: list[str], room: int):
        """Score and id of the piece of d + 1 characters that ends at position
        j of a word, at [word, j, d]; minus infinity where there is none."""
        import numpy as np
        size, most = len(words), min(room, self.longest)
        text = "".join([w.ljust(room, "\0") for w in words]).encode("utf-32-le")
        chars = self.of_char[np.frombuffer(text, "<u4").reshape(size, room)]
        score, ids, widest = np.full((size, room + 1, most), -np.inf), np.zeros((size, room + 1, most), "<i4"), 1
        for i in range(room):
            state = np.ones(size, self.next.dtype)
            for d in range(min(most, room - i)):
                state = self.next[state, chars[:, i + d]]
                if not state.any():
                    break
                widest = max(widest, d + 1)
                score[:, i + d + 1, d] = self.score[state]
                ids[:, i + d + 1, d] = self.ids[state]
        return score[:, :, :widest], ids[:, :, :widest]

    def _block(self, words: list[str], room: int, n: int) -> list[Found]:
        import numpy as np
        size = len(words)
        edge, piece = self.edges(words, room)
        most = edge.shape[2]
        # the best score through each edge, from the start of the word on
        best, through = np.full((size, room + 1), -np.inf), np.full(edge.shape, -np.inf)
        best[:, 0] = 0.0
        for j in range(1, room + 1):
            m = min(most, j)
            through[:, j, :m] = best[:, j - m:j][:, ::-1] + edge[:, j, :m]
            best[:, j] = through[:, j].max(axis=1)
        through = np.ascontiguousarray(through[:, :, ::-1])     # edges in the order of their starts
        every, ends = np.arange(size), np.array([len(w) for w in words])
        # the agendas, best entry first: cost of the whole way, position, score so far, last node of the way back
        cost, at, far = np.full((size, n), np.inf), np.zeros((size, n), "i8"), np.zeros((size, n))
        cost[:, 0], at[:, 0] = -best[every, ends], ends
        node = np.zeros((size, n), "i8")
        parents, ids, nodes = [np.zeros(1, "i8")], [np.zeros(1, "<i4")], 1
        found, of_found, way = np.zeros(size, "i8"), np.zeros((size, n)), np.zeros((size, n), "i8")
        while True:
            every = every[(cost[every, 0] < np.inf) & (found[every] < n)]
            if not len(every):
                break
            ended = at[every, 0] == 0
            a, b = every[ended], every[~ended]
            if len(a):
                k = found[a]
                of_found[a, k], way[a, k] = far[a, 0], node[a, 0]
                found[a] += 1
                for x in (cost, at, far, node):
                    x[a, :-1] = x[a, 1:]
                cost[a, -1] = np.inf
            if len(b):
                j, so_far, last, rows = at[b, 0], far[b, 0], node[b, 0], np.arange(len(b))
                costs = np.concatenate([cost[b, 1:], -(through[b, j] + so_far[:, None])], axis=1)
                rest = [x[b, 1:] for x in (at, far, node)]
                for t in range(n):
                    k = costs.argmin(axis=1)
                    value = costs[rows, k]
                    costs[rows, k] = np.inf
                    value[found[b] + t >= n] = np.inf
                    cost[b, t] = value
                    d = most - 1 - (k - (n - 1))                # an edge of d + 1 characters
                    r = np.flatnonzero((k >= n - 1) & (value < np.inf))
                    w, dr = b[r], d[r]
                    at[w, t], far[w, t] = j[r] - 1 - dr, edge[w, j[r], dr] + so_far[r]
                    node[w, t] = nodes + np.arange(len(r))
                    parents.append(last[r])
                    ids.append(piece[w, j[r], dr])
                    nodes += len(r)
                    if n > 1:
                        r = np.flatnonzero(k < n - 1)
                        for x, y in zip((at, far, node), rest, strict=True):
                            x[b[r], t] = y[r, k[r]]
        return _written(np.concatenate(parents), np.concatenate(ids), way, of_found, found)


def _written(parents, ids, way, scores, found) -> list[Found]:
    """The ways back, which begin at their words' starts, as packed ids."""
    import numpy as np
    size, n = way.shape
    step, flat, at = [], [], way.ravel()
    while at.any():
        step.append(ids[at])
        flat.append(at > 0)
        at = parents[at]
    if not step:
        return [[] for _ in range(size)]
    raw = np.stack(step, axis=1).astype("<i4").tobytes()
    width, length = 4 * len(step), np.stack(flat, axis=1).sum(axis=1).reshape(size, n).tolist()
    return [[(s[t], raw[(at := width * (w * n + t)):at + 4 * sizes[t]]) for t in range(k)]
            for w, (s, sizes, k) in enumerate(zip(scores.tolist(), length, found.tolist(), strict=True))]
