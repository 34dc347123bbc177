"""Operator 6, toxicity by a bidirectional gated recurrent network.

Each word's input is a word vector (by the word's hash) plus the mean of its
character-gram vectors, so forms that were never seen share what their stems
taught.  A gated recurrent network reads the words in both directions, attention
pools the states of a window of words, and a logistic unit scores the window.
A document is scored by its highest window, and a window starts at every word
that has a whole window before the text ends.

Overlapping windows share their words' states: the text is cut into blocks as
long as a window, each read with ``CONTEXT`` words before it (forwards) and
after it (backwards), so a word has one state.  Pooling is a quotient of two
sums over the window's words, and the sums for all starts are made by doubling
(of 1, 2, 4 ... words).  Training reads windows with the same context.

Training is numpy on the driver over a bounded sample of labelled rows:
``per_class`` documents of label 0 and 1, those with the smallest hash, of
``min_words`` to ``max_words`` words.  A label holds for a document, so each
epoch trains on the highest window of each document (random ones at first) and
on random windows of clean documents.  At last a line from the highest window
to the label is fitted on a quarter of the sample that no epoch saw, each label
weighing as it does among all labelled rows; it places 0.5.

Scoring is one map over the documents with the weights (fixed size) broadcast.
The input side of all gates is worked out once for each distinct word and kept
in a bounded table; a step of the network is then one small matrix product for
thousands of blocks.  A very long text goes through in runs that overlap by a
window, so its states are bounded too.

Defined cases: null and empty texts and texts without words have the score of
an empty state; rows whose label is missing are scored like others; a label
table without one of the two labels gives every document the smoothed share of
label 1; a row with a null id is scored and not held out; repeated rows give
repeated rows, repeated labels the highest; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import arrow_schema, cut, docs_of, schema

WORDS, GRAMS = 1 << 14, 1 << 13        # rows of the word and character-gram tables
DIM, HIDDEN, ATTEND = 8, 8, 8
WINDOW, CONTEXT = 32, 16               # words of a window (a power of two), and read on each side of a block
SPAN = CONTEXT + WINDOW + CONTEXT
PER_CLASS, MIN_WORDS, MAX_WORDS = (2400, 800), 32, 2000     # documents of label 0 and 1, their words
EPOCHS, BATCH, RATE = 8, 64, 0.01
TABLE_WORDS = 200_000
_STEP = 2048                            # blocks at a time
_word = re.compile(r"\w+").findall


def words_of(text: str | None) -> list[str]:
    return _word((text or "").lower())


def word_inputs(words: Sequence[str]):
    """(word rows, gram rows, where each word's grams begin)."""
    import numpy as np
    rows = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) & (WORDS - 1) for w in words], "i8")
    sizes = np.array([len(w) for w in words], "i8")                 # grams of "<word>"
    code = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    mixed = (code[:-2] * np.uint64(0x9E3779B1) + code[1:-1] * np.uint64(0x85EBCA77) + code[2:] * np.uint64(0xC2B2AE3D))
    grams = ((mixed ^ mixed >> np.uint64(15)) * np.uint64(0x27D4EB2F) >> np.uint64(20) & np.uint64(GRAMS - 1)).astype("i8")
    first = np.cumsum(sizes + 2) - sizes - 2                        # of the grams that begin within each word
    inside = np.ones(len(code), bool)
    ends = first + sizes + 1
    inside[ends] = inside[ends - 1] = False
    return rows, grams[inside[:len(grams)]], np.cumsum(sizes) - sizes


def sigmoid(x):
    import numpy as np
    return 0.5 * np.tanh(0.5 * x) + 0.5


def steps_of(direction: str) -> range:
    """The places of a span that one direction reads, in its order."""
    return range(CONTEXT + WINDOW) if direction == "f" else range(SPAN - 1, CONTEXT - 1, -1)


def blocks(rows, n: int, before: int = 0):
    """Blocks (x ``SPAN``) over ``n`` words, 0 where there is none.  ``rows``
    begins ``before`` words (``CONTEXT`` at most) ahead of them and may go on
    behind them if they fill their blocks."""
    import numpy as np
    padded = np.zeros(2 * CONTEXT + -(-n // WINDOW) * WINDOW, "i4")
    padded[CONTEXT - before:][:len(rows)] = rows
    return np.lib.stride_tricks.sliding_window_view(padded, SPAN)[::WINDOW]


def window_means(share, value):
    """For each start the mean of ``value`` over ``WINDOW`` places, weighted by
    ``share``; -inf where all of it is nought."""
    import numpy as np
    total, part = share.astype("f4"), (share * value).astype("f4")
    width = 1
    while width < WINDOW:
        for sums in (total, part):
            sums[:-width] += sums[width:]
        width *= 2
    return np.divide(part, total, out=np.full(len(total), -np.inf, "f4"), where=total > 0)


@dataclass
class Network:
    """Weights by name, and the line (slope, offset) from the highest window
    to the label."""

    w: dict = field(default_factory=dict)
    slope: float = 1.0
    offset: float = 0.0

    @staticmethod
    def new(seed: int = 7) -> Network:
        import numpy as np
        r = np.random.default_rng(seed)
        some = lambda *shape: r.normal(0, 0.3, shape).astype("f4")
        w = {"word": 0.3 * some(WORDS, DIM), "gram": some(GRAMS, DIM), "att": some(2 * HIDDEN, ATTEND),
             "att_b": np.zeros(ATTEND, "f4"), "att_v": some(ATTEND), "out": some(2 * HIDDEN), "out_b": np.zeros(1, "f4")}
        for d in "fb":
            w |= {f"in_{d}": some(DIM, 3 * HIDDEN), f"rec_{d}": some(HIDDEN, 3 * HIDDEN), f"b_{d}": np.zeros(3 * HIDDEN, "f4")}
        return Network(w)

    def vectors(self, words: Sequence[str]):
        """The input vector of each word."""
        import numpy as np
        rows, grams, first = word_inputs(words)
        sizes = np.diff(np.append(first, len(grams)))[:, None]
        return self.w["word"][rows] + np.add.reduceat(self.w["gram"][grams], first, axis=0) / sizes

    def gates(self, x):
        """What the inputs add to the gates, forward and backward."""
        return [x @ self.w[f"in_{d}"] + self.w[f"b_{d}"] for d in "fb"]

    def run(self, gates: Sequence, rows):
        """(attention, value) of the words of blocks, both blocks x ``WINDOW``;
        ``rows`` (blocks x ``SPAN``) picks each word's row of ``gates``.  Row 0
        of the gates is nought: no word, which leaves an empty state empty and
        gets no attention.  The same steps as ``traced``, in place."""
        import numpy as np
        n, h2 = rows.shape[0], 2 * HIDDEN
        states = np.empty((WINDOW, n, h2), "f4")
        rows = np.ascontiguousarray(rows.T)
        rz, new = np.empty((n, h2), "f4"), np.empty((n, HIDDEN), "f4")
        r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
        for d, own in zip("fb", gates, strict=True):
            u, side = self.w[f"rec_{d}"], slice(0, HIDDEN) if d == "f" else slice(HIDDEN, h2)
            u_rz, u_new = np.ascontiguousarray(u[:, :h2]), np.ascontiguousarray(u[:, h2:])
            h = np.zeros((n, HIDDEN), "f4")
            for t in steps_of(d):
                x = own.take(rows[t], axis=0)
                np.matmul(h, u_rz, out=rz)
                rz += x[:, :h2]
                rz *= 0.5
                np.tanh(rz, out=rz)
                rz *= 0.5
                rz += 0.5
                np.matmul(h, u_new, out=new)
                new *= r
                new += x[:, h2:]
                np.tanh(new, out=new)
                h -= new
                h *= z
                h += new
                if 0 <= t - CONTEXT < WINDOW:
                    states[t - CONTEXT, :, side] = h
        flat = states.reshape(-1, h2)
        e = np.tanh((flat @ self.w["att"]) + self.w["att_b"]) @ self.w["att_v"]
        e = np.exp(e - np.abs(self.w["att_v"]).sum()).reshape(WINDOW, n)      # |e| is at most that sum
        e *= rows[CONTEXT:CONTEXT + WINDOW] > 0
        return e.T, (flat @ self.w["out"]).reshape(WINDOW, n).T

    def highest(self, gates: Sequence, rows, lengths: Sequence[int]):
        """The highest window's score of each text, and where it starts.
        ``rows`` holds the blocks of texts of ``lengths`` words (1 at least),
        one text after the other."""
        import numpy as np
        done = [self.run(gates, rows[at:at + _STEP]) for at in range(0, len(rows), _STEP)]
        share, value = (np.concatenate([d[i] for d in done]).ravel() for i in (0, 1))
        score = window_means(share, value)
        first = np.cumsum([0, *[-(-n // WINDOW) * WINDOW for n in lengths]])
        at = [int(a + score[a:a + max(n - WINDOW, 0) + 1].argmax()) for a, n in zip(first, lengths, strict=False)]
        return score[at] + self.w["out_b"][0], np.array(at) - first[:-1]

    def traced(self, gates: Sequence, rows):
        """Scores of windows (``rows``: windows x ``SPAN``), and what the
        gradient needs."""
        import numpy as np
        n, h2 = rows.shape[0], 2 * HIDDEN
        states, steps = np.empty((WINDOW, n, h2), "f4"), {}
        for d, own in zip("fb", gates, strict=True):
            u, h, side = self.w[f"rec_{d}"], np.zeros((n, HIDDEN), "f4"), slice(0, HIDDEN) if d == "f" else slice(HIDDEN, h2)
            for t in steps_of(d):
                a, hu = own[rows[:, t]], h @ u
                rz = sigmoid(a[:, :h2] + hu[:, :h2])
                r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
                new = np.tanh(a[:, h2:] + r * hu[:, h2:])
                steps[d, t] = (h, r, z, new, hu[:, h2:])
                h = new + z * (h - new)
                if 0 <= t - CONTEXT < WINDOW:
                    states[t - CONTEXT, :, side] = h
        k = np.tanh(states @ self.w["att"] + self.w["att_b"])
        e = k @ self.w["att_v"]
        e = np.exp(e - e.max(axis=0))
        share = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", share, states)
        return pooled @ self.w["out"] + self.w["out_b"][0], (states, steps, k, share, pooled)

    def empty_logit(self) -> float:
        return float(self.w["out_b"][0])

    def gradient(self, x, real, label, weight):
        """Gradient of the weighted log loss over windows (windows x ``SPAN`` x
        DIM inputs, and which of them are words; a window's own all are): by
        weight name, and of the inputs."""
        import numpy as np
        n = len(x)
        flat, word = x.reshape(-1, DIM), real.reshape(-1, 1)
        rows = np.arange(n * SPAN).reshape(n, SPAN)
        logit, (states, steps, k, share, pooled) = self.traced([g * word for g in self.gates(flat)], rows)
        g: dict = {}
        d_logit = (sigmoid(logit) - label) * weight / n
        g["out"], g["out_b"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = np.outer(d_logit, self.w["out"])
        d_states = share[:, :, None] * d_pooled
        d_share = np.einsum("tnh,nh->tn", states, d_pooled)
        d_e = share * (d_share - (share * d_share).sum(axis=0))
        g["att_v"] = np.einsum("tn,tna->a", d_e, k)
        d_k = d_e[:, :, None] * self.w["att_v"] * (1 - k * k)
        g["att"] = np.einsum("tnh,tna->ha", states, d_k)
        g["att_b"] = d_k.sum(axis=(0, 1))
        d_states += d_k @ self.w["att"].T
        d_x = np.zeros((n, SPAN, DIM), "f4")
        for d in "fb":
            u, side = self.w[f"rec_{d}"], slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
            g_in, g_rec, g_b = (np.zeros_like(self.w[f"{name}_{d}"]) for name in ("in", "rec", "b"))
            carry = np.zeros((n, HIDDEN), "f4")
            for t in reversed(steps_of(d)):
                h, r, z, new, hu = steps[d, t]
                dh = carry + d_states[t - CONTEXT][:, side] if 0 <= t - CONTEXT < WINDOW else carry
                d_new = dh * (1 - z) * (1 - new * new)
                d_z = dh * (h - new) * z * (1 - z)
                d_r = d_new * hu * r * (1 - r)
                d_a = np.hstack([d_r, d_z, d_new]) * real[:, t, None]      # of the input side
                d_hu = np.hstack([d_r, d_z, d_new * r])             # of the state side
                carry = dh * z + d_hu @ u.T
                g_in += x[:, t].T @ d_a
                g_rec += h.T @ d_hu
                g_b += d_a.sum(axis=0)
                d_x[:, t] += d_a @ self.w[f"in_{d}"].T
            g |= {f"in_{d}": g_in, f"rec_{d}": g_rec, f"b_{d}": g_b}
        return g, d_x


def with_none(gates: Sequence) -> list:
    """Gate tables with a first row of nought, which stands for no word."""
    import numpy as np
    return [np.vstack([np.zeros((1, g.shape[1]), g.dtype), g]) for g in gates]


class Adam:
    def __init__(self, w: dict):
        self.w, self.t, self.m, self.v = w, 0, {}, {}

    def step(self, grads: dict, rate: float) -> None:
        import numpy as np
        self.t += 1
        for k, g in grads.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            v = self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            self.w[k] -= (rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.999 ** self.t)) + 1e-6)).astype("f4")


def train(texts: Sequence[str], labels: Sequence[int], epochs: int = EPOCHS, share: float = 0.5,
          seed: int = 7) -> Network:
    """A network from documents of ``WINDOW`` words or more and their labels;
    ``share`` of all labelled documents have label 1."""
    import numpy as np
    net, r = Network.new(seed), np.random.default_rng(seed)
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index) + 1) for w in words_of(t)]) for t in texts]
    label = np.array(labels, "f4")
    vocabulary = list(index)
    rows, grams, first = word_inputs(vocabulary)
    sizes = np.diff(np.append(first, len(grams)))
    lengths = np.array([len(d) for d in docs])
    in_blocks = np.concatenate([blocks(d, len(d)) for d in docs])
    none = np.zeros(CONTEXT, "i8")
    laid = np.concatenate([np.concatenate([none, d, none]) for d in docs])      # a window's span is a run of it
    begin = np.cumsum(lengths + 2 * CONTEXT) - lengths - 2 * CONTEXT
    aside = np.arange(len(docs)) % 4 == 3                           # only for the line at the end
    aside &= (label[aside].min() != label[aside].max()) if aside.any() else False
    learn = np.flatnonzero(~aside)
    adam, clean = Adam(net.w), np.flatnonzero(~aside & (label == 0))

    def highest():
        """Score of each document, and where its highest window starts."""
        return net.highest(with_none(net.gates(net.vectors(vocabulary))), in_blocks, lengths)

    for epoch in range(epochs):
        at_random = begin + (r.random(len(docs)) * (lengths - WINDOW + 1)).astype(int)
        pick = at_random if epoch < 2 else begin + highest()[1]
        pick = np.concatenate([pick[learn], at_random[clean]])
        truth = np.concatenate([label[learn], label[clean]])
        weight = np.where(truth > 0, 3.0, 1.0).astype("f4")
        order = r.permutation(len(pick))
        for at in range(0, len(order), BATCH):
            some = order[at:at + BATCH]
            spans = laid[pick[some][:, None] + np.arange(SPAN)]
            used, inverse = np.unique(np.append(spans, 0), return_inverse=True)
            inverse, used = inverse.ravel()[:-1].reshape(spans.shape), used[1:] - 1       # row 0: no word
            counts = sizes[used]
            own = np.concatenate([np.arange(first[u], first[u] + sizes[u]) for u in used])
            x = np.zeros((len(used) + 1, DIM), "f4")
            x[1:] = net.w["word"][rows[used]] + np.add.reduceat(
                net.w["gram"][grams[own]], np.cumsum(counts) - counts, axis=0) / counts[:, None]
            g, d_x = net.gradient(x[inverse], spans > 0, truth[some], weight[some])
            d_word = np.zeros((len(used) + 1, DIM), "f4")
            np.add.at(d_word, inverse.ravel(), d_x.reshape(-1, DIM))
            d_word = d_word[1:]
            g["word"], g["gram"] = np.zeros_like(net.w["word"]), np.zeros_like(net.w["gram"])
            np.add.at(g["word"], rows[used], d_word)
            np.add.at(g["gram"], grams[own], np.repeat(d_word / counts[:, None], counts, axis=0))
            adam.step(g, RATE * (1 - epoch / epochs))
    score = highest()[0].astype("f8")
    if aside.any():
        score, label = score[aside], label[aside]
    a, b = 1.0, 0.0
    for _ in range(2000):                           # the line to the label, each label with its share
        p = sigmoid(a * score + b)
        e = (p - label) * np.where(label > 0, share / max(label.sum(), 1), (1 - share) / max((1 - label).sum(), 1))
        a, b = max(0.05, a - 0.5 * float((e * score).sum())), b - 0.5 * float(e.sum())
    net.slope, net.offset = a, b
    return net


class Scorer:
    """Scores texts; keeps the gate inputs of the words it has met."""

    def __init__(self, net: Network):
        import numpy as np
        self.net = net
        self.index: dict[str, int] = {}
        self.table = [np.zeros((TABLE_WORDS + 1, 3 * HIDDEN), "f4") for _ in "fb"]

    def rows(self, words: list[str]):
        """Rows of the gate table for up to ``TABLE_WORDS`` words."""
        import numpy as np
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if len(self.index) + len(new) > TABLE_WORDS:
            self.index.clear()
            new = list(dict.fromkeys(words))
        if new:
            at = len(self.index) + 1
            for table, gates in zip(self.table, self.net.gates(self.net.vectors(new)), strict=True):
                table[at:at + len(new)] = gates
            self.index.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(self.index.__getitem__, words), "i4", len(words))

    def logits(self, texts: Sequence[str | None]) -> list[float]:
        """The highest window of each text."""
        import numpy as np
        best = np.full(len(texts), -np.inf)
        held, owner, lengths, waiting = [], [], [], 0
        run = max(2 * WINDOW, TABLE_WORDS // 2 // WINDOW * WINDOW)

        def flush():
            nonlocal held, owner, lengths, waiting
            if held:
                np.maximum.at(best, owner, self.net.highest(self.table, np.concatenate(held), lengths)[0])
                held, owner, lengths, waiting = [], [], [], 0

        for k, text in enumerate(texts):
            words = words_of(text)
            if not words:
                best[k] = self.net.empty_logit()
            # a very long text in runs of whole blocks that overlap by a window
            for at in range(0, max(len(words) - WINDOW, min(len(words), 1)), run - WINDOW):
                part = words[max(0, at - CONTEXT):at + run + CONTEXT]
                if len(self.index) + len(part) > TABLE_WORDS:
                    flush()                             # the table may be dealt anew: nothing may wait for it
                n = min(run, len(words) - at)
                held.append(blocks(self.rows(part), n, min(at, CONTEXT)))
                owner.append(k)
                lengths.append(n)
                waiting += len(held[-1])
                if waiting >= _STEP:
                    flush()
        flush()
        return best.tolist()

    def scores(self, texts: Sequence[str | None]) -> list[float]:
        import numpy as np
        return sigmoid(self.net.slope * np.array(self.logits(texts), "f8") + self.net.offset).tolist()


def held_out(id_col: str, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % folds == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int], min_words: int, max_words: int,
           label_col: str) -> tuple[list[tuple[str, int]], list[int]]:
    """At most ``per_class[label]`` (text, label) of each label, those with the
    smallest hash of the id among documents that are not held out; and how
    many rows there are of each label."""
    known = (labels.select(F.col("doc_id").alias("l_id"), F.col(label_col).cast("int").alias("label"))
             .filter("l_id IS NOT NULL AND label IN (0, 1)").groupBy("l_id").agg(F.max("label").alias("label"))
             .filter(~held_out("l_id")))
    n_words = F.size(F.split(F.trim("text"), r"\s+"))
    fits = n_words.between(min_words, max_words)
    known = cut(docs.filter(fits).select("doc_id").distinct().join(known, F.col("doc_id") == F.col("l_id"))
                .select("doc_id", "label"), "toxic-labels")
    totals = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    # ids first, so only the texts of a bounded number of rows come to the driver
    label_of = {r[0]: label for label in (0, 1) for r in known.filter(F.col("label") == label).orderBy(
        F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(per_class[label]).collect()}
    texts = (docs.filter(F.col("doc_id").isin(list(label_of))).filter(fits)
             .groupBy("doc_id").agg(F.min("text").alias("text")).collect())
    rows = sorted((label_of[i], i, t) for i, t in texts)
    return [(t, label) for label, _, t in rows], [totals.get(0, 0), totals.get(1, 0)]


def toxicity(df: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
             per_class: tuple[int, int] = PER_CLASS, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS,
             epochs: int = EPOCHS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``df``."""
    docs = docs_of(df, id_col, text_col)
    rows, totals = sample(docs, labels, per_class, min_words, max_words, label_col)
    rows = [(t, y) for t, y in rows if len(words_of(t)) >= WINDOW]
    share = (totals[1] + 1) / (sum(totals) + 2)
    both = len({y for _, y in rows}) == 2
    net = train([t for t, _ in rows], [y for _, y in rows], epochs, share) if both else None
    # plain data: a broadcast class would need the package on the workers
    shared = df.sparkSession.sparkContext.broadcast((net.w, net.slope, net.offset) if net else None)
    out = schema(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")

    def run(batches) -> Iterator:
        import pyarrow as pa
        scorer = Scorer(Network(*shared.value)) if shared.value is not None else None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(scorer.scores(texts) if scorer else [share] * len(texts), pa.float64())],
                    schema=arrow_schema(out))

    scored = docs.mapInArrow(run, out)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
