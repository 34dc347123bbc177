"""Operator 11, best-fit packing by linear grouping.

``pieces`` cuts documents into pieces of at most ``capacity`` tokens and
``place`` gives each piece a sequence and an offset, in as few sequences as it
can:

1. Linear grouping: pieces above ``small`` tokens are ordered by length and
   cut into groups of equal cardinality; each length is rounded up to the
   largest of its group, so few sizes are left.
2. Configurations: how often each way to fill a sequence with these sizes is
   used comes from the cutting-stock linear program, solved by column
   generation (a knapsack finds the next configuration), rounded down.
3. Substitution: actual pieces take the places of the rounded ones, longest
   first, which leaves gaps.
4. Best fit: the pieces that the rounding left over and then the small ones,
   longest first, go into the fullest sequence that has room.

Pieces of one length are interchangeable and sequences with the same room
left are too, so the plan is made on the driver from the counts of each length
(at most ``capacity`` numbers, whatever the input) in runs: "pieces number
``lo`` to ``lo + n`` of this length go ``per`` to a sequence from sequence
``seq`` on".  Best fit on runs is best fit piece by piece.  Several numbers of
groups, and several lengths from which on a piece is large, are tried on these
counts and the plan with the fewest sequences stays.

Shape: one map writes the pieces, with their number among those of the same
length in the task; numbers across tasks are running totals of a counts table
(tasks x lengths); a piece then finds its run by a broadcast join with the
plan, whose size ``MAX_RUNS`` bounds.  Texts and ids are never shuffled, and a
length that a third of all pieces share is as cheap as any other.

Defined cases: a null or empty text is one piece holding the end id alone; a
repeated row is packed again; a null id stays null; an empty table gives no
rows; only ``id_col`` and ``text_col`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import arrow_schema, cut, docs_of, schema, worker_state

CAPACITY = 2048
GROUPS = (64, 256)
SMALL_SHARES = (4, 3, 2)
MAX_RUNS = 500_000
MAX_TOKENIZER_BYTES = 64 << 20
_SLICE = 256
Run = tuple[int, int, int, int, int, int]       # length, lo, n, per, seq, offset


# --- tokens ---------------------------------------------------------------

def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        text = f.read(MAX_TOKENIZER_BYTES + 1)
    if len(text) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path}: a tokenizer file above {MAX_TOKENIZER_BYTES} characters")
    return text


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write byte b as a printable character: itself
    where it is one in Latin-1, else the next free one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Ids:
    """The ids that the tokenizers library gives for the file ``spec``,
    without added special tokens.

    A byte-level file whose merges stand in id order, with the usual split
    pattern and no normaliser, is encoded by tiktoken's merger over the same
    vocabulary, several times as fast (the tests hold the two equal for every
    character); texts with an added token's own string and all other files go
    through the library itself.
    """

    def __init__(self, spec: str):
        import tokenizers
        self.library = tokenizers.Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.fast = self.apart = None
        made = json.loads(spec)
        model, pre = made["model"], made.get("pre_tokenizer") or {}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        vocab, added = model.get("vocab", {}), [t["content"] for t in made.get("added_tokens", [])]
        in_order = [vocab.get(a + b) for a, b in pairs] == list(range(256, 256 + len(pairs)))
        if (model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                and not pre.get("add_prefix_space") and not made.get("normalizer") and in_order
                and not model.get("dropout") and not model.get("ignore_merges")):
            import re

            import public_tokenizers
            import tiktoken
            byte = byte_of_char()
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in added}
            self.fast = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={}).encode_ordinary
            self.apart = re.compile("|".join(map(re.escape, added)) or "(?!)").search

    def of(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.fast is None or self.apart(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast(text)



def pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Every document's ids with ``end_id`` behind them, cut from the back
    into pieces of ``capacity`` (the first may be shorter): ``doc_id, piece,
    start, length, ids`` (little-endian unsigned 32-bit) and, for ``place``,
    ``task`` and ``slot`` (the piece's number among the task's of its length)."""
    docs = docs_of(df, id_col, text_col)
    out = schema(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, "
                 "ids binary, task bigint, slot bigint")
    key = f"ids_{hash(tokenizer)}"

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        enc, form = worker_state(key, lambda: Ids(tokenizer)), arrow_schema(out)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, "i8")
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part, rows = batch.slice(at, _SLICE), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.array([*enc.of(text), end_id], "<u4")
                    ends = range(len(ids) % capacity or capacity, len(ids) + 1, capacity)
                    for k, end in enumerate(ends):
                        start = 0 if k == 0 else end - capacity
                        rows.append((doc, k, start, end - start, ids[start:end].tobytes(), task, int(seen[end - start])))
                        seen[end - start] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), form, strict=True)], schema=form)

    return docs.mapInArrow(run, out)


# --- the plan, from the counts of each length ------------------------------

def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[float, list[int]]]:
    """The linear program's optimal mix of configurations: (how many
    sequences, how many pieces of each size).  ``sizes`` fall."""
    import numpy as np
    k = len(sizes)
    basis, need = np.diag([float(capacity // s) for s in sizes]), np.array(demand, "f8")
    for _ in range(60 * k):                             # any basis is a valid mix, the last the best
        price = np.linalg.solve(basis.T, np.ones(k))
        value, column = fullest(sizes, price, capacity)
        if value <= 1 + 1e-7:
            break
        along, held = np.linalg.solve(basis, column), np.linalg.solve(basis, need)
        ratio = np.full(k, np.inf)
        np.divide(np.maximum(held, 0), along, out=ratio, where=along > 1e-9)
        basis[:, int(np.argmin(ratio))] = column
    held = np.linalg.solve(basis, need)
    return [(float(x), basis[:, j].round().astype(int).tolist()) for j, x in enumerate(held) if x > 0]


def fullest(sizes: list[int], price, capacity: int):
    """The configuration of most worth at these prices: a knapsack over room."""
    import numpy as np
    worth, took = np.zeros(capacity + 1), []
    for s, p in zip(sizes, price, strict=True):
        best, n = worth.copy(), np.zeros(capacity + 1, "i2")
        if p > 1e-12:
            for t in range(1, capacity // s + 1):
                more = worth[:-t * s] + t * p
                better = more > best[t * s:] + 1e-12
                best[t * s:][better] = more[better]
                n[t * s:][better] = t
        took.append(n)
        worth = best
    room, column = capacity, np.zeros(len(sizes))
    for i in range(len(sizes) - 1, -1, -1):
        column[i] = took[i][room]
        room -= int(took[i][room]) * sizes[i]
    return worth[-1], column


class Open:
    """Runs of sequences by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.of, self.next = capacity, [], {}, 0

    def put(self, room: int, seq: int, n: int) -> None:
        if room and n:
            if room not in self.of:
                insort(self.rooms, room)
                self.of[room] = []
            self.of[room].append((seq, n))

    def new(self, n: int) -> int:
        self.next += n
        return self.next - n

    def tightest(self, length: int) -> tuple[int, int, int] | None:
        """A run with the least room that holds ``length``, taken out."""
        at = bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        seq, n = self.of[room].pop()
        if not self.of[room]:
            del self.of[room], self.rooms[at]
        return room, seq, n

    def best_fit(self, length: int, lo: int, n: int) -> Iterator[Run]:
        """``n`` pieces of one length into the fullest sequences with room.  A
        sequence that took one is fuller than before, so it takes the next
        ones too while it has room."""
        while n:
            got = self.tightest(length)
            if got is None:
                each = self.capacity // length
                got = self.capacity, self.new(m := max(1, n // each)), m
            room, seq, m = got
            per = min(room // length, n)
            used = min(m, n // per)
            yield length, lo, used * per, per, seq, self.capacity - room
            self.put(room - per * length, seq, used)
            self.put(room, seq + used, m - used)
            lo, n = lo + used * per, n - used * per


def plan(counts: dict[int, int], capacity: int, groups: int, small: int) -> tuple[int, list[Run]]:
    """(sequences, runs) by linear grouping into ``groups`` groups; lengths up
    to ``small`` only fill gaps."""
    held, runs = Open(capacity), []
    large = sorted((n for n in counts if n > small), reverse=True)
    each = max(1, -(-sum(counts[n] for n in large) // groups))
    # groups of equal cardinality, longest first; those that round up to the same size are one
    stock: dict[int, list[list[int]]] = {}              # rounded size -> [length, lo, n], longest first
    size, free = 0, 0
    for length in large:
        lo, n = 0, counts[length]
        while n:
            if not free:
                size, free = length, each
            take = min(n, free)
            held_back = stock.setdefault(size, [])
            if held_back and held_back[-1][0] == length:
                held_back[-1][2] += take
            else:
                held_back.append([length, lo, take])
            lo, n, free = lo + take, n - take, free - take
    sizes = list(stock)
    if sizes:
        for used, config in configurations(sizes, [sum(r[2] for r in stock[s]) for s in sizes], capacity):
            n = int(used + 1e-6)
            for s, c in zip(sizes, config, strict=True):
                if c:
                    n = min(n, sum(r[2] for r in stock[s]) // c)
            if n:
                first = held.new(n)
                rooms = [(first, n, capacity)]
                for s in [s for s, c in zip(sizes, config, strict=True) for _ in range(c)]:
                    rooms = list(substituted(rooms, stock[s], capacity, runs))
                for seq, m, room in rooms:
                    held.put(room, seq, m)
    left = sorted(((length, lo, n) for s in sizes for length, lo, n in stock[s] if n), reverse=True)
    for length, lo, n in [*left, *((m, 0, counts[m]) for m in sorted(counts, reverse=True) if m <= small)]:
        runs += held.best_fit(length, lo, n)
    return held.next, runs


def substituted(rooms: list[tuple], stock: list[list[int]], capacity: int, runs: list[Run]) -> Iterator[tuple]:
    """One actual piece of a group into each of the sequences in ``rooms``
    (first, how many, room), longest pieces first."""
    for seq, m, room in rooms:
        while m:
            length, lo, n = top = stock[0]
            take = min(m, n)
            runs.append((length, lo, take, 1, seq, capacity - room))
            yield seq, take, room - length
            top[1:] = lo + take, n - take
            if not top[2]:
                stock.pop(0)
            seq, m = seq + take, m - take


def best_plan(counts: dict[int, int], capacity: int, groups=GROUPS) -> tuple[int, list[Run]]:
    """The plan with the fewest sequences over the numbers of groups and the
    shares of ``capacity`` above which a piece is large; a plan that needs no
    more sequences than its tokens fill ends the search."""
    least, best = -(-sum(n * c for n, c in counts.items()) // capacity), None
    for g in groups:
        for share in SMALL_SHARES:
            made = plan(counts, capacity, g, capacity // share)
            if best is None or made[0] < best[0]:
                best = made
            if best[0] == least:
                return best
    return best


# --- placing ----------------------------------------------------------------

def place(made: DataFrame, capacity: int = CAPACITY, groups=GROUPS) -> DataFrame:
    """The rows of ``pieces`` (``ids`` may be left out or digested first) with
    ``sequence_id`` and ``offset`` instead of ``task`` and ``slot``."""
    spark = made.sparkSession
    made = cut(made, "pieces")
    counts = cut(made.groupBy("task", "length").count(), "piece-counts")
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs = best_plan(by_length, capacity, groups)[1] if by_length else []
    if len(runs) > MAX_RUNS:
        raise ValueError(f"{len(runs)} runs in the packing plan; at most {MAX_RUNS} are sent to the tasks")
    runs = spark.createDataFrame(runs, "__length long, __lo long, __n long, __per long, __seq long, __offset long")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("task").alias("__task"), F.col("length").alias("__of"),
                          F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    number = F.col("__first") + F.col("slot") - F.col("__lo")
    return (made.join(first, (made["task"] == first["__task"]) & (made["length"] == first["__of"]))
            .join(F.broadcast(runs), (F.col("length") == F.col("__length")) & (number >= 0) & (number < F.col("__n")))
            .select(*[c for c in made.columns if c not in ("task", "slot")],
                    (F.col("__seq") + F.floor(number / F.col("__per"))).alias("sequence_id"),
                    (F.col("__offset") + number % F.col("__per") * F.col("length")).alias("offset")))


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from placed rows that still hold
    ``ids``: ``sequence_id, n_tokens, ids`` and ``pieces`` (document, piece,
    offset and length of each, in order).  A group is one sequence, which
    ``capacity`` bounds."""
    one = F.struct("offset", "length", "doc_id", "piece", "ids")
    got = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(one)).alias("p"))
    return got.select("sequence_id", F.expr("aggregate(p, 0L, (n, x) -> n + x.length)").alias("n_tokens"),
                      F.expr("aggregate(p, X'', (b, x) -> concat(b, x.ids))").alias("ids"),
                      F.expr("transform(p, x -> struct(x.doc_id, x.piece, x.offset, x.length))").alias("pieces"))
