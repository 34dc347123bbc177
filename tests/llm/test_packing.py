"""Operator 11: every token once and in order, the library's ids, exact runs,
few sequences."""

import random
from collections import Counter
from itertools import pairwise
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from cases import LONG, ODD, clashing, documents
from pyspark.sql import functions as F

from helixframe.llm import linear_grouping as G

SPEC = G.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def library_ids(text):
    import tokenizers
    return tokenizers.Tokenizer.from_str(SPEC).encode(text or "", add_special_tokens=False).ids


def best_fit_sequences(lengths, capacity):
    """Best fit decreasing, piece by piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - n)
    return len(rooms)


def check_runs(counts, capacity, made):
    """Every piece in one place, no gap, nothing over capacity."""
    sequences, runs = made
    seen, at = Counter(), {}
    for length, lo, n, per, seq, offset in runs:
        for i in range(n):
            seen[length, lo + i] += 1
            at.setdefault(seq + i // per, []).append((offset + i % per * length, length))
    assert set(seen.values()) <= {1} and Counter(length for length, _ in seen) == Counter(counts)
    assert all(i < counts[length] for length, i in seen)
    assert set(at) == set(range(sequences))
    for places in at.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(places))
        assert sum(places[-1]) <= capacity


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_piece(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 257])
    lengths = [min(capacity, max(1, int(r.expovariate(1 / (capacity / r.choice([2, 3, 8])))))) for _ in range(600)]
    counts = dict(Counter(lengths))
    for groups in (1, 3, 8, 64):
        for small in (0, capacity // 8, capacity // 3, capacity // 2, capacity):
            check_runs(counts, capacity, G.plan(counts, capacity, groups, small))
    best = G.best_plan(counts, capacity)
    check_runs(counts, capacity, best)
    assert best[0] <= 1.03 * best_fit_sequences(lengths, capacity) + 1


def test_best_fit_on_runs_is_best_fit_piece_by_piece():
    r = random.Random(3)
    for _ in range(30):
        lengths = [r.randint(1, 40) for _ in range(r.randint(1, 300))]
        counts = dict(Counter(lengths))
        held = G.Open(50)
        runs = [run for n in sorted(counts, reverse=True) for run in held.best_fit(n, 0, counts[n])]
        check_runs(counts, 50, (held.next, runs))
        assert held.next == best_fit_sequences(lengths, 50)


def test_configurations_reach_the_programs_optimum():
    """Three sizes that fill a sequence exactly when mixed well."""
    mix = G.configurations([50, 30, 20], [100, 100, 100], 100)
    assert abs(sum(n for n, _ in mix) - 100) < 1e-6
    mix = G.configurations([6, 4, 3], [20, 30, 40], 10)
    # the prices 2/3, 1/3 and 1/3 show that no mix needs fewer
    assert abs(sum(n for n, _ in mix) - (20 * 2 + 30 + 40) / 3) < 1e-6
    assert all(6 * a + 4 * b + 3 * c <= 10 for _, (a, b, c) in mix)


def test_a_hot_length_stays_a_few_runs():
    counts = {700: 10_000_000, 648: 10_000_000, 2048: 5_000_000, 3: 7}
    sequences, runs = G.best_plan(counts, 2048)
    assert len(runs) < 60 and sequences < 1.001 * -(-sum(n * c for n, c in counts.items()) // 2048) + 5_000_000


def test_ids_are_the_librarys_for_every_character():
    ids = G.Ids(SPEC)
    assert ids.fast is not None
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x32000 or c % 1009 == 0)]
    texts = [f"a{c}b 1{c}2 !{c}! {c} {c}{c}" for c in chars]
    for at in range(0, len(texts), 20_000):
        part = texts[at:at + 20_000]
        assert [ids.of(t) for t in part] == [e.ids for e in ids.library.encode_batch(part, add_special_tokens=False)]


def test_odd_texts_have_the_librarys_ids():
    ids = G.Ids(SPEC)
    for t in ["", " ", "  \n\n x", "a<|endoftext|>b", "<|endoftext|>", "it's  we'LL\t\tx", "\x00\x7f", "漢字 \U0001f642 é", "x" * 3000]:
        assert ids.of(t) == library_ids(t)
    words = G.Ids(G.read_tokenizer(public_tokenizers.path("word_bpe_49k.json")))       # another kind goes through the library
    assert words.fast is None and words.of("Hello  there") == words.library.encode("Hello  there", add_special_tokens=False).ids


def test_pieces_and_sequences(spark):
    r = random.Random(2)
    rows = ODD + [(100 + i, " ".join(r.choice(["alpha", "beta", "gamma\n", "delta's"]) for _ in range(r.randint(0, 200))), "en", "a", 1)
                  for i in range(120)] + [(500, LONG, "en", "a", 1)] * 3 + [(None, None, None, None, None)]
    capacity = 64
    made = G.pieces(clashing(documents(spark, rows)).repartition(5), SPEC, capacity)
    placed = G.place(made, capacity).withColumn("ids_crc32", F.crc32("ids"))
    got = placed.collect()
    want = Counter()
    for doc, text, *_ in rows:
        ids, start = [*library_ids(text), 0], 0
        for k, end in enumerate(range(len(ids) % capacity or capacity, len(ids) + 1, capacity)):
            want[doc, k, start, end - start, crc32(np.array(ids[start:end], "<u4").tobytes())] += 1
            start = end
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == want
    full = {}
    for x in got:
        full.setdefault(x["sequence_id"], []).append((x["offset"], x["length"], bytes(x["ids"])))
    for parts in full.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in pairwise(parts))
        assert sum(n for _, n, _ in parts) <= capacity
    least = -(-sum(x["length"] for x in got) // capacity)
    assert len(full) <= 1.02 * least + 1
    whole = {x["sequence_id"]: x for x in G.sequences(placed).collect()}
    assert {s: b"".join(b for *_, b in parts) for s, parts in full.items()} == {s: bytes(x["ids"]) for s, x in whole.items()}
    assert all(x["n_tokens"] * 4 == len(x["ids"]) for x in whole.values())


def test_empty_table(spark):
    assert G.place(G.pieces(documents(spark).limit(0), SPEC)).count() == 0
