"""Operator 13 against scoring every document for every item."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from cases import ODD, clashing, documents

from helixframe.llm import max_sketch as M

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain(rows, items, k):
    docs = [(i, Counter(ts), len(ts)) for i, t, *_ in rows if (ts := plain_terms(t))]
    n, length = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, tf, _ in docs for t in tf)
    out = []
    for item, text in items:
        scores = []
        for doc, tf, size in docs:
            m = 25 + 75 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
                    for t in plain_terms(text) if t in tf)
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("width", "block"), [(M.WIDTH, M.BLOCK_TERMS), (3, 25), (64, 10)])
def test_ranks_equal_the_full_scoring(spark, width, block):
    r = random.Random(6)
    words = [f"w{i}" for i in range(80)] + ["Été", "漢字", "x_1", "don't", "THE"]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = ODD + [(100 + i, line(r.randint(0, 40)), "en", "a", 1) for i in range(250)]
    rows += [(400 + i, rows[20][1], "en", "a", 1) for i in range(15)] + rows[30:34] * 3 + [(None, rows[21][1], "en", "a", 1)] * 2
    items = [(i, line(r.randint(1, 15))) for i in range(20)] + [(50, None), (51, ""), (52, "unknown words only"), (53, "one line here"),
                                                             (53, "one line here"), (None, rows[20][1])]
    got = M.search(clashing(documents(spark, rows)).repartition(5), clashing(spark.createDataFrame(items, "item_id int, text string")),
                   k=10, width=width, block_terms=block)
    assert sorted([(x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in got.collect()], key=str) == plain(rows, items, 10)


def test_bounds_are_never_below_the_scores():
    r = random.Random(7)
    docs = [Counter(b"t%d" % r.randrange(50) for _ in range(r.randint(1, 60))) for _ in range(40)]
    n, length = len(docs), sum(sum(d.values()) for d in docs)
    df = Counter(t for d in docs for t in d)
    items = [(i, [b"t%d" % r.randrange(60) for _ in range(12)]) for i in range(10)]
    here = M.Searcher(items, n, length, dict(df), 5, 16, 75)
    held = [(d, 25 + 75 * sum(d.values()) * n // length) for d in docs]
    sketch = here.sketches(held)
    for d, (tf, m) in enumerate(held):
        assert all(sketch[c, d] == max((M.impact(f, m) for t, f in tf.items() if crc32(t) % 16 == c), default=0) for c in range(16))
    bounds = here.lookup @ sketch[here.used]
    for (_, q), bound in zip(here.items, bounds, strict=True):
        for (tf, m), b in zip(held, bound, strict=True):
            assert sum(w * M.impact(tf[t], m) for t, w in q.items() if t in tf) <= b


def test_few_documents_are_scored_exactly(monkeypatch):
    """The bounds spare nearly all exact scores."""
    r = random.Random(8)
    words = [b"w%d" % int(r.paretovariate(0.7)) for _ in range(60_000)]
    docs = [(i, b" ".join(words[r.randrange(59_900):][:40])) for i in range(2000)]
    ts = [M.terms(t) for _, t in docs]
    df = Counter(t for d in ts for t in set(d))
    items = [(i, ts[i * 17][:12]) for i in range(20)]
    here = M.Searcher(items, len(docs), sum(map(len, ts)), {t: df[t] for _, q in items for t in q}, 10, M.WIDTH, 75)
    scored = []
    for best in here.best:
        offer = best.offer
        monkeypatch.setattr(best, "offer", lambda s, d, offer=offer: (scored.append(d), offer(s, d)))
    for at in range(0, len(docs), 250):
        here.batch(docs[at:at + 250])
    assert len(scored) < 0.2 * len(docs) * len(items)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "one line")], "item_id int, text string")
    assert M.search(documents(spark).limit(0), items).count() == 0
    assert M.search(documents(spark), items.limit(0)).count() == 0
    assert M.search(documents(spark, [(1, None, "en", "a", 1)]), items).count() == 0
