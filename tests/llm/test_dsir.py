"""Operator 12 against a plain version."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from cases import LONG, ODD, clashing, documents

from helixframe.llm import overlap_dsir as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def grams(text, orders=2):
    words = WORD.findall((text or "").translate(FOLD))
    return len(words), [" ".join(words[i:i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)]


def plain(rows, target, buckets, percent, min_words, seed=7, orders=2):
    def counts(texts):
        return Counter(crc32(g.encode()) % buckets for t in texts for g in grams(t, orders)[1])
    s, t = counts([r[1] for r in rows]), counts(target)
    big, small = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * float(big) / ((s[b] + 1) * float(small)))) for b in range(buckets)}
    out = []
    for doc, text, *_ in rows:
        n, found = grams(text, orders)
        weight = sum(gain[crc32(g.encode()) % buckets] for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1], r[2], r[3]))
    k = percent * len(able) // 100
    drawn = Counter((*r, i) for i, r in enumerate(able[:k], 1))
    return drawn, Counter((*r, None) for r in [*able[k:], *(r for r in out if r[1] < min_words)])


@pytest.mark.parametrize(("buckets", "percent", "orders"), [(10_000, 25, 2), (7, 60, 1), (100_000, 100, 3)])
def test_weights_scores_and_draw(spark, buckets, percent, orders):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "漢字", "A-b", "x_y", "don't"]
    rows = [(100 + i, " ".join(r.choice(words) for _ in range(r.randint(0, 60))), "en", "a", 1) for i in range(300)]
    rows = ODD + rows + rows[:40] * 2 + [(900, rows[0][1], "en", "a", 1)] * 5 + [(None, rows[1][1], "en", "a", 1)] * 2
    target = [" ".join(r.choice(words[:20]) for _ in range(30)) for _ in range(10)] + [None, ""]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    got = D.resample(clashing(documents(spark, rows)).repartition(6), items, orders, buckets, percent).collect()
    drawn, rest = plain(rows, target, buckets, percent, 20, orders=orders)
    assert Counter(tuple(x) for x in got if x["rank"] is not None) == drawn
    assert Counter(tuple(x) for x in got if x["rank"] is None) == rest


def test_scan_finds_every_run_of_words():
    scans = D.scanners(3)
    for text in ["", "  ", "one", "a b", "A,b;;c\n\nd", "é è  z", "a a a a", LONG[:2000], "x" * 500]:
        found = [m[0].decode() for scan in scans for m in scan(D.collapsed(text.encode()))]
        assert found == grams(text, 3)[1]


def test_spans_lie_in_the_collapsed_text():
    s = D.collapsed("Böse; (Katze)  läuft".encode())
    assert [s[a:b].decode() for a, b in (m.span() for m in D.scanners(2)[1](s))] == ["böse katze", "katze läuft"]


def test_empty_tables(spark):
    none = documents(spark).limit(0)
    items = spark.createDataFrame([(1, "some text here")], "item_id int, text string")
    assert D.resample(none, items).count() == 0
    got = D.resample(documents(spark), items.limit(0), min_words=1).collect()
    assert len(got) == len(ODD) and sum(x["rank"] is not None for x in got) == 25 * sum(
        grams(t)[0] >= 1 for _, t, *_ in ODD) // 100


def test_one_id_may_hold_many_rows(spark):
    rows = [(1, "the same text again and again " * 10, "en", "a", 1)] * 300 + [
        (i, f"w{i} " * 30, "en", "a", 1) for i in range(2, 200)]
    got = D.resample(documents(spark, rows).repartition(5), spark.createDataFrame([(1, "x")], "i int, text string"), percent=80)
    ranks = sorted(x["rank"] for x in got.collect() if x["rank"] is not None)
    assert ranks == list(range(1, 80 * len(rows) // 100 + 1))
