"""Operator 2 against a plain greedy tiling."""

import random
import time

from cases import LONG, ODD, clashing, documents

from helixframe.llm import tiling_decontam as T


def plain_covered(pattern, text, least):
    """Tokens in tiles, marking the longest common run again and again."""
    free_p, free_t, total = [True] * len(pattern), [x > 0 for x in text], 0
    while True:
        best, at = 0, None
        for i in range(len(pattern)):
            for j in range(len(text)):
                k = 0
                while (i + k < len(pattern) and j + k < len(text) and pattern[i + k] == text[j + k]
                       and free_p[i + k] and free_t[j + k]):
                    k += 1
                if k > best:
                    best, at = k, (i, j)
        if best < least:
            return total
        i, j = at
        total += best
        free_p[i:i + best] = free_t[j:j + best] = [False] * best


def test_tiles_are_maximal_matches():
    r = random.Random(3)
    for _ in range(200):
        pattern = r.sample(range(1, 60), r.randint(1, 40))              # distinct tokens: the greedy choice is unique
        cuts = sorted(r.sample(range(len(pattern) + 1), min(2, len(pattern))))
        pieces = [pattern[a:b] for a, b in zip([0, *cuts], [*cuts, len(pattern)], strict=True)]
        r.shuffle(pieces)
        text = [t for p in pieces for t in (*p, r.choice([0, 99]))]
        tiles = T.tile(pattern, text, 3)
        assert all(pattern[a:a + k] == text[b:b + k] and k >= 3 for a, b, k in tiles)
        assert sum(k for *_, k in tiles) == plain_covered(pattern, text, 3)
        for side in (0, 1):                                             # tiles do not overlap
            spans = sorted((t[side], t[side] + t[2]) for t in tiles)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_tiles_with_repeats_stop_and_are_valid():
    r = random.Random(4)
    for _ in range(300):
        pattern = [r.randint(1, 3) for _ in range(r.randint(1, 40))]
        text = [r.randint(0, 3) for _ in range(r.randint(1, 80))]
        tiles = T.tile(pattern, text, 3)
        assert [k for *_, k in tiles] == sorted((k for *_, k in tiles), reverse=True)
        used_p = [p for a, _, k in tiles for p in range(a, a + k)]
        used_t = [p for _, b, k in tiles for p in range(b, b + k)]
        assert len(set(used_p)) == len(used_p) and len(set(used_t)) == len(used_t)
        assert all(pattern[a:a + k] == text[b:b + k] and k >= 3 for a, b, k in tiles)
        free_p = [0 if p in set(used_p) else x for p, x in enumerate(pattern)]
        free_t = [-1 if p in set(used_t) or not x else x for p, x in enumerate(text)]
        runs = {tuple(free_t[i:i + 3]) for i in range(len(free_t) - 2)}
        assert not any(tuple(free_p[i:i + 3]) in runs for i in range(len(free_p) - 2) if 0 not in free_p[i:i + 3])


def corpus(r):
    items = [(i, " ".join(f"b{r.randrange(400)}" for _ in range(r.randint(12, 60)))) for i in range(20)]
    items += [(50, "Two words"), (51, ""), (52, None), (53, items[0][1])]
    docs = list(ODD)
    for k in range(120):
        words = [f"w{r.randrange(400)}" for _ in range(r.randint(0, 300))]
        if k % 3 == 0:
            passage = r.choice(items[:20])[1].split()
            cut = r.randrange(len(passage) + 1)
            words[5:5] = [*passage[cut:], "x", *passage[:cut]][:r.randint(5, 80)]
        docs.append((100 + k, " ".join(words).upper() if k % 2 else " ".join(words), "en", "a", 1))
    return docs + [(900, LONG + "two, words!", "en", "a", 1)], items


def test_pairs_and_odd_rows(spark):
    docs, items = corpus(random.Random(5))
    bench = clashing(spark.createDataFrame(items, "item_id bigint, text string"))
    want = set()
    number = {}
    for d, t, *_ in docs:
        words = T.tokens(t)
        for i, p in items:
            pattern = [number.setdefault(w, len(number) + 1) for w in T.tokens(p)]
            s = 5
            if len(pattern) < s:                                        # says too little: matches nothing
                continue
            near = set(zip(*[words[k:] for k in range(s)], strict=False)) & set(
                zip(*[T.tokens(p)[k:] for k in range(s)], strict=False))
            if near:
                covered = plain_covered(pattern, [number.get(w, 0) for w in words], s)
                if covered:
                    want.add((d, i, len(pattern), covered))
    df = clashing(documents(spark, docs))
    for block in (T.BLOCK_TOKENS, 100):                                  # one block, and many
        got = T.matches(df, bench, block_tokens=block)
        assert {(x["doc_id"], x["item_id"], x["item_tokens"], x["tiled_tokens"]) for x in got.collect()} == want
    bad = {d for d, _, n, c in want if c >= T.THRESHOLD * n}
    left = T.decontaminate(df, bench)
    assert left.columns == df.columns
    assert sorted(str(x["doc_id"]) for x in left.collect()) == sorted(str(d) for d, *_ in docs if d not in bad)


def test_short_items_convict_nobody(spark):
    docs = documents(spark, [(i, "yes and no and this is all there is to say", "en", "a", 1) for i in range(50)])
    bench = spark.createDataFrame([(1, "yes"), (2, "yes and no and"), (3, None), (4, "no and this is all there")],
                                  "item_id bigint, text string")
    assert {(x["item_id"], x["n_tokens"]) for x in T.unusable_items(bench).collect()} == {(1, 1), (2, 4), (3, 0)}
    assert T.decontaminate(docs, bench.filter("item_id < 4")).count() == 50
    assert {x["item_id"] for x in T.contaminated(docs, bench).collect()} == {4}


def test_repeated_tokens_take_linear_time():
    block = T.Block([(1, "go " * 200), (2, "a b " * 300), (3, "x y z u v w")], 5)
    start = time.perf_counter()
    assert list(block.pairs("go " * 300_000)) == [(1, 200, 200, 1)]
    assert list(block.pairs("a b " * 150_000)) == [(2, 600, 600, 1)]
    assert list(block.pairs("x y z u v " * 60_000)) == [(3, 6, 5, 1)]
    assert time.perf_counter() - start < 15


def test_scripts_without_spaces():
    passage = "人工智能的发展改变了人们的生活方式"
    assert T.tokens("ab漢字 かな c1") == ["ab", "漢", "字", "か", "な", "c1"]
    block = T.Block([(1, passage)], 5)
    assert [p[:3] for p in block.pairs(f"今天我们说{passage}，以后再谈")] == [(1, len(passage), len(passage))]
    assert list(block.pairs("今天天气很好，我们去公园")) == []


def test_empty_tables(spark):
    docs, bench = documents(spark), spark.createDataFrame([(1, "one line here another")], "item_id bigint, text string")
    assert T.matches(docs.limit(0), bench).count() == 0
    assert T.matches(docs, bench.limit(0)).count() == 0
    assert T.decontaminate(docs, bench.limit(0)).count() == len(ODD)
