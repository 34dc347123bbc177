"""Operator 8 against all pairs."""

import random
import re

import xxhash
from cases import ODD, clashing, documents

from helixframe.llm import simhash_bk as S
from helixframe.llm.components import components


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closed(nodes, links):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def near_sets(n, seed):
    """Random fingerprints, and chains and balls around some of them."""
    r = random.Random(seed)
    out = {r.getrandbits(64) for _ in range(n)}
    for f in list(out)[:n // 4]:
        for _ in range(6):
            out.add(f)
            f ^= 1 << r.randrange(64) | 1 << r.randrange(64)
    return sorted(out)


def plain_links(fps, radius=2):
    return [(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if (a ^ b).bit_count() <= radius]


def test_fingerprints():
    r = random.Random(2)
    for _ in range(200):
        t = "".join(r.choice("aB É \n\tcd ") for _ in range(r.randint(0, 80)))
        assert S.fingerprint(t) == plain_fingerprint(t)


def test_tree_finds_all_within_the_radius():
    fps = near_sets(200, 1)
    tree = S.BKTree()
    for f in fps:
        tree.add(f)
    for f in fps[::7]:
        assert sorted(tree.within(f, 2)) == sorted(g for g in fps if (f ^ g).bit_count() <= 2)


def test_shards_lose_no_link(spark):
    fps = near_sets(300, 3)
    df = spark.createDataFrame([(S._signed(f),) for f in fps], "fp bigint")
    want = closed(fps, plain_links(fps))
    for shard_rows in (20_000, 2):                      # the second cuts nearly every shard again
        got = closed(fps, [(a % 2**64, b % 2**64) for a, b in S.links(df, 2, shard_rows).collect()])
        assert got == want


def test_components_are_the_closure(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    links += [(1000, 1000 + i) for i in range(1, 500)]
    df = spark.createDataFrame(links + [(None, 5), (7, None), (9, 9)], "a bigint, b bigint")
    nodes = {n for a, b in links if a != b for n in (a, b)}
    got = {row["node"]: row["root"] for row in components(df).collect()}
    assert got == closed(nodes, [x for x in links if x[0] != x[1]])
    assert components(df.limit(0)).count() == 0


def test_near_duplicates_and_odd_rows(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    base = " ".join(r.choice(words) for _ in range(400))
    rows = ODD + [(100 + i, base, "en", "a", 1) for i in range(5)]
    rows += [(200 + i, base + f" end{i}", "en", "a", 1) for i in range(10)]
    got = {tuple(x) for x in S.near_duplicates(clashing(documents(spark, rows))).collect()}
    fps = {}
    for i, t, *_ in rows:
        fps.setdefault(plain_fingerprint(t), []).append(i)
    root = closed(sorted(fps), plain_links(sorted(fps)))
    least = {}                                      # a class without any id has none to be named by
    for f, ids in fps.items():
        known = [i for i in [*ids, least.get(root[f])] if i is not None]
        least[root[f]] = min(known, default=None)
    assert got == {(i, f"{f:016x}", least[root[f]]) for f, ids in fps.items() for i in ids}
    assert S.near_duplicates(documents(spark, rows).limit(0)).count() == 0
