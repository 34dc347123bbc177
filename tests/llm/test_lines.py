"""Operator 10 against a plain version."""

import random

import pytest
from cases import LONG, ODD, clashing, documents

from helixframe.llm import line_bloom as L


def plain(rows, shortest=10):
    holders = {}
    for i, t, *_ in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(k := L.line_key(line)) >= shortest:
                    holders.setdefault(k, set()).add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        gone = [i is not None and len(h := holders.get(L.line_key(x), ())) > 1 and min(h) != i for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((i, t if t is None else kept, len(lines), sum(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [None, L.SEGMENT])         # the second lets nearly every line by as a suspect
def test_lines_and_odd_rows(spark, bits):
    r = random.Random(1)
    pool = [f"a shared line number {i}" for i in range(300)] + ["short", "", "  A Shared LINE number 3\t"]
    rows = ODD + [(100 + i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 30))), "en", "a", 1) for i in range(200)]
    got = L.dedup_lines(clashing(documents(spark, rows)), bits=bits)
    assert sorted([(x["doc_id"], x["text"], x["n_lines"], x["n_dropped"]) for x in got.collect()], key=str) == plain(rows)
    assert set(documents(spark).columns) < set(got.columns)


def test_columns_with_internal_names(spark):
    rows = [(1, "a line that two hold\nx"), (2, "a line that two hold\ny")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for c in ("__keys", "__ID", "__lost", "__row", "key", "first", "last"):
        df = df.withColumn(c, df["doc_id"])
    got = L.dedup_lines(df).orderBy("doc_id").collect()
    assert [(x["text"], x["n_dropped"], x["__keys"], x["__ID"], x["__lost"]) for x in got] == [
        ("a line that two hold\nx", 0, 1, 1, 1), ("y", 1, 2, 2, 2)]


def test_empty_table(spark):
    assert L.dedup_lines(documents(spark).limit(0)).count() == 0


def test_merged_filters_hold_every_repeat(spark):
    r = random.Random(2)
    rows = [(i, "\n".join(f"line of number {r.randrange(4000)}" for _ in range(20)), "en", "a", 1) for i in range(300)]
    docs = documents(spark, rows).select("doc_id", "text").repartition(7)
    seen = L.twice_filter(docs, L.MIN_BITS, 10)
    count = {}
    for _, t, *_ in rows:
        for k in L.keys_of(t, 10):
            count[k] = count.get(k, 0) + 1
    hit = set(L.suspects(list(count), seen, L.MIN_BITS // L.SEGMENT))
    assert {k for k, n in count.items() if n > 1} <= hit
    assert len(hit) < 1.02 * sum(n > 1 for n in count.values()) + 5      # and hardly any other


def test_one_long_text(spark):
    rows = [(1, LONG.replace(" and ", "\n"), "en", "a", 1), (2, LONG.replace(" and ", "\n"), "en", "a", 1)]
    assert sorted([(x["doc_id"], x["n_dropped"]) for x in L.dedup_lines(documents(spark, rows)).collect()]) == [
        (x[0], x[3]) for x in plain(rows)]
