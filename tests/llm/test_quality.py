"""Operator 7 against a plain version."""

import random
import re

from cases import ODD, clashing, documents

from helixframe.llm import quality_rules as Q


def plain_measure(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), lines)


def test_measures():
    r = random.Random(1)
    for _ in range(400):
        t = "".join(r.choice(["a", "b ", " ", "\n", "\t", "é", "#", "c|", "\x0b", "\xa0", "\x1c"]) for _ in range(r.randint(0, 60)))
        assert Q.measure(t) == plain_measure(t), t


def bucket(v):
    return v if v < 16 else (v.bit_length() - 1) * 8 + (v >> (v.bit_length() - 4)) - 24


def low_end(b):
    return b if b < 16 else ((b - 16) % 8 + 8) << ((b - 16) // 8 + 1)


def test_buckets_are_in_order_and_near(spark):
    vs = [*range(3000), 10**6, 10**9, 2**40 + 1]
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(v,) for v in vs], "v bigint").withColumn("b", Q.bucket(F.col("v")))
    for v, b, low in df.withColumn("low", Q.bucket_value(F.col("b"))).collect():
        assert b == bucket(v) and low == low_end(b) and low <= v <= low * 9 / 8 + 1


def plain_groups(rows):
    """Measures of all rows, and of those that pass the base rules by group."""
    got, groups = [], {}
    for i, t, lang, source, _ in rows:
        n, chars, symbols, dup, rep, lines = plain_measure(t)
        failed = n < 50 or 100 * rep > 50 * n
        m = {"symbol_permille": 1000 * symbols // max(chars, 1), "dup_line_permille": 1000 * dup // max(lines, 1),
             "repeat_permille": 1000 * rep // max(n, 1), "word_centichars": 100 * chars // max(n, 1)}
        got.append((i, (lang, source), failed, m))
        if not failed:
            for key in ((lang, source), (lang,), ()):
                groups.setdefault(key, []).append(m)
    return got, groups


def plain_part(values, first, last, middle):
    """Mean and standard deviation of the part of the sorted values from
    ``first`` to ``last`` per cent, each value as its bucket stands for it."""
    held, n = [], len(values)
    for k, v in enumerate(sorted(bucket(v) for v in values)):
        share = max(0, min(100 * (k + 1), last * n) - max(100 * k, first * n))
        top = low_end(v + 1) - 1
        held.append((share, (low_end(v) + top) / 2 if middle else top))
    whole = (last - first) * n
    mean = sum(w * v for w, v in held) / whole
    return mean, max(0.0, sum(w * v * v for w, v in held) / whole - mean * mean) ** 0.5


def plain_tails(rows, weight=20):
    got, groups = plain_groups(rows)
    out = []
    for i, (lang, source), failed, m in got:
        kept = not failed
        if (lang, source) in groups:
            for name, (first, last, spread) in Q.PARTS.items():
                words = name == "word_centichars"
                own, wide, every = [(len(groups[k]), *plain_part([g[name] for g in groups[k]], first, last, words))
                                    for k in ((lang, source), (lang,), ())]
                mix = lambda a, na, b: (na * a + weight * b) / (na + weight)
                mean, sd = [mix(own[k], own[0], mix(wide[k], wide[0], every[k])) for k in (1, 2)]
                off = max(mean / (8 if words else 4), spread * sd, every[2])
                kept &= (mean - off if words else -1) - 1e-9 <= m[name] <= mean + off + 1e-9
        out.append((i, failed, kept))
    return sorted(out, key=str)


def plain_kept(rows, enough):
    got, groups = plain_groups(rows)
    out = []
    for i, (lang, source), failed, m in got:
        kept = not failed
        key = next((k for k in ((lang, source), (lang,)) if len(groups.get(k, ())) >= enough), ())
        if (lang, source) in groups:
            for name, (spread, least, both) in Q.MEASURES.items():
                vs = sorted(bucket(g[name]) for g in groups[key])
                q1, q2, q3 = [low_end(vs[-(-k * len(vs) // 4) - 1]) for k in (1, 2, 3)]
                low = q1 - max(least, spread * (q2 - q1)) if both else -1
                kept &= low <= m[name] <= q3 + max(least, spread * (q3 - q2))
        out.append((i, failed, kept))
    return sorted(out, key=str)


def test_verdicts_and_odd_rows(spark):
    r = random.Random(2)
    rows = list(ODD)[:3] + list(ODD)[4:]                                # the very long text has a test of its own
    for k in range(260):
        words = ["".join(r.choice("abcdefg") for _ in range(r.randint(1, 9))) for _ in range(r.randint(40, 120))]
        if k % 9 == 0:
            words = [w + "%%#" for w in words]
        if k % 13 == 0:
            words = [w * 9 for w in words]
        lang, source = r.choice([("en", "hot"), ("en", "hot"), ("de", "b"), (None, "hot"), ("fr", None)])
        rows.append((100 + k, "\n".join(" ".join(words[i:i + 9]) for i in range(0, len(words), 9)), lang, source, 1))
    df = clashing(documents(spark, rows))
    for enough in (20, 60, 1000):
        got = Q.quality(df, enough=enough).collect()
        assert sorted([(x["doc_id"], x["base_failed"], x["kept"]) for x in got], key=str) == plain_kept(rows, enough)
    assert not all(x["kept"] or x["base_failed"] for x in got)
    assert Q.quality(df.limit(0)).count() == 0


def test_tail_verdicts_against_a_plain_version(spark):
    """The registered query's path: parts of sketches, shrunk, no constants."""
    for seed in (3, 4):
        r = random.Random(seed)
        rows = list(ODD)[:3] + list(ODD)[4:]
        for k in range(300):
            words = ["".join(r.choice("abcdefg") for _ in range(r.randint(1, 9))) for _ in range(r.randint(45, 120))]
            if k % 7 == 0:
                words = [w + "%#" * r.randint(1, 3) for w in words]
            if k % 11 == 0:
                words = [w * r.randint(2, 9) for w in words]
            lines = [" ".join(words[i:i + 9]) for i in range(0, len(words), 9)]
            if k % 6 == 0:
                lines += lines[:r.randint(1, 5)]
            lang, source = r.choice([("en", "hot"), ("en", "hot"), ("en", "c"), ("de", "b"), (None, "hot"), ("fr", None)])
            rows.append((100 + k, "\n".join(lines), lang, source, 1))
        got = Q.quality(clashing(documents(spark, rows)), tails=True).collect()
        assert sorted([(x["doc_id"], x["base_failed"], x["kept"]) for x in got], key=str) == plain_tails(rows)
        assert 5 < sum(not x["kept"] and not x["base_failed"] for x in got) < 150


def test_sketches_merge(spark):
    """Fences do not depend on how the rows are dealt."""
    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(60 + i % 7)), "en", f"s{i % 3}", 1) for i in range(200)]
    df = documents(spark, rows)
    sets = [sorted(map(tuple, Q.quality(df.repartition(n), enough=30).collect()), key=str) for n in (1, 7)]
    assert sets[0] == sets[1]


def test_a_very_long_text():
    words = [f"w{i}" for i in range(300_000)]
    assert Q.repeated_words([w.encode() for w in words]) == 0
    assert Q.repeated_words([b"same"] * 300_000) == 300_000


def test_the_groups_own_tail_decides(spark):
    """The registered query's fences: what is odd in one source is usual in
    another, also where three quarters of the documents have a measure of 0."""
    def text(i, dup=0, symbols=0):
        lines = [" ".join(f"{'#' * symbols}w{i:03d}x{k}y{j}" for j in range(8)) for k in range(8)]
        return "\n".join(x for k, line in enumerate(lines) for x in (line, "more")[:1 + (0 < dup and k <= dup)])

    rows = [(i, text(i), "en", "clean", 1) for i in range(300)]
    rows += [(1000 + i, text(i, dup=3 * (i % 5 == 0)), "en", "forms", 1) for i in range(300)]
    rows += [(2000 + i, text(i, symbols=3 * (i % 3 == 0)), "en", "marked", 1) for i in range(300)]
    rows += [(3000 + i, text(i, dup=3 * (i == 0)), "en", "small", 1) for i in range(20)]
    rows += [(9001, text(400, dup=3), "en", "clean", 1), (9002, text(401, symbols=3), "en", "clean", 1)]
    df = documents(spark, rows)
    old = {x["doc_id"]: x for x in Q.quality(df).collect()}
    got = {x["doc_id"]: x for x in Q.quality(df, tails=True).collect()}
    assert not any(x["base_failed"] for x in got.values()) and old[9001]["kept"]
    assert not got[9001]["kept"] and not got[9002]["kept"]
    assert all(got[i]["kept"] for i in got if i < 3000)
    highs = {x["source"]: x["high_dup_line_permille"] for x in Q.quality(df, tails=True).collect()}
    assert highs["clean"] < highs["small"] < highs["forms"]             # shrunk, not switched, towards the language


def test_tail_fences_merge_and_take_odd_rows(spark):
    df = clashing(documents(spark))
    sets = [sorted([(x["doc_id"], x["base_failed"], x["kept"]) for x in Q.quality(df.repartition(n), tails=True).collect()], key=str)
            for n in (1, 7)]
    assert sets[0] == sets[1] and len(sets[0]) == len(ODD)
    assert Q.quality(df.limit(0), tails=True).count() == 0
