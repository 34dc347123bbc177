"""Operators 1 and 4."""

import hashlib
import io
import random
import re
import zlib

import pytest
from cases import LONG, clashing
from pyspark.sql import functions as F

from helixframe.llm import url_alias as U
from helixframe.llm import warc_chunks as W
from helixframe.session import scratch_path

PAGES = "page_id bigint, url string, html string"
RULES = U.parse_rules([("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
                       ("allow", "com/fr/"), ("block", "com/de/"), ("block", "bad.net/")])
ODD = [
    (1, None, "<p>no url"), (2, "", None), (3, "nothing here", ""), (4, "http://", "x"),
    (5, "HTTP://Sub.EXAMPLE.org:80/es/1?x#y", "h"), (6, "https://example.org/en/12", "h"), (7, "https://org/", "h"),
    (8, "https://notorg/", "h"), (9, "https://x.com/fr", "h"), (10, "https://x.com/fr/://x.com/de/", "h"),
    (10, "https://x.com/fr/://x.com/de/", "h"), (None, "https://bad.net/a", "h"), (11, "https://a.net?q=/x", LONG),
]


def plain_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(str(r)), default=None)


def test_rules_on_odd_urls(spark):
    got = U.judge(clashing(spark.createDataFrame(ODD, PAGES)), RULES, implied=False).collect()
    want = []
    for i, u, _ in ODD:
        host, path, r = plain_rule(u)
        want.append((i, host, path, r and str(r), r.verdict if r else "allow"))
    assert sorted([tuple(x)[:5] for x in got], key=str) == sorted(want, key=str)
    assert U.judge(spark.createDataFrame(ODD, PAGES).limit(0), RULES).count() == 0


def test_blocks_spread_over_links(spark):
    link = lambda to: f'<head><LINK href="{to}" rel="canonical"></head>'
    jump = lambda to: f"<meta http-equiv='Refresh' content='0; url={to}'>"
    pages = [
        (1, "https://a.net/1", link("https://b.net/1")), (2, "https://b.net/1", jump("/2")),
        (3, "https://b.net/2", jump("//bad.net/x")),                     # 1 -> 2 -> 3 -> a blocked address
        (4, "https://free.org/1", link("https://b.net/2")),              # allowed by its rule in spite of them
        (5, "https://c.net/1", link("https://d.net/1")),                 # nothing blocked here
        (6, "http://www.e.net/1/?utm_source=x", ""), (7, "https://e.net/1", jump("https://bad.net/")),
        (8, "https://e.net/10", ""),
    ] + [(100 + i, f"https://hub{i}.net/", link("https://b.net/1")) for i in range(60)]
    df = spark.createDataFrame(pages, PAGES)
    got = {r["page_id"]: (r["verdict"], r["alias"]) for r in U.judge(df, RULES).collect()}
    blocked = {1, 2, 3, 6, 7, *range(100, 160)}
    assert {k for k, v in got.items() if v == ("block", True)} == blocked
    assert all(v == ("allow", False) for k, v in got.items() if k not in blocked)
    own = {r["page_id"]: r["verdict"] for r in U.judge(df, RULES, implied=False).collect()}
    assert own[6] == "allow" and own[7] == "block"
    shared = {r["page_id"]: r["verdict"] for r in U.judge(df, RULES, allow_scope="component").collect()}
    assert shared[1] == "allow" and shared[7] == "block"                 # 4 is in the component of 1


def test_implied_addresses(spark):
    urls = ["http://www.A.net:80/x/?ref=a&b=1#t", "https://m.a.net/x?b=1&utm_medium=q", "https://a.net/x?b=1", "m.a.net"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(U.implied_address(df["url"])).collect()] == ["https://a.net/x?b=1"] * 3 + [None]


def test_links_resolve_as_browsers_do(spark):
    from urllib.parse import urljoin
    base = "https://h.net/x/y/z.html?q=1"
    links = ["../z", "../../../z", "./a", "b/./c/../d", "?p=2", "#t", "/r/../s", "//o.net/k", "https://o.net/b?c=/../d", ".", "..",
             "e.html", "/.well", "f/..g"]
    df = spark.createDataFrame([(i, x, base) for i, x in enumerate(links)], "i int, x string, u string")
    got = {r["i"]: r["a"] for r in df.select("i", U._absolute(df["x"], df["u"]).alias("a")).collect()}
    assert got == {i: urljoin(base, x) for i, x in enumerate(links)}
    dotted = spark.createDataFrame([("//o.net/./k/..",), ("https://o.net/a/../b?c=/../d",)], "x string")
    assert [r[0] for r in dotted.select(U._absolute(dotted["x"], F.lit(base))).collect()] == ["https://o.net/", "https://o.net/b?c=/../d"]
    none = spark.createDataFrame([("mailto:a@b.c",), ("javascript:x()",), ("data:,x",), ("",), (None,)], "x string")
    assert {r[0] for r in none.select(U._absolute(none["x"], none["x"].isNull().cast("string"))).collect()} == {None}
    html = '<base href="/deep/"><link data-href="/no" rel=canonical href="c"><meta http-equiv=refresh content="0;url=../m">'
    one = spark.createDataFrame([(html, base)], "h string, u string")
    assert one.select(U.page_links(one["h"], one["u"])).first()[0] == ["https://h.net/deep/c", "https://h.net/m"]


def test_targets_have_conventional_redirects(spark):
    link = lambda to: f'<link rel="canonical" href="{to}">'
    pages = [(1, "https://p.net/q", link("http://www.foo.com/a/")), (2, "https://foo.com/a", link("https://bad.net/")),
             (3, "https://p.net/r", link("http://www.foo.com/b/"))]
    df = spark.createDataFrame(pages, PAGES)
    got = {r["page_id"]: r["verdict"] for r in U.judge(df, RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}
    assert {r["page_id"]: r["verdict"] for r in U.judge(df, RULES, implied=False).collect()}[1] == "allow"


def plain_records(rows):
    least = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 100 and i is not None:
            least[data] = min(i, least.get(data, i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = least.get(data)
        again = first is not None and first != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response",
                    first if again else None, True))
    return sorted(out, key=str)


def test_archives_round_trip(spark):
    r = random.Random(1)
    bodies = ["", "x" * 99, "y" * 100, "é\r\n\r\nWARC/1.1\r\n" * 30, LONG] + ["z" * r.randint(90, 5000) for _ in range(20)]
    rows = ODD + [(100 + i, f"http://h/\r\n{i}", r.choice([None, *bodies])) for i in range(200)] + [(300, "u", None)]
    df = clashing(spark.createDataFrame(rows, PAGES)).repartition(3)
    got = W.round_trip(df, file_bytes=10_000)                            # several archives a task
    assert sorted(map(tuple, got.collect()), key=str) == plain_records(rows)
    assert W.round_trip(df.limit(0)).count() == 0


def test_chunks_are_bounded_and_digests_run(spark):
    body = "".join(chr(97 + i % 26) for i in range(100_000))
    folder = scratch_path(spark, "warc-test")
    manifest = W.write_archives(spark.createDataFrame([(1, "u", body), (2, "v", "")], PAGES), folder)
    rows = sorted(W.read_chunks(manifest, chunk_bytes=999).collect(), key=lambda x: (x["record_id"], x["chunk_no"]))
    one = [x for x in rows if x["record_id"] == "1"]
    assert [x["chunk_no"] for x in one] == list(range(101)) and max(len(x["data"]) for x in one) == 999
    so_far = b""
    for x in one:
        so_far += x["data"]
        assert x["bytes"] == len(so_far) and x["sha256"] == hashlib.sha256(so_far).hexdigest()
    assert so_far.decode() == body and [x["last"] for x in one] == [False] * 100 + [True]
    assert [(x["chunk_no"], bytes(x["data"]), x["last"]) for x in rows if x["record_id"] == "2"] == [(0, b"", True)]


def test_plain_and_truncated_archives():
    record = W.record_head(1, "u", "d", 5, None, "2026-01-01T00:00:00Z") + b"hello\r\n\r\n"
    for data in (record * 3, b"".join(zlib.compress(record, wbits=31) for _ in range(3)), zlib.compress(record * 3, wbits=31)):
        assert [x["data"] for x in W.chunks_of(W.ByteStream(io.BytesIO(data)), 10)] == [b"hello"] * 3
    with pytest.raises(ValueError):
        list(W.chunks_of(W.ByteStream(io.BytesIO(record[:-8])), 10))
    assert list(W.chunks_of(W.ByteStream(io.BytesIO(b"")), 10)) == []


def test_string_ids_and_null_ids(spark):
    ids = ["a\r\nX-Evil: 1", "null:7", "%41 é>", None, "7", "", None]
    rows = [(i, "u", f"{k} " * 60) for k, i in enumerate(ids)] + [("z", "u", "0 " * 60)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = W.round_trip(df).collect()
    assert sorted((str(x["page_id"]) for x in got)) == sorted(str(i) for i, *_ in rows)
    assert [(x["page_id"], x["refers_to"]) for x in got if x["record_type"] == "revisit"] == [("z", ids[0])]
    assert all(x["intact"] for x in got)


def test_manifest_is_held_against_what_was_read(spark):
    folder = scratch_path(spark, "warc-test")
    manifest = W.write_archives(spark.createDataFrame([(i, "u", "x") for i in range(5)], PAGES).coalesce(1), folder)
    chunks = W.read_chunks(manifest)
    assert W.incomplete(manifest, chunks).count() == 0
    assert [(x["records"], x["found"]) for x in W.incomplete(manifest, chunks.filter("record_id <> '3'")).collect()] == [(5, 4)]


def test_a_body_without_a_blank_line_is_not_gathered():
    body = b"HTTP/1.1 200 OK\r\n" + b"x" * 3_000_000
    record = b"WARC/1.1\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"

    class Watched(W.ByteStream):
        most = 0

        def _more(self):
            got = super()._more()
            Watched.most = max(Watched.most, len(self.held))
            return got
    assert [x["data"] for x in W.chunks_of(Watched(io.BytesIO(record * 2)), 10)] == [b"", b""]
    assert Watched.most < 2 * W._READ
