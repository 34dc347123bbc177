"""Operator 1, URL filters over redirect equivalence.

A rule fits a url if its host is the rule's or a subdomain of it and the path
starts with the rule's path; the longest rule wins (among rules of one length
allow goes before block, then the smaller string).  A url that a rule fits has
that rule's verdict.  Every other url takes the decision of its aliases: urls
are linked by redirects (``<meta http-equiv=refresh>``), canonical links
(``<link rel=canonical>``) and, with ``implied``, by the redirects that sites
answer by convention (http to https, ``www.`` and ``m.`` to the bare host,
default ports, a slash at the end, fragments and tracking parameters).  The
connected components of these links are found by ``components.py``; a url
without a rule is blocked if a member of its component is blocked by a rule.
An explicit allow rule always goes before a block that comes over a link;
``allow_scope="component"`` makes one allowed member protect all the aliases,
the default "url" protects only what the rule itself fits (else a blocked site
could free itself by a canonical link to an allowed one).  What no rule and no
alias decides is allowed.

Shape: parsing is plain Column functions.  Only urls that take part in a link
reach the graph, named by a 128-bit hash; a hub (one canonical address of a
third of all pages) is a grouped minimum with partial sums, and the join of
pages with the verdicts of components is left to skew-join handling.

Defined cases: a null url or one without ``://`` has an empty host and path,
no rule, no links and verdict allow; null and empty html has no links; a link
that is not absolute is resolved against its page or the page's ``<base>``, one
that leads to no page (``mailto:``) is none; repeated rows give repeated
rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import cut
from helixframe.llm.components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: query parameters that name where a visitor came from (fixed values)
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"


class Rule(NamedTuple):
    verdict: str        # allow or block
    host: str
    path: str           # starts with /

    def __str__(self) -> str:
        return self.host + self.path


def parse_rules(lines: Sequence[tuple[str, str]]) -> list[Rule]:
    """Rules from (verdict, ``host/path``) pairs."""
    out = []
    for verdict, text in lines:
        host, slash, path = text.partition("/")
        if verdict not in ("allow", "block") or not slash or not host:
            raise ValueError(f"not a rule: {verdict} {text}")
        out.append(Rule(verdict, host.lower(), slash + path))
    return out


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), else null."""
    order = sorted(rules, key=lambda r: (-len(str(r)), r.verdict, str(r)))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(order):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(str(r)).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def implied_address(url: Column) -> Column:
    """The address that a site's conventional redirects lead to; null for what
    is no url."""
    bare = F.regexp_replace(F.regexp_replace(host_of(url), r"^(?:www|m)\.(?=[^.]+\.)", ""), r":(?:80|443)$", "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    query = F.regexp_replace(query, rf"(?:^|(?<=&)){TRACKING}=[^&]*(?:&|$)", "")
    query = F.regexp_replace(query, "&$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.when(F.instr(url, "://") > 0, F.concat(
        F.lit("https://"), bare, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def without_dots(path: Column) -> Column:
    """A path that begins with ``/`` without its ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(
        s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    last = F.element_at(parts, -1)
    return F.when(~path.contains("/."), path).otherwise(
        F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _absolute(link: Column, url: Column) -> Column:
    """``link`` resolved against ``url`` (RFC 3986, 5.2); null if there is
    none, or if it leads to no page (``mailto:`` and the like)."""
    return _bound(F.struct(F.regexp_replace(F.trim(link), "&amp;", "&").alias("link"), url.alias("url")),
                  lambda x: _bound(_joined(x["link"], x["url"]), _undotted))


def _joined(link: Column, url: Column) -> Column:
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    base = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path, query = path_of(url), F.regexp_extract(url, r"(?s)^[^#]*?(\?[^#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*/)", 1)
    return (F.when(link == "", None)
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(base, link))
            .when(link.startswith("?"), F.concat(base, path, link))
            .when(link.startswith("#"), F.concat(base, path, query, link))
            .otherwise(F.concat(base, F.coalesce(F.nullif(folder, F.lit("")), F.lit("/")), link)))


def _undotted(address: Column) -> Column:
    return F.when(~address.contains("/."), address).otherwise(F.concat(
        F.regexp_extract(address, r"(?s)^(.*?://[^/?#]*)", 1), _bound(path_of(address), without_dots),
        F.regexp_extract(address, r"(?s)^[^?#]*(.*)$", 1)))


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"(?is)(?<![\w-]){name}\s*=\s*[\"']?\s*([^\"'>\s]+)", 1)


def base_address(html: Column, url: Column) -> Column:
    """What a page's links are resolved against: its first ``<base href>``,
    else its url."""
    tag = F.regexp_extract(html, r"(?is)(<base\b[^>]*>)", 1)
    return F.when(tag == "", url).otherwise(F.coalesce(_absolute(_attribute(tag, "href"), url), url))


def canonical_href(html: Column) -> Column:
    tag = F.regexp_extract(html, r"(?is)(<link\b[^>]*(?<![\w-])rel\s*=\s*[\"']?canonical\b[^>]*>)", 1)
    return _attribute(tag, "href")


def redirect_href(html: Column) -> Column:
    tag = F.regexp_extract(html, r"(?is)(<meta\b[^>]*(?<![\w-])http-equiv\s*=\s*[\"']?refresh\b[^>]*>)", 1)
    return F.regexp_extract(tag, r"(?is)\burl\s*=\s*[\"']?([^\"'>\s]+)", 1)


def page_links(html: Column, url: Column) -> Column:
    """The addresses that a page's canonical link and redirect lead to."""
    found = F.filter(F.array(canonical_href(html), redirect_href(html)), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(found) > 0, _bound(base_address(html, url), lambda b: F.transform(found, lambda x: _absolute(x, b)))) \
            .otherwise(F.array().cast("array<string>"))


def _name(address: Column) -> Column:
    return F.md5(F.encode(address, "utf-8"))


def judge(pages: DataFrame, rules: Sequence[Rule], implied: bool = True, allow_scope: str = "url",
          id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict`` and ``alias`` (whether the
    verdict came over links) for every row of ``pages``."""
    if allow_scope not in ("url", "component"):
        raise ValueError(f"allow_scope: {allow_scope}")
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    whole = F.instr("url", "://") > 0
    parsed = cut(src.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.when(whole, _name(F.col("url"))).alias("node"),
        F.filter(F.when(whole, F.concat(
            F.coalesce(page_links(F.col("html"), F.col("url")), F.array().cast("array<string>")),
            F.array(*([implied_address(F.col("url"))] if implied else [])).cast("array<string>"))), lambda x: x.isNotNull()).alias("to"),
    ).withColumn("r", best_rule(F.col("host"), F.col("path"), rules)), "url-pages")

    # what a link leads to is judged like a page: a blocked target blocks its aliases
    targets = parsed.filter(F.size("to") > 0).select("node", F.explode("to").alias("address"))
    if implied:                                         # a target has the conventional redirects of its own address, too
        onward = F.col("t.address"), implied_address(F.col("t.address"))
        targets = targets.alias("t").select(F.explode(F.array(
            F.struct(F.col("t.node").alias("node"), onward[0].alias("address")),
            F.struct(_name(onward[0]).alias("node"), onward[1].alias("address")))).alias("e")).select("e.*").filter(
                "address IS NOT NULL").filter(F.col("node") != _name(F.col("address")))
    edges = targets.select(F.col("node").alias("a"), _name(F.col("address")).alias("b"))
    roots = cut(components(edges), "url-roots")
    own = parsed.filter("node IS NOT NULL AND r IS NOT NULL").select("node", F.col("r.verdict").alias("v"))
    ruled_target = targets.select(_name(F.col("address")).alias("node"), best_rule(
        host_of(F.col("address")), path_of(F.col("address")), rules)["verdict"].alias("v")).filter("v IS NOT NULL")
    # one row for each ruled address, then one for each component
    ruled = own.unionByName(ruled_target).groupBy("node").agg(F.max("v").alias("v"))
    decided = roots.join(ruled, "node").groupBy("root").agg(
        F.max(F.col("v") == "block").alias("blocked"), F.max(F.col("v") == "allow").alias("allowed"))
    blocked = decided.filter("blocked" if allow_scope == "url" else "blocked AND NOT allowed").select("root")
    tainted = cut(roots.join(blocked, "root").select(F.col("node").alias("t_node")), "url-tainted")

    judged = parsed.join(tainted, parsed["node"] == tainted["t_node"], "left")
    by_alias = F.col("r").isNull() & F.col("t_node").isNotNull()
    return judged.select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), F.when(by_alias, "block").otherwise("allow")).alias("verdict"),
        by_alias.alias("alias"))
