"""URL filters: rules by host and path, spread to aliases over redirect and canonical-link edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, connected_components, forget, written

Rule = tuple[str, str]  # ("allow" or "block", "host/path")

#: More rules than this are joined as a table instead of compiled into the expression.
INLINE_RULES = 64

LINK_TAG = r"(?is)<(?:link|meta)\b[^>]*>"


def rest_of(url: Column) -> Column:
    """What follows the first ://, empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(rest_of(url), "^[^/?#]*", 0)), F.lit(""))


def path_of_url(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.regexp_replace(rest_of(url), "^[^/?#]*", ""), "^[^?#]*", 0), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate({c: c + 32 for c in range(65, 91)}), slash + path


def _inline(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(set(rules), key=lambda r: (len(r[1]), r[1], r[0] == "allow")):  # a later one wraps the earlier ones, so the longest wins
        h, p = split_rule(rule)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def judge(urls: DataFrame, rules: Sequence[Rule] | DataFrame, key: str, url: str, keep: Sequence[str] = ()) -> DataFrame:
    """(key, keep, host, path, rule, verdict) for each row; rule and verdict are null where none fits.

    Up to INLINE_RULES rules are one JVM expression. More, or a DataFrame (verdict, rule), are
    joined: each distinct (host, path) is expanded to its host suffixes, met with the rules of that
    host by an equi-join, and reduced to its longest fit; a host that a third of all rows share is
    one row per path in that join, and its rows never meet in one task.
    """
    base = urls.select(F.col(key), *keep, host_of(F.col(url)).alias("host"), path_of_url(F.col(url)).alias("path"))
    if not isinstance(rules, DataFrame):
        if len(rules) <= INLINE_RULES:
            return base.withColumn("_b", _inline(F.col("host"), F.col("path"), rules)).select(key, *keep, "host", "path", F.col("_b.rule").alias("rule"), F.col("_b.verdict").alias("verdict"))
        rules = urls.sparkSession.createDataFrame(list(rules), "verdict string, rule string")
    table = rules.where("rule is not null").select("verdict", "rule", ascii_lower(F.regexp_extract("rule", "^[^/]*", 0)).alias("_h"), F.regexp_replace("rule", "^[^/]*", "").alias("_p"))
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    seen = base.select("host", "path").distinct()
    met = seen.withColumn("_h", F.explode(suffixes)).join(table, "_h").where(F.col("path").startswith(F.col("_p")))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", (F.col("verdict") == "allow").alias("a"), "verdict")).alias("_b"))
    return base.join(best, ["host", "path"], "left").select(key, *keep, "host", "path", F.col("_b.rule").alias("rule"), F.col("_b.verdict").alias("verdict"))


def node_of(url: Column) -> Column:
    """One string for urls that a server can't tell apart: scheme and host lower-cased, no fragment, / for an empty path."""
    at = F.instr(url, "://")
    scheme = ascii_lower(F.substring_index(url, "://", 1))
    tail = F.regexp_extract(F.regexp_replace(rest_of(url), "^[^/?#]*", ""), "^[^#]*", 0)
    tail = F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))
    return F.when(at > 0, F.concat(scheme, F.lit("://"), host_of(url), tail))


def resolved(base: Column, href: Column) -> Column:
    """href against base: absolute, //host, /path, ?query and relative references; null where base is no url."""
    scheme, host = F.substring_index(base, "://", 1), host_of(base)
    folder = F.regexp_replace(F.regexp_replace(path_of_url(base), "[^/]*$", ""), "^$", "/")
    root = F.concat(scheme, F.lit("://"), host)
    ok = F.instr(base, "://") > 0
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(ok & href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(ok & href.startswith("/"), F.concat(root, href))
        .when(ok & href.startswith("?"), F.concat(root, path_of_url(base), href))
        .when(ok & (href != "") & ~href.rlike("^(#|[A-Za-z][A-Za-z0-9+.-]*:)"), F.concat(root, folder, href))
    )


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) urls: rel=canonical links and http-equiv=refresh redirects in whole pages.

    A page without such a tag, with a null url or null html gives none.
    """
    u = F.col(url)
    tags = F.regexp_extract_all(html, F.lit(LINK_TAG), F.lit(0))
    wanted = F.filter(tags, lambda t: t.rlike(r"""(?i)\brel\s*=\s*["']?\s*canonical|\bhttp-equiv\s*=\s*["']?\s*refresh"""))
    href = r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
    to = r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)"""
    tag = F.col("_tag")
    found = F.regexp_replace(F.when(tag.rlike("(?i)^<link"), F.regexp_extract(tag, href, 1)).otherwise(F.regexp_extract(tag, to, 1)), "&amp;", "&")
    rows = pages.where(F.col(html).rlike("(?i)canonical|refresh")).select(u.alias("src"), F.explode(wanted).alias("_tag"))
    return rows.select("src", resolved(F.col("src"), found).alias("dst")).where("src is not null and dst is not null")


#: Query parameters that name a visit and not a page.
TRACKING = r"(^|&)(utm_[^&=]*|ref|fbclid|gclid)=[^&]*"


def canonical_of(url: Column) -> Column:
    """The url that sites redirect variants of it to: https, no www. or m. before the host, no fragment and no tracking parameters; null without ://."""
    query = F.regexp_extract(F.regexp_replace(rest_of(url), "^[^/?#]*", ""), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), "^&", "")
    path = F.when(path_of_url(url) == "", "/").otherwise(path_of_url(url))
    whole = F.concat(F.lit("https://"), F.regexp_replace(host_of(url), r"^(www|m)\.", ""), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(F.instr(url, "://") > 0, whole)


def variant_edges(pages: DataFrame, url: str = "url") -> DataFrame:
    """(src, dst): the redirect of each url that isn't its own canonical form, an edge table for url_filter."""
    return pages.select(F.col(url).alias("src"), canonical_of(F.col(url)).alias("dst")).where("dst is not null").where(node_of(F.col("src")) != F.col("dst"))


def url_filter(pages: DataFrame, rules: Sequence[Rule] | DataFrame, *, edges: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """(key, host, path, rule, verdict, reason): one row for each row of pages.

    The longest fitting rule decides (reason "rule"). Urls that redirect or canonical-link edges
    connect, in either direction and over any number of steps, are aliases; a url that no rule
    fits is allowed if a rule allows one of its aliases, else blocked if a rule blocks one (reason
    "alias"), else allowed (reason "default"). Edges are those in `html` (None: not read) and
    those of `edges` (src, dst). Alias classes count rules on edge ends that are no page, too.

    Nulls: a null url, or one without ://, has empty host and path and no aliases. Empty tables
    give no rows. Repeated rows and keys are each judged. Columns of pages other than key, url and
    html are not read, so clashing names do no harm. Nodes are 64-bit hashes of urls, and only
    urls with an edge take part, so the shuffles grow with the edges and not with the pages.
    """
    page = pages.select(F.col(key), F.col(url).alias("_url"))
    links = [page_edges(pages, url, html)] if html else []
    if edges is not None:
        links.append(edges.select(F.col(edges.columns[0]).alias("src"), F.col(edges.columns[1]).alias("dst")))
    if not links:
        own = judge(page, rules, key, "_url")
        return own.select(key, "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNull(), "default").otherwise("rule").alias("reason"))
    e = links[0]
    for x in links[1:]:
        e = e.union(x)
    e = written(e.select("src", "dst", F.xxhash64(node_of(F.col("src"))).alias("s"), F.xxhash64(node_of(F.col("dst"))).alias("d")).where("instr(src, '://') > 0 and instr(dst, '://') > 0"), "links")
    if e.isEmpty():  # no aliases at all
        return url_filter(pages, rules, key=key, url=url, html=None)
    comp = connected_components(e.select("s", "d"))
    ends = e.select(F.explode(F.array(F.struct(F.col("s").alias("node"), F.col("src").alias("_url")), F.struct(F.col("d").alias("node"), F.col("dst").alias("_url")))).alias("x")).select("x.*").distinct()
    ruled = judge(ends, rules, "node", "_url").where("verdict is not null").select("node", "verdict")
    by_class = ruled.join(comp, "node").groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("_allow"))
    alias = written(comp.join(by_class, "component").select(F.col("node").alias("_node"), F.when(F.col("_allow"), "allow").otherwise("block").alias("_alias")), "aliases")
    forget(e)
    flat = page.withColumn("_node", F.xxhash64(node_of(F.col("_url"))))
    own = judge(flat, rules, key, "_url", ["_node"])
    got = own.join(alias, "_node", "left")
    return got.select(
        key,
        "host",
        "path",
        "rule",
        F.coalesce("verdict", "_alias", F.lit("allow")).alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("_alias").isNotNull(), "alias").otherwise("default").alias("reason"),
    )
