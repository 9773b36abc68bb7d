import random

from marginalia.llm import urls

from .helpers import components

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def run(spark, rows, rules=RULES, **k):
    p = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string, host int")
    return {r.page_id: r for r in urls.url_filter(p, rules, **k).collect()}


def page(i, url, html=None):
    return (i, url, html, "x", 1)


def test_rules_longest_wins_and_odd_urls(spark):
    rows = [page(1, "http://a.example.net/en/1?x"), page(2, "HTTP://A.EXAMPLE.NET/de/"), page(3, "http://x.org/fr/a#b"), page(4, None), page(5, "no scheme"), page(6, ""), page(7, "http://net"), page(8, "http://notexample.com/de/1"), page(9, "http://example.com/de/" + "x" * 100_000)]
    for rules in (RULES, RULES + [("block", f"host{i}.invalid/x") for i in range(100)]):  # inline, and as a table
        got = run(spark, rows, rules)
        assert [(got[i].rule, got[i].verdict) for i in range(1, 10)] == [("example.net/en/", "allow"), ("net/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("example.com/de/", "block")]
        assert (got[2].host, got[2].path) == ("a.example.net", "/de/") and (got[4].host, got[4].path) == ("", "") and got[7].path == ""


def test_aliases_take_over_verdicts_and_allow_wins(spark):
    canon = '<html><LINK href="{}" rel="canonical"></html>'
    rows = [
        page(1, "http://shop.test/1", canon.format("http://bad.net/x")),
        page(2, "http://shop.test/2", canon.format("/1")),
        page(3, "http://other.test/3", '<meta http-equiv="refresh" content="0; url=http://bad.net/y">'),
        page(4, "http://mirror.test/4", canon.format("http://bad.net/y")),
        page(5, "http://mirror.test/4#part", None),
        page(6, "http://alone.test/", canon.format("#top")),
        page(7, "http://good.org/fr/7", canon.format("http://mirror.test/4")),
        page(7, "http://good.org/fr/7", None),
    ]
    got = run(spark, rows)
    assert {i: (r.verdict, r.reason) for i, r in got.items()} == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("allow", "alias"), 4: ("allow", "alias"), 5: ("allow", "alias"), 6: ("allow", "default"), 7: ("allow", "rule")}
    edges = spark.createDataFrame([("http://alone.test/", "http://bad.net/z"), (None, "x")], "src string, dst string")
    assert run(spark, rows, edges=edges)[6].verdict == "block"


def test_variants_of_a_url_are_aliases(spark):
    rows = [page(1, "http://www.Shop.test/a?utm_source=x&id=1#top"), page(2, "https://shop.test/a?id=1&ref=y"), page(3, "https://m.shop.test/a?id=1", '<link rel=canonical href="http://bad.net/x">'), page(4, "https://shop.test/b"), page(5, None), page(6, "x"), page(7, "http://shop.test")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string, host int")
    edges = urls.variant_edges(p)
    assert {(r.src, r.dst) for r in edges.collect()} == {(rows[0][1], "https://shop.test/a?id=1"), (rows[1][1], "https://shop.test/a?id=1"), (rows[2][1], "https://shop.test/a?id=1"), (rows[6][1], "https://shop.test/")}
    got = run(spark, rows, edges=edges)
    assert {i: (r.verdict, r.reason) for i, r in got.items()} == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("block", "alias"), 4: ("allow", "default"), 5: ("allow", "default"), 6: ("allow", "default"), 7: ("allow", "default")}


def test_a_larger_graph_and_a_very_long_page_against_brute_force(spark):
    r = random.Random(3)
    hosts = ["a.test", "b.org", "bad.net", "c.example.net", "d.example.com"]
    url = [f"http://{r.choice(hosts)}/{r.choice(['en', 'de', 'fr'])}/{i}" for i in range(400)]
    links = [(i, r.randrange(400)) for i in range(400) if r.random() < 0.5]
    to = dict(links)
    long = "<p>" + "word " * 400_000
    rows = [page(i, u, (long if i == 7 else "") + (f'<link rel="canonical" href="{url[to[i]]}">' if i in to else "")) for i, u in enumerate(url)]
    comp = components(range(400), links)

    def own(u):
        host, path = u[7:].split("/", 1)
        fits = [(len(x), v) for v, x in RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and ("/" + path).startswith("/" + x.split("/", 1)[1])]
        return max(fits)[1] if fits else None

    got = run(spark, rows)
    for i, u in enumerate(url):
        mates = {own(url[j]) for j in range(400) if comp[j] == comp[i] and (i in to or any(i == d for _, d in links))}
        want = own(u) or ("allow" if "allow" in mates else "block" if "block" in mates else "allow")
        assert got[i].verdict == want


def test_empty(spark):
    assert run(spark, []) == {}
