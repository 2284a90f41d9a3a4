"""URL filter: a full and a roomy filter give the same, rules, forms of URLs, awkward rows."""

from plumbline.llm import url_filter
from plumbline.llm.queries import RULES

SCHEMA = "page_id long, url string, html string, host string, path string, `key` string, block long, salt int"
URLS = [
    None, "", "no scheme", "http://", "http:///x", "https://A.Net/x", "https://a.net", "http://net/", "http://xnet/", "https://WWW.Spam.example.com/a/?utm_source=x&b=2&a=1#top",
    "https://example.net/en/1", "https://m.example.net/en", "http://example.com/de/x?y://z", "ftp://sub.example.com/DE/", "x://y://z.org/fr/1", "https://b.org/fr/?q", "https://fr.org?/fr/", "https://a.net:80/é", "https://u\nv.org/fr/\n#x", "https://e.com/" + "x" * 50_000,
]


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "h", "c", "c", "c", 1, 1) for k, u in enumerate(urls)], SCHEMA)


def slow_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None, None
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def test_rules(spark):
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages(spark, URLS), RULES, pages(spark, [])).collect()}
    for k, u in enumerate(URLS):
        host, path, rule, verdict = slow_rule(u)
        assert got[k] == (host, path, rule, verdict or "allow"), u


def test_list_whatever_the_filter(spark):
    """Nine of ten URLs aren't listed; one listed URL has half of the rows. A filter of one block passes all to the join."""
    urls = [f"https://h{k % 7}.io/p/{k}?b=1&a=2" for k in range(2000)] + ["http://www.hot.io/x/"] * 2000 + URLS
    listed = [f"http://m.h{k % 7}.io/p/{k}/?a=2&b=1&utm_medium=z#f" for k in range(0, 2000, 10)] + ["https://hot.io:443/x", None, "nothing", "http://h3.io/p/3?a=2&b=1&c=1"] * 2
    want = [(not r and "block") if (u and ("hot.io" in u or ("/p/" in u and int(u.split("/p/")[1].split("?")[0]) % 10 == 0))) else None for u in urls for r in [slow_rule(u)[2]]]
    for most in (1, 1 << 10):
        got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages(spark, urls), [], pages(spark, listed), max_blocks=most).collect()}
        assert len(got) == len(urls) and {k for k, v in got.items() if v == "block"} == {k for k, v in enumerate(want) if v}


def test_filter_is_bounded_and_rarely_wrong(spark):
    listed = spark.range(20_000).selectExpr("concat('h.io/', id) AS key")
    filter_, blocks = url_filter.bloom(listed, 20_000)
    assert blocks == 1024 and filter_.count() <= blocks
    assert url_filter.possible(listed, filter_, blocks).filter("NOT possible").count() == 0
    others = spark.range(20_000).selectExpr("concat('g.io/', id) AS key")
    assert url_filter.possible(others, filter_, blocks).filter("possible").count() < 400
    assert url_filter.bloom(listed, 20_000, max_blocks=4)[0].count() <= 4


def test_forms(spark):
    rows = spark.createDataFrame([(u,) for u in ["http://WWW.A.io:80/x/?b=2&utm_x=1&a=1#f", "https://a.io/x?a=1&b=2", "https://a.io/X", "//a.io", "http://?x", "http://m.a.io?ref=1"]], "url string")
    got = [r[0] for r in rows.select(url_filter.canonical(rows["url"])).collect()]
    assert got == ["a.io/x?a=1&b=2", "a.io/x?a=1&b=2", "a.io/X", None, None, "a.io"]


def test_longer_rule_wins_and_ties_go_by_text(spark):
    rules = [url_filter.Rule("block", "io", "/abc"), url_filter.Rule("allow", "a.io", "/a"), url_filter.Rule("block", "a.io", "/")]
    got = [tuple(r)[3:] for r in url_filter.judge(pages(spark, ["http://a.io/abcd", "http://a.io/x", "http://b.io/abc"]), rules, pages(spark, [])).orderBy("page_id").collect()]
    assert got == [("a.io/a", "allow"), ("a.io/", "block"), ("io/abc", "block")]


def test_keep_allowed_keeps_every_column(spark):
    urls = URLS + ["http://hot.io/x"] * 300 + ["http://cool.io/x"] * 2
    kept = url_filter.keep_allowed(pages(spark, urls), RULES, pages(spark, ["http://m.hot.io/x/"]))
    assert kept.columns == pages(spark, []).columns
    want = [k for k, u in enumerate(urls) if slow_rule(u)[3] != "block" and "hot.io" not in (u or "")]
    assert sorted(r["page_id"] for r in kept.collect()) == want


def test_empty_tables(spark):
    assert url_filter.judge(pages(spark, []), RULES, pages(spark, URLS)).collect() == []
    assert url_filter.judge(pages(spark, URLS), [], pages(spark, [])).filter("verdict <> 'allow'").count() == 0
