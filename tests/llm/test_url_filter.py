import re

from tramline.llm import queries
from tramline.llm import url_filter as uf


def brute(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


URLS = [
    "http://example.com/en/1", "https://www.example.com/en/x", "https://WWW.Example.COM/EN/", "http://a.b.net/es/", "http://net/fr/q?x#y", "http://example.com", "http://example.com?en/",
    "example.com/en/", None, "", "://", "ftp://x.org/en/", "http://notexample.com/en/", "http://example.com:80/en/", "http://.com/", "http://com./", "http://a..com/x", "http://u@www.example.com/en/1",
    "http://example.com//en/", "x\nhttp://m.net/es/é", "http://É.com/", "http://com/", "a://b://c.com/",
]
RULES = [*queries.URL_RULES, ("a.com", "/en/x", "block"), ("b.com", "", "block"), ("com", "/e", "block"), ("com", "/e", "allow")]


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    for rules in (queries.URL_RULES, RULES):
        frame = spark.createDataFrame(rules, "host string, path string, verdict string")
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge(pages, frame).collect()}
        firm = [x for x in rules if x != ("com", "/e", "allow")]  # block wins
        assert got == {k: brute(u, firm) for k, u in enumerate(URLS)}


def test_repeated_rows_empty_tables(spark):
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    twice = spark.createDataFrame([(1, URLS[0]), (1, URLS[0]), (None, URLS[0])], "page_id long, url string")
    assert sorted(((r.page_id, r.verdict) for r in uf.judge(twice, rules).collect()), key=repr) == [(1, "block"), (1, "block"), (None, "block")]
    assert uf.judge(twice.limit(0), rules).count() == 0
    assert {r.verdict for r in uf.judge(twice, rules.limit(0)).collect()} == {"allow"}


def test_very_long_hosts_and_paths(spark):
    urls = ["http://" + "a." * 500_000 + "example.com/en/x", "http://example.com/" + "x" * 1_000_000, "http://" + "b" * 1_000_000 + ".net/es/" + "y/" * 300_000, "http://" + "." * 300_000]
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert got == {k: brute(u, queries.URL_RULES) for k, u in enumerate(urls)}
