import random

import pytest

from gatewatch.llm import url_filter as uf
from gatewatch.llm.queries import URL_RULES


def fits(rule, host, path):
    h, slash, p = rule.partition("/")
    return (not h or host == h or host.endswith("." + h)) and path.startswith(slash + p)


def brute(rules, host, path, default="allow"):
    """Every rule tried; more labels, then a longer path, then block."""
    found = []
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if fits(rule, host, path):
            found.append(((len(h.split(".")) if h else 0, len(slash + p)), verdict == "block", rule, verdict))
    return max(found)[2:] if found else (None, default)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if c.isascii() else c for c in host), slash + path


URLS = ["http://WWW.Example.NET/en/1?x=/en/", "https://example.net/en", "http://example.net", "http://a.example.net/en/x#y", "ftp://xexample.net/en/",
        "http://b.org/fr/", "http://b.org/fr", "http://org/fr/1", "http://example.com/de/1", "http://example.com/DE/1", "http://example.com?/de/",
        "no scheme", "", None, "://", "http:///path", "http://é.net/x", "http://ÉA.net", "http://net/", "http://a.net:80/", "a://b://net/",
        "http://example.com/de/", "http://example.com/de//"]


def run(spark, urls, rules, **kw):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rows = {r.page_id: r for r in uf.filter_urls(df, rules, **kw).collect()}
    assert len(rows) == len(urls)
    return [rows[i] for i in range(len(urls))]


@pytest.mark.parametrize("kw", [{}, {"max_rules": 1}])
def test_contract_rules(spark, kw):
    for url, r in zip(URLS, run(spark, URLS, URL_RULES, **kw)):
        assert (r.host, r.path) == split(url), url
        assert (r.rule, r.verdict) == brute(URL_RULES, r.host, r.path), url


def test_random_rules_equal_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        part = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 2)))
        host = lambda: ".".join(part() for _ in range(rng.randint(1, 3)))
        path = lambda: "".join("/" + rng.choice(["", part()]) for _ in range(rng.randint(0, 3)))
        rules = [(rng.choice(["allow", "block"]), rng.choice([host(), ""]) + path()) for _ in range(8)]
        trie = uf.build_trie(rules)
        for _ in range(20):
            h, p = host(), path()
            m = uf.match(trie, h, p)
            assert (m[1:] if m else (None, "allow")) == brute(rules, h, p)


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://x.net/", "keep", 5)], "page_id long, url string, Rule string, _judged int")
    (r,) = uf.filter_urls(df, URL_RULES).collect()
    assert r["rule"] == "net/" and r["_judged"] == 5
    assert uf.filter_urls(df.limit(0), URL_RULES).collect() == []
    with pytest.raises(ValueError):
        uf.build_trie([("deny", "x/")])
