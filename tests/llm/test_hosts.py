import pytest

from starloom.llm.hosts import judge_urls, propagate

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow")]
PAGES = [
    (1, "http://a.example.net/x", '<a href="http://b.io/1">'),
    (2, "http://b.io/", '<a href="//A.example.net/1"> <a href="/q">'),
    (3, "http://c.io/", "<a HREF=http://good.org/fr/>"),
    (4, "http://GOOD.org/fr/1?x#y", '<a href="http://ok.io">'),
    (5, "http://ok.io", None),
    (6, None, None),
    (7, "no scheme", "<a href='http://b.io'>"),
    (8, "http://example.net/en/1", ""),
    (8, "http://example.net/en/1", ""),
    (None, "x://notnet/", ""),
]


def test_rules_and_propagation(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {r.page_id: r for r in judge_urls(pages, RULES).collect()}
    assert [(got[i].rule, got[i].verdict) for i in (1, 2, 3, 4, 5, 6, 7, 8)] == [
        ("net/", "block"), (None, "block"), (None, "allow"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("example.net/en/", "allow"),
    ]
    assert (got[4].host, got[4].path) == ("good.org", "/fr/1") and (got[7].host, got[7].path) == ("", "") and got[None].rule is None
    assert got[2].distrust > 0.1 and got[5].trust > 0 and got[5].distrust == 0
    assert judge_urls(pages, RULES).count() == len(PAGES) and judge_urls(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in judge_urls(pages, []).collect()} == {"allow"}
    clash = pages.selectExpr("page_id", "url", "html", "1 AS host", "2 AS rules", "3 AS rank")
    assert judge_urls(clash, RULES).columns == ["page_id", "url", "html", "rank", "host", "path", "rule", "verdict", "trust", "distrust"]


def test_ranks_against_dense_iteration(spark):
    links = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3), ("d", "a", 1)]
    edges = spark.createDataFrame([("t", s, d, n) for s, d, n in links], "kind string, src string, dst string, n long")
    seeds = spark.createDataFrame([("t", "a", 0.5), ("t", "d", 0.5)], "kind string, host string, restart double")
    rank, start = {"a": 0.5, "d": 0.5}, {"a": 0.5, "d": 0.5}
    for _ in range(20):
        new = {}
        for s, d, n in links:
            new[d] = new.get(d, 0) + 0.85 * rank.get(s, 0) * n / sum(m for x, _, m in links if x == s)
        lost = 0.85 - sum(new.values())
        for h, r in start.items():
            new[h] = new.get(h, 0) + 0.15 * r + lost * r
        rank = new
    got = {r.host: r["rank"] for r in propagate(seeds, edges).collect()}
    assert got == pytest.approx(rank) and sum(got.values()) == pytest.approx(1)
