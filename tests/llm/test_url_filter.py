import re

import pytest

from snapspark.llm import url_filter as U

URLS = [
    None, "", "no scheme", "http://", "http://ORG", "http://org/", "https://a.b.Example.ORG/es/1?q=/en/", "http://example.org/en/1", "http://example.org/en/2",
    "http://notexample.org/es/", "http://x.com/fr/a", "http://com/de/b#x", "http://x.com/en/", "http://m.casino-win.example.net/en/", "http://q.net/#/de/",
    "http://q.net?x=http://org/", "ftp://user@a.org:80/x", "http://xorg/", "x://y://org/", "http://a.com/DE/", "http://exAmple.oRg/es/", "http://.org/", "http://a\nb.org/\nes",
]


def brute(url, terms):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    listed = any(t in host for t in terms)
    return host, path, best and best[1], best[2] if best else "block" if listed else "allow"


def test_judge_matches_the_rules(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(None, "http://a.org/", "h"), (3, "http://a.org/", "h"), (3, "http://a.org/", "h"), (77, "http://a.org/" + "x" * 100_000, "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3)
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(pages).collect()]
    assert sorted(got, key=str) == sorted([(i, *brute(u, U.TERMS)) for i, u, _ in rows], key=str)
    assert U.judge(pages.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_cascade_is_exact_over_its_universe(spark, bits):
    universe = spark.range(4000).selectExpr("concat('k', id) as key")
    listed = universe.where("pmod(xxhash64(key), 5) = 0")
    cascade = U.build(listed, universe, bits)
    assert len(cascade.levels) > 1
    marked = universe.withColumn("listed", cascade.lists(universe["key"]))
    assert marked.where("listed <> (pmod(xxhash64(key), 5) = 0)").count() == 0
    assert marked.where("listed").count() == listed.count()


def test_nothing_listed(spark):
    universe = spark.range(10).selectExpr("cast(id as string) as key")
    assert universe.where(U.build(universe.limit(0), universe).lists(universe["key"])).count() == 0


def test_a_given_list_and_the_join_agree(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i % 6}.net/a") for i in range(30)], "page_id long, url string")
    blocked = spark.createDataFrame([("h1.net",), ("h4.net",), ("none.net",)], "key string")
    one = sorted(map(tuple, U.judge(pages, blocked=blocked).collect()))
    assert sum(r[4] == "block" for r in one) == 10
    with_rules = U.MOST_KEYS
    calls = []
    monkeypatch.setattr(U, "listed_by_join", lambda *a, f=U.listed_by_join: calls.append(1) or f(*a))
    monkeypatch.setattr(U, "MOST_KEYS", 2)
    monkeypatch.setattr(U, "RULES", U.RULES)
    assert sorted(map(tuple, U.judge(pages, U.RULES[:2], blocked=blocked).collect())) == one
    assert calls and with_rules == 1_000_000


def test_mistakes_of_a_large_universe_leave_small_levels(spark, monkeypatch):
    universe = spark.range(20_000).selectExpr("concat('k', id) as key")
    listed = universe.where("key in ('k1', 'k22', 'k333')")
    monkeypatch.setattr(U, "MOST_KEYS", 10)
    cascade = U.build(listed, universe)
    assert sorted(r["key"] for r in universe.where(cascade.lists(universe["key"])).collect()) == ["k1", "k22", "k333"]


def test_oversized_levels_are_joined(spark, monkeypatch):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, "http://a.org/"), (3, "http://a.org/"), (None, "http://a.org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    monkeypatch.setattr(U, "MOST_KEYS", 0)
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(pages).collect()]
    assert sorted(got, key=str) == sorted([(i, *brute(u, U.TERMS)) for i, u in rows], key=str)
    assert U.judge(pages.limit(0)).count() == 0
