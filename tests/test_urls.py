"""Normal forms of web addresses, as the URL Standard gives them."""

import random

import pytest
from pyspark.sql import functions as F

from snapspark.functions import rules as R
from snapspark.functions import urls as U

FORMS = [
    ("https://example.org", "https://example.org/"),
    ("HTTPS://Example.ORG:443/A?B#C", "https://example.org/A?B#C"),
    ("http://example.org:80", "http://example.org/"),
    ("http://example.org:8080/", "http://example.org:8080/"),
    ("http://example.org:00443/", "http://example.org:443/"),
    ("http://example.org:/x", "http://example.org/x"),
    ("http://example.org:65536/", None),
    ("http://example.org:8a/", None),
    ("  https://example.org/ \x01", "https://example.org/"),
    ("https://exa\nmple.org/a\tb", "https://example.org/ab"),
    ("https:\\\\example.org\\a\\b", "https://example.org/a/b"),
    ("https:example.org/x", "https://example.org/x"),
    ("https:/example.org/x", "https://example.org/x"),
    ("https:////example.org/x", "https://example.org/x"),
    ("https://example.org/a/./b/../c", "https://example.org/a/c"),
    ("https://example.org/../..", "https://example.org/"),
    ("https://example.org/a/..", "https://example.org/"),
    ("https://example.org/a/b/..", "https://example.org/a/"),
    ("https://example.org/a/.", "https://example.org/a/"),
    ("https://example.org/a/%2E%2e/b/%2e", "https://example.org/b/"),
    ("https://example.org/a//b/", "https://example.org/a//b/"),
    ("https://example.org/...", "https://example.org/..."),
    ("https://example.org/a b\"<>`{}^|", "https://example.org/a%20b%22%3C%3E%60%7B%7D%5E|"),
    ("https://example.org/é/日本?q=é'x y#é `x", "https://example.org/%C3%A9/%E6%97%A5%E6%9C%AC?q=%C3%A9%27x%20y#%C3%A9%20%60x"),
    ("https://example.org/a?b`{}|^c#d{}|^", "https://example.org/a?b`{}|^c#d{}|^"),
    ("https://example.org/%zz%41+", "https://example.org/%zz%41+"),
    ("https://example.org/🙂", "https://example.org/%F0%9F%99%82"),
    ("https://example.org?x", "https://example.org/?x"),
    ("https://example.org/?", "https://example.org/?"),
    ("https://example.org/#", "https://example.org/#"),
    ("https://example.org#a#b?c", "https://example.org/#a#b?c"),
    ("https://example.org/\x7f\x01x", "https://example.org/%7F%01x"),
    ("https://EXAMPLE%2Eorg/", "https://example.org/"),
    ("https://ex%61mple.org/", "https://example.org/"),
    ("https://a%2Fb/", None),
    ("https://a%zz/", None),
    ("https://bücher.example/", "https://xn--bcher-kva.example/"),
    ("https://BÜCHER.example/", "https://xn--bcher-kva.example/"),
    ("https://日本.example/", "https://xn--wgv71a.example/"),
    ("https://b%C3%BCcher.example/", "https://xn--bcher-kva.example/"),
    ("https://faß.example/", "https://xn--fa-hia.example/"),
    ("https://ünïcödé.ex.日本語/", "https://xn--ncd-dma1a7bzb.ex.xn--wgv71a119e/"),
    ("https://☃.🙂.example/", "https://xn--n3h.xn--938h.example/"),
    ("https://правда.рф/", "https://xn--80aafi6cg.xn--p1ai/"),
    ("https://ｅxample。org/", "https://example.org/"),
    ("https://under_score.example/", "https://under_score.example/"),
    ("https://a..b/", "https://a..b/"),
    ("https://a b/", None),
    ("https://a<b/", None),
    ("https:///", None),
    ("https://", None),
    ("https://:80/", None),
    ("https://?x", None),
    ("https://[::1]/", "https://[::1]/"),
    ("https://[2001:DB8:0:0:0:0:0:1]:8443/x", "https://[2001:db8::1]:8443/x"),
    ("https://[1:0:0:2:0:0:0:3]/", "https://[1:0:0:2::3]/"),
    ("https://[1:0:0:2:0:0:4:3]/", "https://[1::2:0:0:4:3]/"),
    ("https://[0:0:0:0:0:0:0:0]/", "https://[::]/"),
    ("https://[::ffff:1.2.3.4]/", "https://[::ffff:102:304]/"),
    ("https://[1:2:3:4:5:6:7::]/", "https://[1:2:3:4:5:6:7:0]/"),
    ("https://[10:0:1:0:1:0:1:0]/", "https://[10:0:1:0:1:0:1:0]/"),
    ("https://[00a:0b0::0c00]/", "https://[a:b0::c00]/"),
    ("https://[1::2::3]/", None),
    ("https://[12345::]/", None),
    ("https://[:::1]/", None),
    ("https://[1:2:3:4:5:6:7]/", None),
    ("https://[::1/", None),
    ("https://::1]/", None),
    ("http://127.1/", "http://127.0.0.1/"),
    ("http://0x7f.1/", "http://127.0.0.1/"),
    ("http://017700000001/", "http://127.0.0.1/"),
    ("http://2130706433/", "http://127.0.0.1/"),
    ("http://1.2.3.4./", "http://1.2.3.4/"),
    ("http://0x/", "http://0.0.0.0/"),
    ("http://1.2.3.08/", None),
    ("http://1.2.3.256/", None),
    ("http://256.1/", None),
    ("http://4294967296/", None),
    ("http://1.2.3.4.5/", None),
    ("http://example.1/", None),
    ("http://1.example/", "http://1.example/"),
    ("ftp://example.org/", None),
    ("example.org/", None),
    ("not a url", None),
    ("", None),
    ("//example.org/", None),
    (None, None),
]


@pytest.fixture(scope="module")
def table(spark):
    rows = FORMS + [("https://u:p@example.org/", None), ("https://u@example.org/", None), ("https://@example.org/", None), ("https://:@a@example.org/", None)]
    return spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "i int, u string")


def test_normal_forms(spark, table):
    got = {r.i: r.v for r in table.select("i", U.let(U.parse(F.col("u")), U.written).alias("v")).collect()}
    wrong = {url: (got[i], want) for i, (url, want) in enumerate(FORMS) if got[i] != want}
    assert not wrong


def test_safe_urls_are_normal_and_without_credentials(spark, table):
    got = {r.i: (r.v, r.s) for r in table.select("i", R.safe_url(F.col("u")).alias("v"), R.safe_url(F.col("u"), https_only=True).alias("s")).collect()}
    for i, (url, want) in enumerate(FORMS):
        assert got[i] == (want, want if (want or "").startswith("https:") else None), url
    assert [got[len(FORMS) + i][0] for i in range(4)] == [None, None, "https://example.org/", None]


def test_length_counts_utf16_units(spark):
    urls = ["https://a.example/" + "x" * (2048 - 18), "https://a.example/" + "x" * (2049 - 18), "https://a.example/" + "🙂" * 1015, "https://a.example/" + "🙂" * 1016]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(R.safe_url(F.col("u")).isNotNull()).collect()
    assert [r[0] for r in got] == [True, False, True, False]


def test_plain_addresses_are_in_normal_form(spark, table):
    seen = table.where(U.plain(F.col("u"))).select("u", U.let(U.parse(F.col("u")), U.written).alias("v")).collect()
    assert len(seen) >= 3 and all(r.u == r.v for r in seen)


def test_punycode_equals_the_library(spark):
    rnd = random.Random(6)
    signs = "abcxyz019-éüßñ日本語中文ярд🙂☃अआ"
    labels = {"".join(rnd.choices(signs, k=rnd.randrange(1, 30))) for _ in range(300)}
    labels = sorted(label for label in labels if not label.isascii())
    got = spark.createDataFrame([(x,) for x in labels], "x string").select("x", U._punycode(F.col("x")).alias("v")).collect()
    assert {r.x: r.v for r in got} == {x: "xn--" + x.encode("punycode").decode() for x in labels}


def test_image_urls(spark):
    hosts = R.MediaHosts(trusted_images=("images.example.org",), dead_images="dead.example.org", recovered_images="recovered.example.org")
    rows = {
        "https://images.example.org/a b#x": ("OK", "https://images.example.org/a%20b"), "https://IMAGES.example.org:443/a/../b": ("OK", "https://images.example.org/b"),
        "https://images.example.org:8443/a": ("INVALID_SOURCE_URL", None), "http://images.example.org/a": ("INVALID_SOURCE_URL", None),
        "https://u@images.example.org/a": ("INVALID_SOURCE_URL", None), "https://Dead.example.org/x?y#z": ("REWRITTEN", "https://recovered.example.org/x?y"),
        "https://other.example.org/": ("SOURCE_HOST_NOT_ALLOWED", None), "nothing": ("INVALID_SOURCE_URL", None),
    }
    df = spark.createDataFrame([(u,) for u in rows], "source_url string")
    got = {r.source_url: (r.code, r.url) for r in R.with_image_url(df, "source_url", hosts).collect()}
    assert got == rows
