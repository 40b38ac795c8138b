import random
import re
import string
import time
from urllib.parse import urljoin, urlparse, urlsplit, urlunparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagescan import catalog
from pagescan.functions import urls
from pagescan.operators import links

API = "接口"

RESOLVE = [
    ("https://h.example.com/a/b.html", "//c.example.com/x", "https://c.example.com/x"),
    ("https://h.example.com/a/b?q=1", "#/r", "https://h.example.com/a/b#/r"),
    ("https://h.example.com/a/b", "/x", "https://h.example.com/x"),
    ("https://h.example.com/a/b", "///x", "https:///x"),
    ("https://h.example.com/a/b.html", "./x", "https://h.example.com/a/x"),
    ("https://h.example.com/a/", "./x", "https://h.example.com/a//x"),
    ("https://h.example.com/b", "./x", "https://h.example.com//x"),
    ("https://h.example.com", "./x", "https://h.example.com/x"),
    ("http://h.example.com/admin/login.aspx", "../s/j.js", "http://h.example.com/s/j.js"),
    ("http://h.example.com/a/b/c", "../x/../y/", "http://h.example.com/x/y"),
    ("http://h.example.com/a", "../../../x", "http://h.example.com/x"),
    ("http://h.example.com/a/b/", "../", "http://h.example.com/a"),
    ("http://h.example.com/a", "../", "http://h.example.com/"),
    ("http://h.example.com/a/b", "https://o.example.org/z", "https://o.example.org/z"),
    ("http://h.example.com/a/b", "c//d", "http://h.example.com/a/c/d"),
    ("http://h.example.com/a/b", "?q=1", "http://h.example.com/a/b?q=1"),
    ("http://h.example.com/a/b", "#top", "http://h.example.com/a/b#top"),
    ("http://h.example.com/a;p/b;v=1?q", "#/r", "http://h.example.com/a;p/b#/r"),
    ("http://h.example.com/a/b", "ws://w.example.com//s", "ws://w.example.com/s"),
]


def test_resolve(spark):
    rows = spark.createDataFrame(RESOLVE, "base string, rel string, expected string")
    got = rows.select("*", urls.resolve(urls.Base.of(F.col("base")), F.col("rel")).alias("got")).collect()
    assert [(r.base, r.rel, r.got) for r in got] == RESOLVE


VALID = [
    ("http://h.example.com/", True),
    (" http://h.example.com/ ", True),
    ("ftp://h.example.com/", True),
    ("WSS://h.example.com", True),
    ("gopher://h.example.com/", False),
    ("h.example.com/a", False),
    ("http:///a", False),
    ("http://localhost/", False),
    ("http://h.x/", False),
    ("http://h.x:80/", True),
    ("http://h.example.com:0/", False),
    ("http://h.example.com:65535/", True),
    ("http://h.example.com:65536/", False),
    ("http://h.example.com:99999999999999999999999/", False),
    ("http://h.example.com:abc/", False),
    ("http://h.example.com:/", False),
    ("http://u:p@h.example.com:99999/", True),
    ("http://h.example.com/" + "a" * 2027, True),
    ("http://h.example.com/" + "a" * 2028, False),
    ("", False),
    ("   ", False),
    (None, False),
]


def test_valid(spark):
    rows = spark.createDataFrame(VALID, "url string, expected boolean")
    got = rows.select("url", urls.is_valid(F.col("url")).alias("got")).collect()
    assert [(r.url, r.got) for r in got] == VALID


LINK_TYPES = [
    ("https://h.example.com/a.js?v=1.2", "JS"),
    ("https://h.example.com/a", API),
    ("https://example.com", "COM"),
    ("https://h.example.com/a.html#top", "HTML#TOP"),
    ("https://h.example.com/a.tar.gz", "GZ"),
    ("https://h.example.com/", API),
    ("", API),
]


def test_link_type(spark):
    rows = spark.createDataFrame(LINK_TYPES, "url string, expected string")
    got = rows.select("url", urls.link_type(F.col("url")).alias("got")).collect()
    assert [(r.url, r.got) for r in got] == LINK_TYPES


CLEAN = [
    ("/für", "/f"),
    ("/the,", "/the"),
    ("javascript:x", None),
    ("mailto:a", None),
    ("data:x", None),
    ("tel:1", None),
    ("JavaScript:x", "JavaScript:x"),
    ('"x', None),
    ("", None),
    ("   ", None),
    (" /x", None),
    ("/a?b=1&amp;c=2", "/a?b=1&amp"),
    ("\\/a\\/b", "\\/a\\/b"),
]


def test_clean(spark):
    rows = spark.createDataFrame(CLEAN, "raw string, expected string")
    got = rows.select("raw", links.clean(F.col("raw")).alias("got")).collect()
    assert [(r.raw, r.got) for r in got] == CLEAN


def test_prepare(spark):
    rows = spark.createDataFrame(
        [("\\/a\\/b", "/a/b"), ("//h.example.com/x", "https://h.example.com/x"), ("\\/\\/h.example.com", "//h.example.com")],
        "c string, expected string",
    )
    got = rows.select("expected", links.prepare(F.col("c"), F.lit("https")).alias("got")).collect()
    assert all(r.got == r.expected for r in got)


FULL = [
    ("http://h.example.com/a", ["http://h.example.com/a"]),
    ("/go?u=http://o.example.org/z", ["http://o.example.org/z"]),
    ("/httpd/x", []),
    ("https:\\/\\/h.example.com\\/a", []),
    ("http://a.example.com/http://b.example.com", ["http://a.example.com/http://b.example.com"]),
]


def test_full_urls(spark):
    rows = spark.createDataFrame(FULL, "c string, expected array<string>")
    assert [(r.c, r.got) for r in rows.select("c", urls.full_urls(F.col("c")).alias("got")).collect()] == FULL


ROUTES = [
    ("https://example.com/", "/#/", "/p", ["https://example.com/#/p"]),
    ("https://example.com/", "/melody/api/v1", "p", ["https://example.com/melody/api/v1/p"]),
    ("https://example.com/", "/", "/p", ["https://example.com/p"]),
    ("https://example.com/", "/x/", "http://o.example.org/", ["http://o.example.org/"]),
]


@pytest.mark.parametrize("base,route,rel,expected", ROUTES)
def test_routes(spark, base, route, rel, expected):
    got = spark.range(1).select(urls.route_urls(F.lit(rel), [base], [route]).alias("got")).first().got
    assert got == expected


DOMAINS = [
    ("http://www.a.example.com/x", "example.com"),
    ("http://a.example.co.uk:80/x", "example.co.uk"),
    ("http://u:p@a.example.com.cn/", "example.com.cn"),
    ("http://example.com", "example.com"),
    ("http://co.uk/", ".co.uk"),
    ("http://www.example.zz/", "zz."),
    ("http://localhost:8080/", "localhost."),
    ("http://10.1.2.3:80/x", "10.1.2.3."),
    ("http://Shop.Example.COM./", "Example.COM"),
    ("http://notcom/", "notcom."),
]


def test_registered_domain(spark):
    rows = spark.createDataFrame(DOMAINS, "url string, expected string")
    suffixes = ["com", "co.uk", "com.cn", "cn"]
    got = rows.select("url", urls.registered_domain(F.col("url"), suffixes).alias("got")).collect()
    assert [(r.url, r.got) for r in got] == DOMAINS


DEFAULT_DOMAINS = [
    ("http://a.example.de/", "example.de"),
    ("http://b.other.de/", "other.de"),
    ("http://w.gov.cn/", "w.gov.cn"),
    ("http://x.w.gov.cn/", "w.gov.cn"),
    ("http://a.example.io/", "example.io"),
    ("http://a.example.co.jp/", "example.co.jp"),
    ("http://a.example.com.br/", "example.com.br"),
    ("http://me.github.io/", "github.io"),
    ("http://a.b.example.unlisted/", "example.unlisted"),
    ("http://a.b.c.ck/", "b.c.ck"),
    ("http://x.www.ck/", "www.ck"),
    ("http://a.b.kobe.jp/", "a.b.kobe.jp"),
    ("http://a.city.kobe.jp/", "city.kobe.jp"),
    ("http://com.br/", ".com.br"),
    ("http://localhost/", "localhost."),
    ("http://10.1.2.3/", "10.1.2.3."),
]


def test_registered_domain_by_default_rules(spark):
    rows = spark.createDataFrame(DEFAULT_DOMAINS, "url string, expected string")
    got = rows.select("url", urls.registered_domain(F.col("url"), catalog.PUBLIC_SUFFIXES).alias("got")).collect()
    assert [(r.url, r.got) for r in got] == DEFAULT_DOMAINS


def domain_in_python(host, rules):
    """By the public list's own algorithm; an unlisted name's suffix is its last label."""
    labels = host.split(".")
    tails = [".".join(labels[i:]) for i in range(len(labels))]
    for i, tail in enumerate(tails):
        if "!" + tail.lower() in rules:
            return tail
    for i, tail in enumerate(tails):
        low = tail.lower()
        if low in rules or "." in low and "*." + low.split(".", 1)[1] in rules:
            return tails[i - 1] if i else "." + host
    return tails[-2] if len(labels) > 1 and labels[-1] else labels[-1] + "."


def test_a_full_suffix_list(spark):
    """Ten thousand rules of all kinds against plain Python, and in about the time of ten."""
    pick = random.Random(3)
    label = lambda: "".join(pick.choices("abcd", k=pick.randint(1, 3)))
    rules = {pick.choice(["", "", "*.", "!"]) + ".".join(label() for _ in range(pick.randint(1, 3))) for _ in range(10_000)}
    rules = {r for r in rules if not r.startswith("!") or r.count(".")} | {"*"}
    hosts = {".".join(pick.choice([label(), label().upper()]) for _ in range(pick.randint(1, 5))) for _ in range(3000)}
    rows = spark.createDataFrame([(f"http://{h}/x",) for h in sorted(hosts)], "url string")
    got = rows.select("url", urls.registered_domain(F.col("url"), rules).alias("got")).collect()
    assert [(r.url, r.got) for r in got] == [(r.url, domain_in_python(r.url.split("/")[2], rules)) for r in got]

    many = rows.crossJoin(spark.range(20)).select("url").repartition(4).cache()
    many.count()

    def seconds(rules):
        frame = many.select(F.max(urls.registered_domain(F.col("url"), rules)))
        frame.collect()
        start = time.perf_counter()
        frame.collect()
        return time.perf_counter() - start

    assert seconds(rules) < 3 * seconds(["com", "net", "*.ck", "*"]) + 1


def test_report_name(spark):
    rows = spark.createDataFrame([("http://a-b.example.com:80/x",), ("a_b.example.com:1",)], "url string")
    got = [r[0] for r in rows.select(urls.report_name(F.col("url"))).collect()]
    assert got == ["ab.example.com", "ab.example.com"]


segment = st.text(alphabet="ab.", min_size=0, max_size=3)
rel_path = st.lists(segment, min_size=0, max_size=5).map("/".join)
tail = st.sampled_from(["", "?", "?q=1", "#", "#f", "?a/../b#c"])
base_url = st.builds(lambda p, t: "http://h.example.com" + ("/" + p if p else "") + t, rel_path, st.sampled_from(["", "?x=1", "#y"]))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(base_url, st.builds(str.__add__, rel_path, tail)), min_size=60, max_size=60))
def test_join_follows_rfc(spark, pairs):
    """References without a special prefix: standard join, then collapsed slashes."""
    pairs = [(b, r) for b, r in pairs if not r.startswith(("/", "./", "../", "#/", "http"))]
    if not pairs:
        return
    rows = spark.createDataFrame(pairs, "base string, rel string")
    for row in rows.select("base", "rel", urls.resolve(urls.Base.of(F.col("base")), F.col("rel")).alias("got")).collect():
        parsed = urlparse(urljoin(row.base, row.rel))
        expected = urlunparse(parsed._replace(path=re.sub("/{2,}", "/", parsed.path)))
        assert row.got == expected, (row.base, row.rel)


url_text = st.text(alphabet=string.ascii_letters + "0123456789:/?#@.-_%=&;", max_size=25)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(url_text.map(lambda t: t) | url_text.map("https://".__add__), min_size=100, max_size=100))
def test_split_matches_standard_library(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "u string")
    u = F.col("u")
    got = rows.select(
        "u", urls.scheme(u).alias("s"), urls.netloc(u).alias("n"), urls.full_path(u).alias("p"),
        urls.query(u).alias("q"), urls.fragment(u).alias("f"),
    )
    for row in got.collect():
        want = urlsplit(row.u)
        assert (row.s, row.n, row.p, row.q, row.f) == tuple(want), row.u
