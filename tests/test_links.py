import random
import re
import time
from dataclasses import replace
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pagescan import catalog
from pagescan.operators import filters, links, stats
from pagescan.options import ScanOptions
from registry.inputs import FORMS

BASE = "https://h.example.com/d/p.html"
OPEN = ScanOptions(scope_mode=2, danger_filter=False)


def frame(spark, *htmls, url=BASE):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def cleaned(spark, html, source):
    rows = links.raw_links(frame(spark, html), [source]).where("cleaned is not null")
    return sorted({r.cleaned for r in rows.collect()})


PATTERNS = [
    ("quoted_absolute", """x='/a/b'""", ["/a/b"]),
    ("quoted_dotted", '''x="../a"''', ["../a"]),
    ("quoted_escaped", r'''"\/admin\/x.html"''', [r"\/admin\/x.html"]),
    ("backquoted_absolute", "`/a/${b}`", ["/a/"]),
    ("backquoted_dotted", "`./a`", ["./a"]),
    ("link_attribute", "<a HREF = /x,y>", ["/x"]),
    ("assets_file", "zz assets/i/a.b.woff2 zz", ["assets/i/a.b.woff2"]),
    ("quoted_url", "`//cdn.example.net/x`", ["//cdn.example.net/x"]),
    ("css_url", "background:url(/bg/a.jpg)", ["/bg/a.jpg"]),
    ("verb_call", "http.patch('items/1')", ["items/1"]),
    ("window_location", "window.location = 'home'", ["home"]),
    ("window_open", "window.open(`win`)", ["win"]),
    ("fetch_call", "fetch('api/x')", ["api/x"]),
    ("axios_call", "axios.head('svc')", ["svc"]),
    ("src_assignment", "x.src='a.js'", ["a.js"]),
    ("href_assignment", "x.href = 'y'", ["y"]),
    ("action_assignment", "f.action='z'", ["z"]),
    ("json_url", '{"url" : "j/1"}', ["j/1"]),
    ("json_src_href", "{'src':'s.json'}", ["s.json"]),
    ("template_url", "`https://t.example.com/${p}`", ["https://t.example.com/"]),
    ("router_push", "router.replace('p')", ["p"]),
    ("route_element", "<Route exact path='/no'><Route  path='rt'>", ["/no", "rt"]),
    ("call_argument", "$.get(entrance)", ["entrance"]),
    ("call_argument", "$.ajax ( a/b-c", ["a/b-c"]),
    ("data_interface", r"'DataInterface\xdo?a'", [r"DataInterface\xdo?a"]),
    ("jquery_call", "$.post( 'pp'", ["pp"]),
    ("router_add", "router.addRoutes( 'ar'", ["ar"]),
    ("require_call", "require( './m')", ["./m"]),
    ("import_call", "import('../i')", ["../i"]),
    ("no group: nothing", "`../x y`", []),
    ("plain words", "no links here", []),
]


@pytest.mark.parametrize("name,html,expected", PATTERNS, ids=[p[0] for p in PATTERNS])
def test_path_patterns(spark, name, html, expected):
    assert cleaned(spark, html, "path") == expected


def test_pattern_names_are_covered():
    dead = {"template_path", "api_version", "server_page", "template_any"}
    covered = {p[0] for p in PATTERNS} | dead | {"any_quote_absolute", "any_quote_dotted"}
    assert {name for name, _ in catalog.PATH_PATTERNS} <= covered


def test_tags(spark):
    """Bare values reach the tag patterns, any quoting reaches the DOM pass."""
    htmls = []
    for tag, attribute in catalog.TAG_ATTRIBUTES:
        forms = (f"<{tag} x=1 {attribute}=bare-{tag}>", f"<{tag.upper()} {attribute}='one-{tag}'>", f'<{tag} {attribute} = "two-{tag}">')
        htmls.append("".join(f"{form}</{tag}>" for form in forms))
    for row in links.raw_links(frame(spark, *htmls), ["tag", "dom"]).where("cleaned is not null").groupBy("page_id", "source").agg(
        F.array_sort(F.collect_set("cleaned")).alias("c")
    ).collect():
        tag = catalog.TAG_ATTRIBUTES[row.page_id][0]
        want = [f"bare-{tag}"] if row.source == "tag" else [f"bare-{tag}", f"one-{tag}", f"two-{tag}"]
        assert row.c == want


DOM = [
    ("<a title='href=/no' href=/yes>", ["/yes"]),
    ("<a href=/first href=/last>", ["/last"]),
    ("<a href='/a?x=1&amp;y=2'>", ["/a?x=1&y=2"]),
    ("<a href='&#47;n&#x2F;m'>", ["/n/m"]),
    ("<!-- <a href=/no> --><a href=/yes>", ["/yes"]),
    ("<script src=/s.js>var x='<a href=/no>';</script><a href=/yes>", ["/s.js", "/yes"]),
    ("<style>a{}<a href=/no></style><a href=/yes>", ["/yes"]),
    ("<abbr href=/no><a\nhref=/yes\n>", ["/yes"]),
    ("<a title='a>b' href=/yes>", ["/yes"]),
    ("<a href>", []),
    ("<a href='javascript:x()'>", []),
    ("<script>never closed <a href=/no>", []),
    ("<area href=/ar/><input formaction=/f src='/i'>", ["/ar/", "/f", "/i"]),
    ("<a " + " ".join(f"d{i}='{i}'" for i in range(4000)) + " href=/many>", ["/many"]),
]


@pytest.mark.parametrize("html,expected", DOM, ids=range(len(DOM)))
def test_dom(spark, html, expected):
    assert cleaned(spark, html, "dom") == expected


def found(spark, html, options=OPEN, url=BASE):
    rows = links.page_links(frame(spark, html, url=url), options).select("link", "disposition").collect()
    return sorted((r.link, r.disposition) for r in rows)


def test_webpack(spark):
    html = '{"chunk-a2d74a98":"1ea71fd1","chunk-a":"b","CHUNK-a2d74a97":"1ea71fd1"}'
    assert found(spark, html, url="https://h.example.com/x") == [
        ("https://h.example.com/static/js/chunk-a2d74a98.1ea71fd1.js", "keep")
    ]


def test_dispositions(spark):
    options = ScanOptions(danger_keywords=["del"], extension_blacklist=[".css"], blacklist_domains=["bad."])
    html = """<a href='/ok'><a href='/user/DELETE'><a href='/del.js'><a href='/del.JS'><a href=/x.CSS>
    <a href='//o.example.org/z'><a href='https://o.example.org/full'><a href='https://a.example.com/del'>
    <a href='https://bad.example.com/'><a href='https://h.example.com/y.css?q'><a href='foo:bar'>"""
    assert found(spark, html, options) == sorted(
        [
            ("https://h.example.com/ok", "keep"),
            ("https://h.example.com/user/DELETE", "danger"),
            ("https://h.example.com/del.js", "keep"),
            ("https://h.example.com/del.JS", "danger"),
            ("https://h.example.com/x.CSS", "extension"),
            ("https://o.example.org/z", "out_of_scope"),
            ("https://o.example.org/full", "external"),
            ("https://a.example.com/del", "keep"),
            ("https://bad.example.com/", "external"),
            ("https://h.example.com/y.css?q", "extension"),
            ("foo:bar", "invalid"),
        ]
    )


def test_link_found_both_ways_may_end_in_two_places(spark):
    options = ScanOptions(danger_keywords=["del"])
    html = "<a href='/del'><a href='https://h.example.com/del'>"
    assert found(spark, html, options) == [("https://h.example.com/del", "danger"), ("https://h.example.com/del", "keep")]


def test_routes_stop_after_a_dangerous_variant(spark):
    options = ScanOptions(
        scope_mode=2, fuzz=True, custom_base_urls=["https://r.example.com/"], api_routes=["/v1", "/drop", "/v3"], path_routes=["/#/"],
        danger_keywords=["drop"],
    )
    assert found(spark, "<a href='/p'>", options) == [
        ("https://h.example.com/p", "keep"),
        ("https://r.example.com/drop/p", "danger"),
        ("https://r.example.com/v1/p", "keep"),
    ]
    assert found(spark, "<a href='/p'>", replace(options, fuzz=False)) == [("https://h.example.com/p", "keep")]


def test_each_link_once_per_page_and_partition_of_the_links(spark):
    html = "<a href='/a'><a href='./../a'><a href=\"/a\"><a href='//h.example.com/a'><a href='https://h.example.com/a'>"
    rows = found(spark, html, ScanOptions(danger_keywords=["zzz"]))
    assert rows == [("https://h.example.com/a", "keep"), ("https://h.example.com/d/../a", "keep")]


SCOPES = [
    (0, "https://a.example.com/", True),
    (0, "https://example.org/", False),
    (1, "https://b.example.com:8080/", True),
    (2, "https://anything.zz/", True),
    (2, "https://spam-farm.example.com/", False),
    (3, "https://blog.example.org/", True),
    (3, "https://www.example.com/?blog.", False),
]


@pytest.mark.parametrize("mode,url,expected", SCOPES)
def test_scope(spark, mode, url, expected):
    options = ScanOptions(scope_mode=mode, blacklist_domains=["spam-farm"], whitelist_domains=["blog."])
    assert spark.range(1).select(filters.in_scope(F.lit(url), F.lit("example.com"), options)).first()[0] is expected


def test_scope_without_suffix_table(spark):
    options = ScanOptions(public_suffixes=None)
    urls = ["https://h.example.com/", "https://x.h.example.com/", "https://example.com/", "https://xh.example.com/"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r[0] for r in rows.select(filters.in_scope(F.col("u"), F.lit("h.example.com"), options)).collect()]
    assert got == [True, True, False, False]


DANGER = [
    ("http://h.example.com/user/DELETE", ["del"], True),
    ("http://h.example.com/del.js", ["del"], False),
    ("http://h.example.com/del.JS", ["del"], True),
    ("http://model.example.com/x", ["del"], True),
    ("http://h.example.com/a+b(c", ["+B("], True),
    ("http://h.example.com/x", [], False),
]


@pytest.mark.parametrize("url,keywords,expected", DANGER)
def test_danger(spark, url, keywords, expected):
    assert spark.range(1).select(filters.is_dangerous(F.lit(url), keywords)).first()[0] is expected


def test_danger_types(spark):
    one = spark.range(1)
    url = F.lit("http://h.example.com/Delete/stop")
    assert one.select(filters.danger_types(url, ["del", "delete", "stop"])).first()[0] == "del, delete, stop"
    assert one.select(filters.danger_types(url, ["del", "delete", "stop"], ignore_case=False)).first()[0] == "stop"
    assert one.select(filters.danger_types(F.lit("http://h.example.com/Del"), ["del"], ignore_case=False)).first()[0] == "未知"


def test_extension(spark):
    rows = spark.createDataFrame(
        [("http://h.e.com/a.CSS?x", True), ("http://h.e.com/a.css/b", False), ("http://h.e.com/?a.css", False), ("http://h.e.com/a.css;v=1", True)],
        "u string, expected boolean",
    )
    assert all(r.got == r.expected for r in rows.select("expected", filters.has_extension(F.col("u"), [".css"]).alias("got")).collect())


def test_pattern_counts(spark):
    rows = links.pattern_counts(frame(spark, "<a href='/x'><a href=/y>fetch('/z')", "fetch(w) fetch('v')"))
    got = {r.pattern: r.matches for r in rows.collect()}
    assert len(got) == 34 + 42 + 1
    assert (got["a_href_quoted"], got["a_href_bare"], got["fetch_call"], got["call_argument"]) == (1, 2, 2, 3)


def test_link_stats(spark):
    rows = spark.createDataFrame(
        [(1, "u", "keep"), (1, "v", "keep"), (1, "w", "danger"), (2, "u", "keep"), (2, "t", "keep"), (3, "e", "external")],
        "page_id long, link string, disposition string",
    )
    visited = spark.createDataFrame([("v",)], "url string")
    got = {r.page_id: (r.n_keep, r.n_danger, r.n_external, r.added, r.skipped) for r in stats.link_stats(rows, visited).collect()}
    assert got == {1: (2, 1, 0, 1, 1), 2: (2, 0, 0, 1, 1), 3: (0, 0, 1, 0, 0)}


def variations():
    """The forms of the registered queries, also with other blanks, letters and quotes."""
    base = FORMS.replace("{id}", "7").replace("{hex}", "a2d74a98").replace("{xeh}", "1ea71fd1")
    swaps = [
        ("", ""), (" ", "\u00a0"), (" ", "\x1c"), (" ", "\u0e35"), ('"', "'"), ("'", "`"), ("s", "ſ"), ("k", "K"), ("i", "ı"), ("i", "İ"),
        ("=", " = "), ("(", "( "), ("/", "//"), ("<", "é<"), (">", " >"), ("\n", "\r"), ("a", "²"),
    ]
    return [base.replace(old, new) if old else base for old, new in swaps] + [base.upper(), base[::-1]]


def test_patterns_agree_with_the_standard_library(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    htmls = variations() + pages
    got = {}
    for row in links.raw_links(frame(spark, *htmls), ["path", "tag"]).collect():
        got.setdefault((row.page_id, row.source), set()).add(row.raw)
    sources = {
        "path": [p for _, p in catalog.PATH_PATTERNS],
        "tag": [p for _, _, p in links.tag_patterns()],
    }
    for number, html in enumerate(htmls):
        for source, patterns in sources.items():
            want = set()
            for pattern in patterns:
                for match in re.findall(pattern, html, re.IGNORECASE):
                    want.add(next((m for m in match if m), "") if isinstance(match, tuple) else match)
            allowed = lambda texts: {t for t in texts if re.match(catalog.ALLOWED_PREFIX, t)}
            assert allowed(got.get((number, source), set())) == allowed(want), (number, source)
    counts = {r.pattern: r.matches for r in links.pattern_counts(frame(spark, *htmls)).collect()}
    for name, pattern in [*catalog.PATH_PATTERNS, *[(n, p) for n, _, p in links.tag_patterns()]]:
        assert counts[name] == sum(len(re.findall(pattern, html, re.IGNORECASE)) for html in htmls), name


class Collector(HTMLParser):
    """Link attributes as the standard library's tag reader sees them."""

    def __init__(self):
        super().__init__()
        self.found = set()

    def handle_starttag(self, tag, attrs):
        for name, value in dict(attrs).items():
            if (tag, name) in catalog.TAG_ATTRIBUTES:
                self.found.add(value or "")


def test_dom_agrees_with_the_standard_library(spark):
    base = variations()[0]
    texts = [base, base.upper(), base.replace('"', "'"), base.replace(" ", "\n"), base.replace("=", " = ")]
    htmls = texts + [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    got = {}
    for row in links.raw_links(frame(spark, *htmls), ["dom"]).collect():
        got.setdefault(row.page_id, set()).add(row.raw)
    for number, html in enumerate(htmls):
        reader = Collector()
        reader.feed(html)
        reader.close()
        assert got.get(number, set()) == reader.found, number


def test_pages_are_scanned_once(spark):
    """No filter ahead of the explodes repeats the pattern work, and only needed columns are read."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = links.page_links(pages.drop("page_id"), OPEN).select("link")._jdf.queryExecution().executedPlan().toString()
    assert plan.count(r"window\.open") == 1
    assert "Exchange" not in plan
    assert "ReadSchema: struct<url:string,html:string>" in plan


def library_strings(html, source):
    """What the fixed patterns capture by the standard library."""
    patterns = [p for _, p in catalog.PATH_PATTERNS if re.compile(p).groups]
    if source == "tag":
        patterns = [p for name, _, p in links.tag_patterns() if name.endswith("_bare")]
    out = set()
    for pattern in patterns:
        for match in re.findall(pattern, html, re.IGNORECASE):
            out.add(next((g for g in match if g), "") if isinstance(match, tuple) else match)
    return out - {""}


def test_linear_forms_give_the_same_strings(spark):
    """Pieces of tags and calls, joined at random, and beginnings over and over."""
    pick = random.Random(11)
    pieces = [
        "<a", "<A ", "<link", "<img ", "<input ", "<", ">", " ", "href", "href=", " HREF = ", "src=", "formaction=", "action =", "'", '"', "/x", "y.js", "z)", "url(", "url('", ")",
        "assets/", "assets/a.", ".js", ".woff2", "é", "\n", "data=", "<object ", "<meta content=", "=", "`", "/",
    ]
    htmls = ["".join(pick.choices(pieces, k=pick.randint(1, 30))) for _ in range(1200)]
    htmls += [piece * 40 for piece in pieces] + ["<a " * 30 + "href=x" + "<a " * 9 + ">" + "<a " * 5, "url(" * 20 + "x)" + "url(" * 9, "assets/" * 9 + "b.js" + "assets/" * 8]
    rows = links.raw_links(frame(spark, *htmls), ["path", "tag"]).select("page_id", "source", "raw").where("raw <> ''").collect()
    got = {}
    for row in rows:
        got.setdefault((row.page_id, row.source), set()).add(row.raw)
    for number, html in enumerate(htmls):
        for source in ("path", "tag"):
            assert got.get((number, source), set()) == library_strings(html, source), html
    counts = {r.pattern: r.matches for r in links.pattern_counts(frame(spark, *htmls)).collect()}
    for name, pattern in [*catalog.PATH_PATTERNS, *[(n, p) for n, _, p in links.tag_patterns()]]:
        assert counts.get(name, 0) == sum(len(re.findall(pattern, html, re.IGNORECASE)) for html in htmls), name


HOSTILE = ["<a ", "<a href", "<a x='", '<a x="', "<script ", "<script '", "<script x=\"<!--", "<input src", "assets/", "url(", "<!-- ", "<a b=c ", "<link href = "]


@pytest.mark.parametrize("piece", HOSTILE)
def test_hostile_pages_take_linear_time(spark, piece):
    def seconds(n):
        pages = frame(spark, piece * n)
        start = time.perf_counter()
        links.raw_links(pages).collect()
        return time.perf_counter() - start

    seconds(10)
    small = min(seconds(16_000) for _ in range(2))
    assert min(seconds(64_000) for _ in range(2)) < 4 * 1.6 * small + 1


def test_an_unclosed_tag_holds_no_links(spark):
    assert cleaned(spark, "<a href=/yes><a title='<a href=/no>", "dom") == ["/no", "/yes"]
    assert cleaned(spark, "<a href=/yes><a title='<a href=/no>' ", "dom") == ["/yes"]
    assert cleaned(spark, "<script x='>var a='<a href=/no>';</script><a href=/yes>", "dom") == ["/yes"]
