import random
import re

import pytest
from pyspark.sql import functions as F

from pagescan import catalog
from pagescan.operators.prune import among
from pagescan.operators.skew import absent, balanced_join, hot_keys
from pagescan.options import ScanOptions
from pagescan.plans import scan, walk
from pagescan.sources import readers, writers


def u(i, host="h.example.com"):
    return f"http://{host}/{i}"


def walk_in_python(starts, edges, options, domain):
    """Level by level, all targets together."""
    out, visited, frontier = [(t, t, 0) for t in starts], set(), [(t, t) for t in starts]
    for depth in range(1, options.max_depth + 1):
        found = {
            (t, d) for t, s in frontier for d in edges.get(s, ())
            if options.scope_mode == 2 or domain(d) == domain(t)
        }
        if options.share_visited:
            best = {}
            for t, d in found:
                best[d] = min(t, best.get(d, t))
            found = {(t, d) for d, t in best.items() if d not in visited}
            visited |= {d for _, d in found}
        else:
            found -= visited
            visited |= found
        out += [(t, d, depth) for t, d in found]
        frontier = list(found)
    return sorted(out)


@pytest.mark.parametrize("scope,share", [(0, True), (0, False), (2, True), (2, False)])
def test_walk_on_a_skewed_graph(spark, scope, share):
    """One page holds a third of all links and one URL is linked from everywhere; slices are forced."""
    rng = random.Random(scope * 2 + share)
    hosts = ["h.example.com", "o.example.org", "n.example.net"]
    nodes = [u(i, hosts[i % 3]) for i in range(300)]
    edges = {n: {rng.choice(nodes) for _ in range(3)} | {nodes[0]} for n in nodes}
    edges[nodes[0]] = set(nodes[1:250])
    starts = [nodes[1], nodes[2], nodes[4]]
    options = ScanOptions(scope_mode=scope, share_visited=share, max_depth=4)
    pairs = [(s, d) for s, ds in edges.items() for d in ds]
    frame = walk.with_domain(spark.createDataFrame(pairs, "src_url string, dst_url string"), options)
    got = walk.reachable(walk.seeds(spark.createDataFrame([(s,) for s in starts], "url string")), frame, options, hot_rows=5)
    domain = lambda url: url.split("/")[2].split(".", 1)[1]
    assert sorted(map(tuple, got.collect())) == walk_in_python(starts, edges, options, domain)


def test_start_is_scanned_again_when_linked(spark):
    edges = spark.createDataFrame([(u(1), u(2)), (u(2), u(1)), (u(1), u(1))], "src_url string, dst_url string")
    options = ScanOptions(max_depth=3)
    got = walk.reachable(walk.seeds(spark.createDataFrame([(u(1),)], "url string")), walk.with_domain(edges, options), options)
    assert sorted((r.url, r.depth) for r in got.collect()) == [(u(1), 0), (u(1), 1), (u(2), 1)]


def test_depth_zero_and_dead_ends(spark):
    edges = walk.with_domain(spark.createDataFrame([(u(1), u(2))], "src_url string, dst_url string"), ScanOptions())
    start = walk.seeds(spark.createDataFrame([(u(1),)], "url string"))
    assert walk.reachable(start, edges, ScanOptions(max_depth=0)).count() == 1
    assert walk.reachable(start, edges, ScanOptions(max_depth=9)).count() == 2


def test_budget(spark):
    rows = spark.createDataFrame([("a", d, u(i)) for d in range(3) for i in range(5)] + [("b", 0, u(9))], "target string, depth int, url string")
    got = walk.within_budget(rows, 7)
    kept = sorted((r.target, r.depth, r.url) for r in got.where("within_budget").collect())
    assert kept == sorted([("a", 0, u(i)) for i in range(5)] + [("a", 1, u(0)), ("a", 1, u(1)), ("b", 0, u(9))])
    assert got.count() == 16
    assert {r.refused for r in got.where("not within_budget").collect()} == {catalog.OVER_BUDGET}


def test_hot_keys(spark):
    rows = spark.createDataFrame([("x",)] * 10 + [("y",)] * 3 + [("z",)], "k string")
    assert hot_keys(rows, "k", 3) == {"x": 4}
    assert hot_keys(rows, "k") == {}


def test_balanced_join_meets_each_pair_once(spark):
    left = spark.createDataFrame([("x", i) for i in range(50)] + [("y", 1), ("l", 2), (None, 3)], "k string, a int")
    right = spark.createDataFrame([("x", i) for i in range(40)] + [("y", 1), ("y", 2), ("r", 3)], "k string, b int")
    want = [("x", a, b) for a in range(50) for b in range(40)] + [("y", 1, 1), ("y", 1, 2)]
    for left_hot, right_hot in ((hot_keys(left, "k", 7), hot_keys(right, "k", 9)), ({}, hot_keys(right, "k", 9)), ({}, {})):
        got = balanced_join(left, right, "k", left_hot, right_hot, "a", "b").collect()
        assert sorted((r.k, r.a, r.b) for r in got) == sorted(want)


def test_absent_rows_are_combined_first(spark):
    """The known keys are tested after the aggregate, on one row per key."""
    rows = spark.range(1000).select((F.col("id") % 3).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    known = spark.createDataFrame([(1,), (1,), (7,)], "k long")
    got = absent(rows, known, ["k"])
    assert sorted((r.k, r.n) for r in got.collect()) == [(0, 334), (2, 333)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.index("Join LeftOuter") < plan.index("Aggregate [")


def page(url, html, code=200):
    return (url, url, code, None, None, html, {}, [], 0.0, None, None)


def test_scan_end_to_end(spark, tmp_path):
    pages = [
        page(u(1), "<a href='/2'><a href='/del'><a href='https://o.example.org/x'><a href='/gone'> 1.2.3.4"),
        page(u(2), "<a href='/3'><a href='https://o.example.org/y'>"),
        page(u(3), "<a href='https://o.example.org/deep'><a href='/del3'>"),
        page("https://o.example.org/x", "<a href='/never'>outside"),
    ]
    responses = spark.createDataFrame(pages, readers.RESPONSES)
    targets = spark.createDataFrame([(u(1),), ("not a url",)], "url string")
    options = ScanOptions(max_depth=2, danger_keywords=["del"])
    done = scan.scan(targets, responses, options)
    rows = sorted((r.target, r.url, r.depth, r.status) for r in done.results.collect())
    none = catalog.NO_RESPONSE
    assert rows == sorted(
        [(u(1), u(1), 0, "200"), (u(1), u(2), 1, "200"), (u(1), u("gone"), 1, none), (u(1), u(3), 2, "200"),
         ("not a url", "not a url", 0, none)]
    )
    # The last level is scanned but not read for links.
    assert sorted(r.url for r in done.external.collect()) == ["https://o.example.org/x", "https://o.example.org/y"]
    assert [r.url for r in done.danger.collect()] == [u("del")]
    summary = done.summary()
    assert {r.section: r["count"] for r in summary.groupBy("section").count().collect()} == {1: 5, 2: 2, 3: 1}
    assert done.report().count() == 8
    writers.write_report(done.report(), str(tmp_path / "report"), partition="folder", order=["section", "url"])
    written = spark.read.options(header=True, escape='"', multiLine=True).csv(str(tmp_path / "report"))
    assert written.columns == [*catalog.REPORT_HEADER, "folder"] and written.count() == 8
    assert writers.write_summary(summary, str(tmp_path / "summary")) is True
    assert spark.read.options(header=True, escape='"').csv(str(tmp_path / "summary")).columns == catalog.REPORT_HEADER
    once = scan.scan(targets, responses, ScanOptions(max_depth=2, scope_mode=1, danger_keywords=["del"]))
    assert sorted((r.url, r.status) for r in once.external.collect()) == [
        ("https://o.example.org/x", "200"), ("https://o.example.org/y", none)
    ]
    assert once.results.count() == 5


def test_scan_of_several_targets_without_shared_visits(spark):
    pages = [page(u(i), f"<a href='/{i + 1}'><a href='/hub'>") for i in range(6)] + [page(u("hub"), "<a href='/0'> a@b.com")]
    responses = spark.createDataFrame(pages, readers.RESPONSES)
    targets = spark.createDataFrame([(u(0),), (u(3),)], "url string")
    done = scan.scan(targets, responses, ScanOptions(max_depth=1, share_visited=False))
    rows = sorted((r.target, r.url, r.depth, len(r.sensitive_raw)) for r in done.results.collect())
    assert rows == sorted([(u(0), u(0), 0, 0), (u(0), u(1), 1, 0), (u(0), u("hub"), 1, 1), (u(3), u(3), 0, 0), (u(3), u(4), 1, 0), (u(3), u("hub"), 1, 1)])


def test_scan_budget(spark):
    pages = [page(u(i), "".join(f"<a href='/{j}'>" for j in range(10))) for i in range(10)]
    done = scan.scan(
        spark.createDataFrame([(u(0),)], "url string"), spark.createDataFrame(pages, readers.RESPONSES), ScanOptions(max_depth=3, max_urls=4)
    )
    rows = done.results.collect()
    refused = [r for r in rows if r.status == catalog.OVER_BUDGET]
    assert sorted((r.depth, r.url) for r in rows if r not in refused) == [(0, u(0)), (1, u(0)), (1, u(1)), (1, u(2))]
    assert {r.url for r in refused} == {u(i) for i in range(3, 10)}


def test_refused_pages_are_not_expanded(spark):
    """A chain where only a refused page links onward: its child is neither scanned nor reported."""
    pages = [page(u(0), "<a href='/1'><a href='/2'>"), page(u(1), ""), page(u(2), "<a href='/3'>"), page(u(3), "")]
    done = scan.scan(spark.createDataFrame([(u(0),)], "url string"), spark.createDataFrame(pages, readers.RESPONSES), ScanOptions(max_depth=5, max_urls=2))
    rows = {(r.url, r.depth, r.status) for r in done.results.collect()}
    assert rows == {(u(0), 0, "200"), (u(1), 1, "200"), (u(2), 1, catalog.OVER_BUDGET)}


def test_listed_urls_cost_no_request(spark):
    """What the black list refuses is not requested and leaves the budget to others."""
    pages = [page(u(0), "<a href='/1'><a href='/bad'><a href='/2'>"), page(u(1), ""), page(u("bad"), ""), page(u(2), "")]
    options = ScanOptions(max_depth=2, max_urls=3, scope_mode=3, whitelist_domains=["h.example.com"], blacklist_domains=["/1"])
    done = scan.scan(spark.createDataFrame([(u(0),)], "url string"), spark.createDataFrame(pages, readers.RESPONSES), options)
    rows = {r.url: r.status for r in done.results.collect()}
    assert rows[u(0)] == rows[u(2)] == rows[u("bad")] == "200" and rows[u(1)].startswith("Error")


@pytest.mark.parametrize("budget", [1, 5, 23])
def test_budget_against_plain_python(spark, budget):
    """Numbering by level and URL, several targets, a hot source; refused URLs stay visited."""
    rng = random.Random(budget)
    nodes = [u(i, f"h{i % 3}.example.com") for i in range(120)]
    edges = {n: {rng.choice(nodes) for _ in range(3)} for n in nodes}
    edges[nodes[0]] = set(nodes[1:60])
    starts, options = [nodes[0], nodes[1], nodes[5]], ScanOptions(scope_mode=2, max_depth=4)
    want, visited, spent = set(), set(), dict.fromkeys(starts, 0)
    frontier = [(t, t) for t in starts]
    for depth in range(options.max_depth + 1):
        level = frontier if depth == 0 else []
        if depth:
            best = {}
            for t, s in frontier:
                for d in edges[s] - visited:
                    best[d] = min(t, best.get(d, t))
            visited |= set(best)
            level = [(t, d) for d, t in best.items()]
        frontier = []
        for t, d in sorted(level):
            spent[t] += 1
            want.add((t, d, depth, spent[t], spent[t] <= budget))
            frontier += [(t, d)] * (spent[t] <= budget)
    pairs = spark.createDataFrame([(s, d) for s, ds in edges.items() for d in ds], "src_url string, dst_url string")
    got = walk.reachable(walk.seeds(spark.createDataFrame([(s,) for s in starts], "url string")), walk.with_domain(pairs, options), options, hot_rows=5, budget=budget)
    assert {tuple(r) for r in got.collect()} == want


def test_redirects_to_one_page(spark):
    """Two URLs that end at one page: equal bodies are duplicates, different ones are not, and no row is multiplied."""
    for second, flags in (("same", [False, True]), ("another body", [False, False])):
        a, b = list(page(u(1), "same")), list(page(u(2), second))
        a[0] = b[0] = u("z")
        responses = spark.createDataFrame([tuple(a), tuple(b)], readers.RESPONSES)
        got = scan.flagged_results(responses.withColumn("depth", F.lit(0)).withColumn("target", F.lit("t"))).collect()
        assert [r.is_duplicate_signature for r in sorted(got, key=lambda r: r.original_url)] == flags


def test_a_page_captured_twice(spark):
    responses = spark.createDataFrame([page(u(1), "same")] * 3, readers.RESPONSES)
    got = scan.flagged_results(responses.withColumn("depth", F.lit(0)).withColumn("target", F.lit("t"))).collect()
    assert sorted(r.is_duplicate_signature for r in got) == [False, True, True]


def test_externals(spark):
    external = spark.createDataFrame([("http://a.example.org/",), ("http://b.example.org/",)], "url string")
    captured = spark.createDataFrame([page("http://a.example.org/", "x")], readers.RESPONSES)
    got = {r.original_url: (r.status, r.length) for r in scan.externals_once(external, captured).collect()}
    assert got == {"http://a.example.org/": ("200", 1), "http://b.example.org/": (catalog.NO_RESPONSE, 0)}
    left = walk.externals_unvisited(external, captured, "外部").collect()
    assert [(r.url, r.status, r.title, r.sensitive_raw) for r in left] == [("http://b.example.org/", "外部", "外部", [])]


def test_scope_follows_the_target_after_a_redirect(spark):
    """The start page moved to another domain: links there are external to the target."""
    moved = list(page(u(1), "<a href='/own'><a href='https://n.example.org/full'><a href='http://h.example.com/back'>"))
    moved[0] = "https://n.example.org/start"
    responses = spark.createDataFrame([tuple(moved), page("http://h.example.com/back", "back")], readers.RESPONSES)
    done = scan.scan(spark.createDataFrame([(u(1),)], "url string"), responses, ScanOptions(max_depth=2))
    assert sorted((r.original_url, r.url, r.depth) for r in done.results.collect()) == [
        (u(1), "https://n.example.org/start", 0), ("http://h.example.com/back", "http://h.example.com/back", 1)
    ]
    assert [r.url for r in done.external.collect()] == ["https://n.example.org/full"]


def test_refused_pages_are_not_read(spark):
    responses = spark.createDataFrame([page(u("bad"), "<a href='/x'> 1.2.3.4"), page(u(1), "<a href='/bad'>")], readers.RESPONSES)
    options = ScanOptions(max_depth=3, scope_mode=3, whitelist_domains=["h.example.com/1", "h.example.com"], blacklist_domains=["/bad"])
    done = scan.scan(spark.createDataFrame([(u(1),)], "url string"), responses, options)
    rows = {r.url: (r.status, r.length, r.sensitive_raw) for r in done.results.collect()}
    assert rows[u("bad")] == ("Error(Exception): 域名在黑名单中: " + u("bad"), 0, [])
    assert set(rows) == {u(1), u("bad")}


def test_bundler_chunks_are_followed(spark):
    chunk = "http://h.example.com/static/js/chunk-a2d74a98.1ea71fd1.js"
    responses = spark.createDataFrame(
        [page(u(1), '{"chunk-a2d74a98":"1ea71fd1"}'), page(chunk, "fetch('/from-chunk')")], readers.RESPONSES
    )
    done = scan.scan(spark.createDataFrame([(u(1),)], "url string"), responses, ScanOptions(max_depth=2))
    assert {(r.url, r.depth) for r in done.results.collect()} == {(u(1), 0), (chunk, 1), (u("from-chunk"), 2)}


def test_levels_do_not_grow_with_the_targets(spark):
    """Hundreds of targets in several words of bits, against plain Python; a level has one row for each URL and word."""
    rng = random.Random(12)
    nodes = [u(i, f"w.example{i % 2}.com") for i in range(200)]
    edges = {node: {rng.choice(nodes) for _ in range(4)} for node in nodes}
    pairs = spark.createDataFrame([(s, d) for s, ds in edges.items() for d in ds], "src_url string, dst_url string")
    made = {}
    for scope, count in ((2, 64), (2, 10), (0, 150)):
        options = ScanOptions(scope_mode=scope, share_visited=False, max_depth=3)
        starts = nodes[:count]
        got = walk.reachable(walk.seeds(spark.createDataFrame([(s,) for s in starts], "url string")), walk.with_domain(pairs, options), options)
        domain = lambda url: url.split("/")[2].split(".", 1)[1]
        assert sorted(map(tuple, got.collect())) == walk_in_python(starts, edges, options, domain)
        folder = re.search(r"file:\S*?/walk-[0-9a-f]+", "\n".join(got.inputFiles())).group()
        made[count] = [spark.read.parquet(f"{folder}/bits{depth}").count() for depth in (1, 2, 3)]
    assert max(made[64]) <= 200 and max(made[150]) <= 200 * 3


def test_only_captures_in_reach_are_searched(spark, monkeypatch):
    """A scan of one domain among fifty reads its own pages, the chunks they may name, and few false alarms."""
    pages = [page(f"http://d{d}.example{d}.com/{i}", f"<a href='/{i + 1}'>") for d in range(50) for i in range(20)]
    pages.append(page("http://cdn.other.net/static/js/chunk-a2d74a98.1ea71fd1.js", "x"))
    responses = spark.createDataFrame(pages, readers.RESPONSES)
    start = walk.seeds(spark.createDataFrame([("http://d7.example7.com/0",), ("no url",), (None,)], "url string"))
    kept = scan.in_reach(responses, start, ScanOptions())
    found = {r.original_url for r in kept.select("original_url").collect()}
    assert {f"http://d7.example7.com/{i}" for i in range(20)} | {pages[-1][1]} <= found and len(found) < 100
    assert kept.schema == responses.schema
    # The text is not shuffled: the filter comes by broadcast.
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    for options in (ScanOptions(scope_mode=2), ScanOptions(scope_mode=3, whitelist_domains=["x"]), ScanOptions(public_suffixes=None)):
        assert scan.in_reach(responses, start, options).count() == 1001
    # What is searched does not depend on the other domains' pages.
    searched = []
    real = scan.analysed
    monkeypatch.setattr(scan, "analysed", lambda rows, *more: searched.append(rows) or real(rows, *more))
    done = scan.scan(spark.createDataFrame([("http://d7.example7.com/0",)], "url string"), responses, ScanOptions(max_depth=30))
    assert done.results.count() == 21 and searched[0].count() < 100


def test_externals_once_are_searched_when_known(spark):
    pages = [page(u(1), "<a href='https://o.example.org/x'>"), page("https://o.example.org/x", "1.2.3.4"), page("https://p.example.org/y", "5.6.7.8")]
    done = scan.scan(spark.createDataFrame([(u(1),)], "url string"), spark.createDataFrame(pages, readers.RESPONSES), ScanOptions(scope_mode=1))
    assert [(r.url, [s.type for s in r.sensitive_raw]) for r in done.external.collect()] == [("https://o.example.org/x", ["IP地址"])]


def test_among_keeps_every_known_key(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, F.col("id").cast("string")).alias("k"), "id")
    known = spark.range(0, 20_000, 7).select(F.col("id").cast("string").alias("key"))
    for many in (known, known.limit(0), known.unionByName(known)):
        got = {r.id for r in among(rows, F.col("k"), many, "key").collect()}
        want = {r.id for r in rows.join(many.distinct(), F.col("k") == F.col("key")).collect()}
        assert want <= got and len(got) < len(want) + 800
    assert among(rows, F.col("k"), known.limit(0), "key", also=F.col("id") < 5).count() == 5
