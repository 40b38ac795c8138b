from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from pagescan import catalog
from pagescan.functions import text
from pagescan.operators import dedup, report, results, stats
from pagescan.operators.ranking import numbered
from pagescan.options import ScanOptions
from pagescan.plans import scan
from pagescan.sources import readers, writers

TITLES = [
    ("<title> a\r\nb </title>", "ab"),
    ("<TITLE lang=x>a &amp; b &copy; &#65;&#x42; &unknown; &lt;</TITLE>", "a & b © AB &unknown; <"),
    ("<title>one</title><title>longer two</title>", "one"),
    ("<title>a<b>c</b></title>", ""),
    ("<!-- <title>no</title> --><title>yes</title>", "yes"),
    ("<script>'<title>no</title>'</script><title>yes</title>", "yes"),
    ("<title></title>", ""),
    ("<titles>no</titles>", ""),
    ("none", ""),
    ("<title>a&nbsp;</title>", "a"),
    ("<title>&amp;lt;</title>", "&lt;"),
    ("<title>&copy;&amp;lt;</title>", "©&lt;"),
    ("<title>&#0;&#xD800;&#128512;</title>", "��😀"),
    ("<title>&ampfoo &ltdiv &notit; &notin; &#128; &#x1000000000000041;</title>", "&foo <div ¬it; ∉ € �"),
    ("<title>open <title >next", ""),
    ("<title>a</title\n> <title b", "a"),
    ("</title> <title x='>'>y</title>", "'>y"),
]


@pytest.mark.parametrize("html,expected", TITLES)
def test_title(spark, html, expected):
    assert spark.range(1).select(text.title_of(F.lit(html))).first()[0] == expected


def test_longest_title_first_on_ties(spark):
    bodies = [
        "<title>标题</title>".encode("gbk"), "<title>标题</title>".encode("utf-8"), "<title>plain</title>".encode(),
        "<title>wide</title>".encode("utf-16"), b"\xff\xfe\xff", None,
    ]
    rows = spark.createDataFrame([(b,) for b in bodies], "body binary")
    got = [r[0] for r in rows.select(text.longest_title(text.decoded_candidates()(F.col("body")))).collect()]
    as_gbk = bodies[1].decode("gbk", "strict") if _decodes(bodies[1], "gbk") else ""
    longest = as_gbk[7:-8] if len(as_gbk) - 15 > 2 else "标题"
    assert got[0] == "标题" and got[1] == longest and got[2] == "plain" and got[3] == "wide"
    assert got[4] == "None" and got[5] == "None"


def _decodes(data, encoding):
    try:
        data.decode(encoding)
        return True
    except UnicodeDecodeError:
        return False


BODIES = [
    ("é".encode(), None, "é"),
    (b"a\xffb\xc3(", "utf-8", "a�b�("),
    (b"\xe4\xb8", "UTF-8", "�"),
    ("é".encode("latin-1"), "ISO-8859-1", "�"),
    ("标题".encode("gbk"), "gbk", "标题"),
    ("標題".encode("big5"), "Big5", "標題"),
    (b"\xff", "gbk", "�"),
    ("é".encode(), "no-such-charset", "é"),
    (None, None, None),
]


def test_decode_body(spark):
    rows = spark.createDataFrame([(b, c) for b, c, _ in BODIES], "body binary, charset string")
    assert [r.content for r in readers.decoded(rows).collect()] == [t for _, _, t in BODIES]


def test_text_for_links_drops_invalid_bytes(spark):
    bodies = [b"a\xffb\xc3(", "kept � here".encode(), b"\xe4\xb8x"]
    rows = spark.createDataFrame([(b,) for b in bodies], "body binary")
    assert [r[0] for r in rows.select(text.text_for_links(F.col("body"))).collect()] == ["ab(", "kept � here", "x"]


def response(asked, code=200, content="", error=None, message=None, **more):
    row = {
        "url": asked, "original_url": asked, "status_code": code, "error_type": error, "error_message": message,
        "content": content, "headers": {}, "redirects": [], "elapsed": None, "target": "t", "depth": 0,
    }
    row.update(more)
    return tuple(row[f.name] for f in readers.RESPONSES)


def test_result_records(spark):
    rows = spark.createDataFrame(
        [
            response("http://a/", content="<title>A</title>1.2.3.4", headers={"Content-Type": "text/html", "X": "1"},
                     redirects=["http://r/", "http://s/"], elapsed=0.5, url="http://final/"),
            response("http://b/", code=404, content="x"),
            response("http://c/", code=None, error="SSLError", message="bad", content="ignored"),
            response("http://d/", code=None),
            response("http://e/", code=None, error="ValueError", message="v"),
            response("http://f/", headers=None, redirects=None, content=None, url=None),
        ],
        readers.RESPONSES,
    )
    got = {r.original_url: r for r in results.result_records(rows).collect()}
    a = got["http://a/"]
    assert (a.url, a.status, a.title, a.length, a.time) == ("http://final/", "200", "A", 23, 0.5)
    assert (a.redirects, a.content_type, a.headers_count) == ("http://r/ → http://s/", "text/html", 2)
    assert [f.rule for f in a.sensitive_raw] == ["ipv4"]
    assert got["http://b/"].title == "请求失败，状态码: 404"
    c = got["http://c/"]
    assert (c.status, c.title, c.length, c.error_type, c.sensitive_raw) == ("ConnectionError: bad", "", 0, "SSLError", [])
    assert got["http://d/"].status == "Error: No response and no error"
    assert got["http://e/"].status == "Error(ValueError): v"
    f = got["http://f/"]
    assert (f.url, f.length, f.headers_count, f.content_type, f.redirects) == ("http://f/", 0, 0, "", "")


ERRORS = [
    ("ConnectionError", "ConnectionError: m"), ("SSLError", "ConnectionError: m"), ("ConnectTimeout", "ConnectionError: m"),
    ("ProxyError", "ConnectionError: m"), ("ReadTimeout", "TimeoutError: m"), ("Timeout", "TimeoutError: m"),
    ("TooManyRedirects", "TooManyRedirects: m"), ("InvalidURL", "RequestError: m"), ("KeyError", "Error(KeyError): m"),
]


def test_error_status(spark):
    rows = spark.createDataFrame(ERRORS, "e string, expected string")
    got = rows.select("e", results.error_status(F.col("e"), F.lit("m")).alias("s")).collect()
    assert [(r.e, r.s) for r in got] == ERRORS


def test_collapsed_status_and_class(spark):
    rows = spark.createDataFrame(
        [(200, "200", "200", "2xx"), (301, "301", "301", "3xx"), (404, "404", "404", "4xx"), (503, "503", "503", "5xx"), (101, "101", "101", "other"),
         (None, "TooManyRedirects: m", "TooManyRedirects: m", "other"), (None, "TooManyRedirects: Err", "Err", "error"), (None, "Error(X): m", "Err", "error")],
        "code int, status string, collapsed string, class string",
    )
    for r in rows.select(
        "*", results.collapsed_status(F.col("code"), F.col("status")).alias("c"), results.status_class(F.col("code"), F.col("status")).alias("k")
    ).collect():
        assert (r.c, r.k) == (r.collapsed, r["class"])


DUPLICATES = [
    # target, depth, url, length, status, content, by length and status, by content
    ("a", 0, "u1", 3, 200, "abc", False, False),
    ("a", 1, "u2", 3, 200, "xyz", True, False),
    ("a", 1, "u3", 3, 200, "abc", True, True),
    ("b", 0, "u1", 3, 200, "abc", False, False),
    ("a", 2, "u4", 3, 404, "abc", False, False),
]


@pytest.mark.parametrize("mode,column", [("length_status", 6), ("content", 7)])
def test_duplicates(spark, mode, column):
    rows = spark.createDataFrame(
        [response(u, code=s, content=c, target=t, depth=d) for t, d, u, _, s, c, _, _ in DUPLICATES], readers.RESPONSES
    )
    got = scan.flagged_results(rows, ScanOptions(signature=mode), rules=[])
    flags = {(r.target, r.url): r.is_duplicate_signature for r in got.collect()}
    assert flags == {(d[0], d[2]): d[column] for d in DUPLICATES}


def test_duplicate_errors(spark):
    rows = spark.createDataFrame(
        [response("u1", code=None, error="Timeout", message="1"), response("u2", code=None, error="ValueError", message="2")], readers.RESPONSES
    )
    flags = lambda options: {r.url: r.is_duplicate_signature for r in scan.flagged_results(rows, options, rules=[]).collect()}
    assert flags(ScanOptions()) == {"u1": False, "u2": True}
    assert flags(ScanOptions(dedup_errors=False)) == {"u1": False, "u2": False}


def test_one_signature_for_most_rows_is_not_collected_in_one_task(spark):
    """Half of the rows share a signature: exactly one is first, and no window sorts them."""
    rows = spark.range(20_000).select(
        F.lit("t").alias("target"), (F.col("id") % 7).cast("int").alias("depth"), F.concat(F.lit("u"), "id").alias("url"),
        F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("signature"), F.lit(200).alias("status_code"),
    )
    flagged = dedup.flag_duplicates(rows)
    assert flagged.where("not is_duplicate_signature").count() == 10_001
    assert flagged.where("signature = 'same' and not is_duplicate_signature").first().url == "u0"
    assert "Window" not in flagged._jdf.queryExecution().executedPlan().toString()
    assert dedup.live_rows(flagged).count() == 10_001


def test_signature_counts(spark):
    rows = spark.createDataFrame([("a", "s"), ("a", "s"), ("b", "s")], "target string, signature string")
    assert {(r.target, r.n) for r in dedup.signature_counts(rows).collect()} == {("a", 2), ("b", 1)}


def test_numbered_matches_a_window(spark):
    from pyspark.sql import Window

    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),
        F.xxhash64("id").alias("a"), F.col("id").cast("string").alias("u"),
    ).withColumn("g", F.when(F.col("g") == "g1", F.lit(None)).otherwise(F.col("g")))
    got = numbered(rows, ["a", "u"], ["g"], partitions=16).collect()
    want = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("g").orderBy("a", "u"))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    everything = numbered(rows, ["a", "u"], partitions=7)
    assert [r.ordinal for r in everything.orderBy("a", "u").collect()] == list(range(1, 5001))


def test_scan_stats(spark):
    rows = spark.createDataFrame([("a", 0.5), ("a", 1.5), ("b", 0.0)], "target string, time double")
    got = {r.target: r for r in stats.scan_stats(rows, 1).collect()}
    assert (got["a"].url_count, got["a"].remaining_requests, got["a"].urls_per_second) == (2, 0, 1.0)
    assert (got["b"].total_time, got["b"].urls_per_second) == (0.0, 0.0)


def test_gate(spark):
    options = ScanOptions(scope_mode=3, blacklist_domains=["bad"], whitelist_domains=["good"])
    rows = spark.createDataFrame([response(u) for u in ("http://good/", "http://good/?bad", "http://other/")], readers.RESPONSES)
    got = {r.original_url: r.status for r in results.result_records(scan.gated(rows, options), rules=[]).collect()}
    assert got == {
        "http://good/": "200",
        "http://good/?bad": "Error(Exception): 域名在黑名单中: http://good/?bad",
        "http://other/": "Error(Exception): 域名不在白名单中: http://other/",
    }


def test_report_round_trip(spark, tmp_path):
    content = '<title>a "q", b\nc</title> 1.2.3.4'
    rows = spark.createDataFrame([response("http://h.example.com/a.js", content=content), response("http://h.example.com/b", code=None)], readers.RESPONSES)
    made = report.report_rows(scan.flagged_results(rows))
    assert made.columns == catalog.REPORT_COLUMNS
    writers.write_report(made, str(tmp_path / "r"))
    read = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "r"))
    assert read.columns == catalog.REPORT_HEADER
    back = {r["URL"]: r for r in read.collect()}
    first = back["http://h.example.com/a.js"]
    assert (first["标题"], first["链接类型"], first["敏感信息详细清单"], first["是否重复"]) == ('a "q", bc', "JS", "IP地址:1.2.3.4", "否")
    assert back["http://h.example.com/b"]["状态"] == "Err"
    writers.append_report(made, str(tmp_path / "r"))
    assert spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "r")).count() == 4


def test_report_by_partition(spark, tmp_path):
    rows = spark.createDataFrame([response("http://h.example.com:80/"), response("http://o.example.org/")], readers.RESPONSES)
    found = scan.flagged_results(rows, rules=[]).withColumn("folder", report.report_partition(F.col("url")))
    writers.write_report(report.report_rows(found, "folder"), str(tmp_path / "r"), partition="folder")
    assert {p.name for p in (tmp_path / "r").iterdir() if p.is_dir()} == {"folder=h.example.com", "folder=o.example.org"}


def test_danger_rows(spark):
    options = ScanOptions(danger_keywords=["del"])
    danger = spark.createDataFrame([("http://h.example.com/b/del",), ("http://h.example.com/a.php/DEL.x",)], "url string")
    rows = {r.url: r for r in report.danger_report_rows(danger, options).collect()}
    row = rows["http://h.example.com/b/del"]
    assert (row.status, row.link_type, row.sensitive_types, row.sensitive_details) == ("危险", "危险", "del", "危险接口: del")
    ranked = report.ranked_danger(danger, replace(options, danger_label_ignores_case=False)).orderBy("rank").collect()
    assert [(r.rank, r.danger_types) for r in ranked] == [(1, "未知"), (2, "del")]
    batch = {r.url: r for r in report.report_rows(report.danger_results(danger, options)).collect()}
    row = batch["http://h.example.com/a.php/DEL.x"]
    assert (row.title, row.link_type, row.sensitive_details) == ("危险接口", "X", "del:http://h.example.com/a.php/DEL.x")


def test_empty_summary_is_not_written(spark, tmp_path):
    none = spark.createDataFrame([], "section int, target string, url string")
    assert writers.write_summary(none, str(tmp_path / "s")) is False
    assert not (tmp_path / "s").exists()


def test_options_from_json():
    options = ScanOptions.from_json(
        '{"url_scope_mode": "1", "danger_api_list": ["x"], "danger_filter_enabled": 0, "custom_base_url": "https://e.com/", "fuzz": 1, "delay": 3}'
    )
    assert (options.scope_mode, options.danger_keywords, options.active_danger_keywords) == (1, ("x",), ())
    assert (options.custom_base_urls, options.fuzz, options.max_depth, options.max_urls) == (("https://e.com/",), True, 5, None)
    assert options.extensions == (".css", ".mp4") and len(ScanOptions().extensions) == 32
    with pytest.raises(ValueError):
        ScanOptions(scope_mode=4)


def test_targets(spark, tmp_path):
    (tmp_path / "t.txt").write_text("\t http://a \r\n\n  \nhttp://b\nhttp://a\n")
    assert sorted(r.url for r in readers.targets(spark, str(tmp_path)).collect()) == ["http://a", "http://a", "http://b"]


def test_responses_from_files(spark, tmp_path):
    """JSON files with text, and parquet files with bytes and a charset."""
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"url": "http://a/", "status_code": 200, "content": "x", "headers": {"A": "b"}, "redirects": ["r"]}\n')
    row = readers.responses(spark, str(tmp_path / "j"), "json").first()
    assert (row.original_url, row.content, row.link_text, row.headers, row.redirects) == ("http://a/", "x", "x", {"A": "b"}, ["r"])
    rows = spark.createDataFrame([("http://b/", "标".encode("gbk") + b"\xff", "gbk")], "url string, body binary, charset string")
    rows.write.parquet(str(tmp_path / "p"))
    row = readers.responses(spark, str(tmp_path / "p")).first()
    assert row.content.startswith("标") and "标" not in row.link_text and row.status_code is None


def test_charset_from_headers(spark, tmp_path):
    """A declared charset counts where the row names none; files of ready text need no decoding."""
    body = "标题".encode("gbk")
    rows = spark.createDataFrame(
        [(1, body, None, {"content-type": 'text/html; Charset="GBK"'}), (2, body, "utf-8", {"Content-Type": "text/html; charset=gbk"}),
         (3, "é".encode(), "", {"Content-Type": "text/html"}), (4, "é".encode(), None, None)],
        "depth int, body binary, charset string, headers map<string,string>",
    )
    got = {r.depth: r.content for r in readers.decoded(rows).collect()}
    assert got[1] == "标题" and got[2] != "标题" and got[3] == got[4] == "é"
    spark.createDataFrame([("http://a/", "x")], "url string, content string").write.parquet(str(tmp_path / "t"))
    ready = readers.responses(spark, str(tmp_path / "t"))
    assert (ready.first().content, ready.first().link_text, ready.first().original_url) == ("x", "x", "http://a/")
    assert "_decode_declared(" not in ready._jdf.queryExecution().optimizedPlan().toString()


def test_only_other_charsets_reach_python(spark):
    rows = spark.createDataFrame([(b"x", None)], "body binary, charset string")
    plan = readers.decoded(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN NOT" in plan and plan.count("_decode_declared(") >= 1
