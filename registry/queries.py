"""The registered queries: name -> function of (session, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescan import catalog
from pagescan.functions import text, urls
from pagescan.functions.match import exploded
from pagescan.operators import dedup, detect, filters, links, report, results, stats
from pagescan.options import ScanOptions
from pagescan.plans import scan, walk
from pagescan.sources import readers
from pagescan.storage import Workspace
from pagescan.streaming import live
from registry.inputs import (
    OPTIONS,
    SUFFIXES,
    documents,
    linked_pages,
    own_domain,
    pages,
    responses,
    rich_pages,
    seeded_documents,
    start_urls,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ROUTES = ScanOptions(
    fuzz=True,
    scope_mode=2,
    custom_base_urls=["https://example.com/"],
    path_routes=["/#/"],
    api_routes=["/gateway/api/v1", "/"],
    extension_blacklist=[".css"],
    public_suffixes=SUFFIXES,
)
GATE = ScanOptions(scope_mode=3, blacklist_domains=["spam-farm"], whitelist_domains=["blog."], public_suffixes=SUFFIXES)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages leak what, and where do they lead?  One row per page.

    One pass over the text writes findings and link sets; the counts come from that table.
    """
    plain = rich_pages(pages(spark, sf_dir)).select(
        "page_id",
        "url",
        text.title_of(F.col("html")).alias("title"),
        F.length("html").alias("length"),
        urls.link_type(F.col("url")).alias("link_type"),
        "html",
    )
    found = detect.with_findings(plain, "html", keep_text=True)
    found = found.withColumn("n_finding_types", F.size("sensitive_raw")).drop("sensitive_raw")
    sets = Workspace(spark, "flagship").write(links.link_sets(found, OPTIONS), "pages")
    routed = links.routed_links(sets.select("page_id", "url", "full", "resolved", "chunks"), OPTIONS)
    placed = exploded(routed, ["page_id"], links.dispositions(own_domain(F.col("url")), OPTIONS), "disposition")
    kinds = ("keep", "external", "danger")
    counts = placed.groupBy("page_id").agg(
        *[F.sum(F.when(F.col("disposition") == k, 1).otherwise(0)).cast("bigint").alias(f"n_{k}") for k in kinds]
    )
    shown = sets.drop("full", "resolved", "chunks").join(counts, "page_id", "left")
    return shown.na.fill(0, [f"n_{k}" for k in kinds])


query(flagship)


# Sources and result records


@query
def targets(spark, sf_dir):
    space = Workspace(spark, "targets")
    lines = pages(spark, sf_dir).select(
        F.explode(F.array(F.concat(F.lit(" \t"), "url", F.lit("  ")), F.lit("   "))).alias("value")
    )
    lines.write.text(space.folder("list"))
    return readers.targets(spark, space.folder("list"))


@query
def responses_joined(spark, sf_dir):
    captured = responses(pages(spark, sf_dir)).withColumn("length", F.length("content")).drop("content")
    frontier = captured.select(F.explode(F.array("url", F.concat("url", F.lit("/missing")))).alias("url"))
    got = readers.fetched(frontier, captured)
    return got.select("original_url", "url", "status_code", "error_type", "length")


QUERIES["responses"] = QUERIES.pop("responses_joined")


@query
def result_record(spark, sf_dir):
    rows = results.result_records(responses(pages(spark, sf_dir)))
    return rows.select(
        "page_id", "url", "status", "title", "length", "redirects", "depth", "time", "content_type", "headers_count",
        "error_type", "original_url",
    )


@query
def header_info(spark, sf_dir):
    headers = F.col("headers")
    return responses(pages(spark, sf_dir)).select(
        "page_id", results.content_type(headers).alias("content_type"), results.header_count(headers).alias("n_headers")
    )


@query
def error_status(spark, sf_dir):
    """Every page's URL as the message of one of eight errors, by page number."""
    names = ["ConnectionError", "SSLError", "ConnectTimeout", "ReadTimeout", "TooManyRedirects", "InvalidURL", "ValueError", "Timeout"]
    rows = pages(spark, sf_dir).select(
        "page_id", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("page_id") % 8 + 1).cast("int")).alias("error_type"), "url"
    )
    status = results.error_status(F.col("error_type"), F.col("url"))
    return rows.select(
        "page_id", status.alias("status"), results.collapsed_status(F.lit(None).cast("int"), status).alias("collapsed")
    )


@query
def status_class(spark, sf_dir):
    rows = results.result_records(responses(pages(spark, sf_dir)))
    return rows.select("page_id", results.status_class(F.col("status_code"), F.col("status")).alias("status_class"))


@query
def title(spark, sf_dir):
    return responses(pages(spark, sf_dir)).select(
        "page_id", results.title(F.col("status_code"), F.col("content")).alias("title")
    )


@query
def decode_body(spark, sf_dir):
    """Pages as bytes in four ways: UTF-8, UTF-8 with a broken byte, ISO-8859-1 and UTF-16."""
    html, slot = F.col("html"), F.col("page_id") % 4
    names = F.array(F.lit("utf-8"), F.lit("utf-8"), F.lit("iso-8859-1"), F.lit("utf-16"))
    rows = pages(spark, sf_dir).select(
        "page_id",
        F.when(slot == 1, F.concat(F.encode(html, "UTF-8"), F.unhex(F.lit("C328"))))
        .when(slot == 2, F.encode(F.regexp_replace(html, r"[^\x00-\xff]", "?"), "ISO-8859-1"))
        .when(slot == 3, F.encode(html, "UTF-16"))
        .otherwise(F.encode(html, "UTF-8"))
        .alias("body"),
        F.element_at(names, (slot + 1).cast("int")).alias("charset"),
    )
    body = F.col("body")
    return rows.select(
        "page_id",
        "charset",
        F.length(text.decode_body(body, F.col("charset"))).alias("length"),
        F.length(text.text_for_links(body)).alias("link_text_length"),
        text.longest_title(text.decoded_candidates()(body)).alias("title"),
    )


@query
def decode_declared(spark, sf_dir):
    """Pages as bytes in a declared charset, decoded for detection and for links."""
    html, slot = F.col("html"), F.col("page_id") % 4
    names = F.array(F.lit("UTF-8"), F.lit(None), F.lit("utf-16"), F.lit("iso-8859-15"))
    rows = pages(spark, sf_dir).select(
        "page_id",
        F.when(slot == 1, F.concat(F.encode(html, "UTF-8"), F.unhex(F.lit("C328"))))
        .when(slot == 2, F.encode(html, "UTF-16"))
        .when(slot == 3, F.encode(F.regexp_replace(html, r"[^\x00-\x7f]", "?"), "US-ASCII"))
        .otherwise(F.encode(html, "UTF-8"))
        .alias("body"),
        F.element_at(names, (slot + 1).cast("int")).alias("charset"),
    )
    return readers.decoded(rows).select(
        "page_id",
        F.md5("content").alias("content"),
        F.when(slot != 2, F.md5("link_text")).alias("link_text"),
    )


# URLs


@query
def url_valid(spark, sf_dir):
    url = F.col("url")
    place = urls.netloc(url)
    made = F.array(
        url,
        F.concat(F.lit("FTP://"), place, F.lit("/a")),
        F.concat(F.lit("gopher://"), place),
        F.concat(F.lit("http://localhost/"), F.col("page_id").cast("string")),
        F.concat(F.lit("http://"), place, F.lit(":0/")),
        F.concat(F.lit("http://"), place, F.lit(":"), (F.col("page_id") + 65530).cast("string"), F.lit("/")),
        F.concat(F.lit("http://"), place, F.lit(":abc/")),
        F.concat(F.lit("http://u:p@"), place, F.lit(":99999/")),
        F.concat(F.lit("http://"), F.substring(place, 1, 3), F.lit(".x/")),
        F.concat(url, F.repeat(F.lit("a"), 2048 - F.length(url) + (F.col("page_id") % 2).cast("int"))),
        F.concat(F.lit(" "), url, F.lit("  ")),
        F.lit("  "),
    )
    rows = pages(spark, sf_dir).select("page_id", F.posexplode(made).alias("case_no", "candidate"))
    return rows.select("page_id", "case_no", F.md5("candidate").alias("candidate"), urls.is_valid(F.col("candidate")).alias("valid"))


@query
def link_type(spark, sf_dir):
    url = F.col("url")
    rows = pages(spark, sf_dir).select(
        "page_id",
        F.explode(F.array(url, F.concat(F.lit("https://"), urls.netloc(url)), F.concat(url, F.lit("/a.js?v=1.2")), F.lit(""))).alias("link"),
    )
    return rows.select("page_id", "link", urls.link_type(F.col("link")).alias("link_type"))


@query
def resolve_links(spark, sf_dir):
    refs = [
        "//c.example.com/x{id}", "#/r{id}", "/x{id}", "//", "./x{id}", ".//x{id}", "../s/{id}.js", "../x/../y{id}/",
        "../../../x{id}?a=../b", "https://o.example.org/{id}", "c//d{id}", "?q={id}", "#top{id}", "a/./b/../{id}", "..",
        ".", "", "a/../../../{id}", "ws://w.example.com//s{id}", "foo:bar{id}", "x{id}?y#z",
    ]
    number = F.col("page_id").cast("string")
    rows = pages(spark, sf_dir).select(
        "page_id",
        "url",
        F.posexplode(F.array(*[F.replace(F.lit(r), F.lit("{id}"), number) for r in refs])).alias("case_no", "rel"),
    )
    found = rows.select("page_id", "case_no", urls.resolve(urls.Base.of(F.col("url")), F.col("rel")).alias("link"))
    return found.where(urls.is_valid(F.col("link")))


@query
def route_expand(spark, sf_dir):
    raw = links.raw_links(pages(spark, sf_dir), sources=["dom"])
    return links.resolved_links(raw, ROUTES).select("page_id", "link").distinct()


@query
def clean_links(spark, sf_dir):
    forms = [
        "/für{id}", "/the,{id}", "javascript:x{id}", "mailto:a{id}", "data:{id}", "tel:{id}", '"x{id}', "  ", "",
        "\\/a\\/b{id}", "/a?b=1&amp;c={id}", "//h.example.com/{id}", "\\\\", "~x-{id}_%41", " /lead{id}",
    ]
    number = F.col("page_id").cast("string")
    rows = pages(spark, sf_dir).select(
        "page_id",
        urls.scheme(F.col("url")).alias("scheme"),
        F.posexplode(F.array(*[F.replace(F.lit(f), F.lit("{id}"), number) for f in forms])).alias("case_no", "raw"),
    )
    cleaned = rows.withColumn("cleaned", links.clean(F.col("raw")))
    return cleaned.select(
        "page_id", "case_no", "cleaned", links.prepare(F.col("cleaned"), F.col("scheme")).alias("ready")
    ).where(F.col("cleaned").isNotNull())


# Extraction


@query
def extract_links(spark, sf_dir):
    found = links.page_links(rich_pages(pages(spark, sf_dir)), replace(OPTIONS, danger_filter=False))
    return links.kept_links(found).select("page_id", "link")


@query
def link_disposition(spark, sf_dir):
    return links.page_links(rich_pages(pages(spark, sf_dir)), OPTIONS).select("page_id", "link", "disposition")


@query
def tag_links(spark, sf_dir):
    found = links.raw_links(rich_pages(pages(spark, sf_dir)), sources=["tag"])
    return found.where(F.col("cleaned").isNotNull()).select("page_id", "raw", "cleaned")


@query
def dom_links(spark, sf_dir):
    return links.raw_links(rich_pages(pages(spark, sf_dir)), sources=["dom"]).select("page_id", "raw", "cleaned")


@query
def webpack_links(spark, sf_dir):
    rows = links.with_features(rich_pages(pages(spark, sf_dir)))
    found = links.webpack_urls("html", "low", urls.Base.of(F.col("url")))
    return exploded(rows, ["page_id"], found, "link")


@query
def pattern_counts(spark, sf_dir):
    return links.pattern_counts(rich_pages(pages(spark, sf_dir)))


@query
def external_links(spark, sf_dir):
    return links.external_links(links.page_links(linked_pages(pages(spark, sf_dir)), OPTIONS))


@query
def link_stats(spark, sf_dir):
    plain = pages(spark, sf_dir)
    # Written first: the counts read the links three times, the pages are searched once.
    found = Workspace(spark, "links").write(links.page_links(linked_pages(plain), OPTIONS), "links")
    return stats.link_stats(found, plain.select("url"))


# Filters


@query
def ext_filter(spark, sf_dir):
    return pages(spark, sf_dir).select(
        "page_id", filters.has_extension(F.col("url"), OPTIONS.extensions).alias("blocked")
    )


@query
def scope_filter(spark, sf_dir):
    """Every page's URL and a sister host against the domain of another page, in all scope modes."""
    plain = pages(spark, sf_dir).select("page_id", "url")
    others = plain.select(F.col("page_id").alias("other"), own_domain(F.col("url")).alias("target"))
    count = plain.agg(F.count("*")).scalar()
    rows = plain.withColumn("other", (7 * F.col("page_id") + 1) % count).join(others, "other")
    rows = rows.select("page_id", "target", F.explode(F.array("url", F.concat(F.lit("http://blog.spam-farm."), urls.host(F.col("url")), F.lit(".co.uk/")))).alias("link"))
    modes = [
        filters.in_scope(F.col("link"), F.col("target"), replace(GATE, scope_mode=mode)).alias(f"scope_{mode}")
        for mode in range(4)
    ]
    return rows.select("page_id", "link", "target", *modes)


@query
def request_gate(spark, sf_dir):
    rows = results.result_records(scan.gated(responses(pages(spark, sf_dir)), GATE))
    return rows.select("page_id", "original_url", "status", "error_type")


@query
def danger_links(spark, sf_dir):
    return links.danger_links(links.page_links(rich_pages(pages(spark, sf_dir)), OPTIONS))


@query
def danger_types(spark, sf_dir):
    found = danger_links(spark, sf_dir)
    exact = replace(OPTIONS, danger_label_ignores_case=False)
    return found.select(
        "url", report.danger_types(F.col("url"), OPTIONS).alias("types"), report.danger_types(F.col("url"), exact).alias("exact_types")
    )


@query
def danger_rank(spark, sf_dir):
    return report.ranked_danger(danger_links(spark, sf_dir), OPTIONS)


@query
def danger_report(spark, sf_dir):
    return report.danger_report_rows(danger_links(spark, sf_dir), OPTIONS)


# Detection


def _joined_samples(found: DataFrame, key: str) -> DataFrame:
    return found.select(key, "ord", "rule", "type", "count", "total", F.array_join("samples", "; ").alias("samples"))


@query
def findings(spark, sf_dir):
    return _joined_samples(detect.findings(documents(spark, sf_dir).select("doc_id", "text")), "doc_id")


@query
def page_findings(spark, sf_dir):
    return _joined_samples(detect.findings(pages(spark, sf_dir).select("page_id", "html"), "html"), "page_id")


@query
def findings_all_rules(spark, sf_dir):
    """Documents with a made-up secret for every rule."""
    return _joined_samples(detect.findings(seeded_documents(documents(spark, sf_dir))), "doc_id")


@query
def findings_whole_match(spark, sf_dir):
    """The same, reporting whole matches instead of captured groups."""
    return _joined_samples(detect.findings(seeded_documents(documents(spark, sf_dir)), mode="match"), "doc_id")


@query
def findings_custom(spark, sf_dir):
    """A user's rules, hundreds of them and one that does not compile: the beginning of each benchmark item and what follows it."""
    beginning = F.regexp_replace(F.substring("text", 1, 16), r"([!-/:-@\[-`{-~])", r"\\$1")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) >= 16").select(
        F.col("item_id").alias("ord"), F.concat(F.lit("item "), "item_id").alias("type"),
        F.concat(F.lit("("), beginning, F.lit(r"[a-z]*)([ .]?)")).alias("pattern"),
    )
    bad = items.agg((F.min("ord") - 1).alias("ord")).select("ord", F.lit("bad").alias("type"), F.lit("(").alias("pattern"))
    rules = detect.custom_rules(items.unionByName(bad))
    return _joined_samples(detect.findings(documents(spark, sf_dir).select("doc_id", "text"), rules=rules), "doc_id")


@query
def finding_types(spark, sf_dir):
    return detect.finding_types(documents(spark, sf_dir).select("doc_id", "text"))


@query
def findings_flat(spark, sf_dir):
    rows = detect.with_findings(documents(spark, sf_dir).select("doc_id", "text"))
    types, counts, details = detect.flat(F.col("sensitive_raw"))
    return rows.select(
        "doc_id", types.alias("sensitive_types"), counts.alias("sensitive_counts"), details.alias("sensitive_details")
    )


@query
def findings_summary(spark, sf_dir):
    rows = detect.with_findings(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", detect.summary(F.col("sensitive_raw")).alias("summary"))


# Duplicates


@query
def signature_counts(spark, sf_dir):
    signed = dedup.with_signature(results.result_records(responses(pages(spark, sf_dir))))
    return dedup.signature_counts(signed)


@query
def dup_flag(spark, sf_dir):
    signed = dedup.with_signature(results.result_records(responses(pages(spark, sf_dir))))
    slim = signed.select("page_id", "target", "depth", "url", "signature", "status_code")
    # Written first: flagging reads the rows twice, the page text is read once.
    slim = Workspace(spark, "signed").write(slim, "rows")
    return dedup.flag_duplicates(slim).select("page_id", "signature", "is_duplicate_signature")


@query
def dup_content(spark, sf_dir):
    """Exact copies among the documents: signature with content hash, one scan per source."""
    rows = documents(spark, sf_dir).select(
        "doc_id",
        F.col("source").alias("target"),
        dedup.signature(F.length("text"), F.lit("200"), dedup.content_hash(F.col("text"))).alias("signature"),
    )
    rows = Workspace(spark, "signed").write(rows, "rows")
    return dedup.flag_duplicates(rows, order=["doc_id"], key=["doc_id"])


@query
def dup_redirect(spark, sf_dir):
    """Duplicate flags where redirects lead many requests to one URL and some pages were captured twice."""
    i = F.col("page_id")
    rows = responses(pages(spark, sf_dir))
    rows = rows.withColumn("url", F.when(i % 5 == 1, F.concat(F.lit("http://r.example.com/"), i % 3)).otherwise(F.col("url")))
    # Half of the redirected bodies are alike.
    rows = rows.withColumn("content", F.when(i % 10 == 1, F.lit("<p>moved</p>")).otherwise(F.col("content")))
    rows = rows.withColumns({"target": F.lit("t"), "depth": (i % 2).cast("int")})
    twice = rows.unionByName(rows.where(i % 11 == 0))
    signed = dedup.with_signature(results.result_records(twice, rules=[]))
    signed = signed.select("page_id", "target", "depth", "url", "original_url", "signature", "status_code")
    signed = Workspace(spark, "signed").write(signed, "rows")
    return dedup.flag_duplicates(signed).select("page_id", "url", "original_url", "signature", "is_duplicate_signature")


@query
def live_rows(spark, sf_dir):
    flagged = scan.flagged_results(responses(pages(spark, sf_dir)), OPTIONS, rules=[])
    return dedup.live_rows(flagged).select("target", "url", "depth", "signature")


# Reports


@query
def report_rows(spark, sf_dir):
    return report.report_rows(scan.flagged_results(responses(pages(spark, sf_dir)), OPTIONS))


QUERIES["report"] = QUERIES.pop("report_rows")


@query
def report_union(spark, sf_dir):
    plain = pages(spark, sf_dir)
    main = scan.flagged_results(responses(plain), OPTIONS, rules=[])
    found = links.external_links(links.page_links(linked_pages(plain), OPTIONS))
    more = results.placeholder_rows(found, catalog.EXTERNAL)
    return report.report_rows(main).unionByName(report.report_rows(more))


@query
def report_partition(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", report.report_partition(F.concat("url", F.lit(":80"))).alias("folder"))


@query
def scan_stats(spark, sf_dir):
    rows = results.result_records(responses(pages(spark, sf_dir)))
    found = stats.scan_stats(rows, OPTIONS.max_urls)
    return found.withColumns({c: F.round(c, 6) for c in ("total_time", "urls_per_second")})


# Walks


def _edges(spark: SparkSession, sf_dir: str, options: ScanOptions) -> DataFrame:
    return walk.link_edges(linked_pages(pages(spark, sf_dir)), options)


@query
def reachable(spark, sf_dir):
    options = replace(OPTIONS, scope_mode=2, share_visited=False, danger_filter=False)
    return walk.reachable(walk.seeds(start_urls(pages(spark, sf_dir))), _edges(spark, sf_dir, options), options)


@query
def reachable_domain(spark, sf_dir):
    options = replace(OPTIONS, max_depth=5)
    return walk.reachable(walk.seeds(start_urls(pages(spark, sf_dir))), _edges(spark, sf_dir, options), options)


@query
def budget(spark, sf_dir):
    rows = results.result_records(responses(pages(spark, sf_dir))).select("target", "depth", "url")
    return walk.within_budget(rows, OPTIONS.max_urls)


@query
def walk_budget(spark, sf_dir):
    """Walks of seven requests a target, which end in the middle of a level."""
    options = replace(OPTIONS, scope_mode=2, danger_filter=False)
    return walk.reachable(walk.seeds(start_urls(pages(spark, sf_dir))), _edges(spark, sf_dir, options), options, budget=7)


@query
def scan_budget(spark, sf_dir):
    """A whole scan of three requests a target."""
    plain = linked_pages(pages(spark, sf_dir))
    done = scan.scan(start_urls(pages(spark, sf_dir)), responses(plain).drop("page_id"), replace(OPTIONS, max_urls=3), rules=[])
    return done.results.select("target", "url", "depth", "status", "is_duplicate_signature")


@query
def external_once(spark, sf_dir):
    plain = pages(spark, sf_dir)
    found = links.external_links(links.page_links(linked_pages(plain), replace(OPTIONS, scope_mode=1)))
    rows = scan.externals_once(found, responses(plain).drop("page_id"), OPTIONS, rules=[])
    return rows.select("original_url", "status", "title", "length", "depth")


@query
def external_unvisited(spark, sf_dir):
    """External links of all pages except those that answered with 200 themselves."""
    plain = pages(spark, sf_dir)
    found = links.external_links(links.page_links(linked_pages(plain), OPTIONS))
    visited = responses(plain).where(F.col("status_code") == 200).select("url")
    return report.report_rows(walk.externals_unvisited(found, visited, catalog.EXTERNAL))


@query
def batch_summary(spark, sf_dir):
    plain = linked_pages(pages(spark, sf_dir))
    options = replace(OPTIONS, max_depth=2, max_urls=None)
    done = scan.scan(start_urls(pages(spark, sf_dir)), responses(plain).drop("page_id"), options)
    return done.summary()


@query
def scan_bad_targets(spark, sf_dir):
    """Start URLs that are none, next to those of a scan: each gets a row that says nothing came back, and the others go on."""
    starts = start_urls(pages(spark, sf_dir))
    bad = starts.select(F.explode(F.array(F.concat(F.lit("no url "), urls.netloc(F.col("url"))), F.concat(F.lit("http://gone."), urls.netloc(F.col("url"))))).alias("url"))
    done = scan.scan(starts.unionByName(bad), responses(linked_pages(pages(spark, sf_dir))).drop("page_id"), replace(OPTIONS, max_depth=1, max_urls=None), rules=[])
    return done.results.select("target", "url", "depth", "status", "length")


@query
def scan_one_domain(spark, sf_dir):
    """A scan from one start URL: only the captures of its domain are searched."""
    first = start_urls(pages(spark, sf_dir)).agg(F.min("url").alias("url"))
    done = scan.scan(first, responses(linked_pages(pages(spark, sf_dir))).drop("page_id"), replace(OPTIONS, max_urls=None), rules=[])
    return done.results.select("target", "url", "depth", "status", "length", "is_duplicate_signature")


# Streams


def _stream(spark: SparkSession, sf_dir: str, name: str, batches: int = 4) -> DataFrame:
    """A table as the files of several batches, as many for each core in a batch as its text needs."""
    path, cores = f"{sf_dir}/{name}.parquet", spark.sparkContext.defaultParallelism
    rows, width = spark.read.parquet(path), cores * -(-readers.text_parts(spark, path) // (batches * cores))
    space = Workspace(spark, "arriving")
    space.write(rows.repartition(batches * width, rows.columns[0]), name)
    return live.page_stream(spark, space.folder(name), rows.schema, max_files=width)


@query
def stream_live_rows(spark, sf_dir):
    rows = live.signed_results(responses(_stream(spark, sf_dir, "pages")), rules=[]).select("target", "signature")
    return live.run_firsts(rows, Workspace(spark, "stream"), ["target", "signature"])


@query
def stream_dup_flag(spark, sf_dir):
    signed = dedup.with_signature(results.result_records(responses(_stream(spark, sf_dir, "pages")), rules=[]))
    flagged = live.run_flagged(signed.select("target", "depth", "url", "signature", "status_code"), Workspace(spark, "stream"))
    return flagged.groupBy("target", "signature").agg(
        F.count("*").alias("n"), F.sum(F.col("is_duplicate_signature").cast("bigint")).alias("n_duplicates")
    )


@query
def stream_dup_untargeted(spark, sf_dir):
    """Duplicate flags across batches where a part of the rows has no target."""
    signed = dedup.with_signature(results.result_records(responses(_stream(spark, sf_dir, "pages")), rules=[]))
    signed = signed.withColumn("target", F.when(F.col("page_id") % 3 != 0, F.col("target")))
    flagged = live.run_flagged(signed.select("target", "depth", "url", "signature", "status_code"), Workspace(spark, "stream"))
    return flagged.groupBy("target", "signature").agg(
        F.count("*").alias("n"), F.sum(F.col("is_duplicate_signature").cast("bigint")).alias("n_duplicates")
    )


@query
def stream_dup_redirect(spark, sf_dir):
    """Duplicate flags across batches where redirects lead many requests to one URL."""
    rows, i = responses(_stream(spark, sf_dir, "pages")), F.col("page_id")
    rows = rows.withColumn("url", F.when(i % 5 == 1, F.concat(F.lit("http://r.example.com/"), i % 3)).otherwise(F.col("url")))
    rows = rows.withColumns({"content": F.when(i % 10 == 1, F.lit("<p>moved</p>")).otherwise(F.col("content")), "target": F.lit("t")})
    signed = live.signed_results(rows, rules=[]).select("target", "depth", "url", "original_url", "signature", "status_code")
    flagged = live.run_flagged(signed, Workspace(spark, "stream"))
    return flagged.groupBy("signature").agg(
        F.count("*").alias("n"), F.sum(F.col("is_duplicate_signature").cast("bigint")).alias("n_duplicates")
    )


@query
def stream_findings(spark, sf_dir):
    found = live.live_findings(_stream(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return live.run_to(found.select("doc_id", "rule", "count"), Workspace(spark, "stream"), "findings")


@query
def stream_new_links(spark, sf_dir):
    rows = live.kept_links(rich_pages(_stream(spark, sf_dir, "pages")), OPTIONS)
    return live.run_firsts(rows, Workspace(spark, "stream"), ["url"])
