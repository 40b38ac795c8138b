"""Whole scans: start URLs and captured responses in, report rows out."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescan import catalog
from pagescan.operators import filters
from pagescan.operators.dedup import content_hash, flag_duplicates, with_signature
from pagescan.operators.detect import Rule
from pagescan.functions import urls
from pagescan.functions.match import exploded
from pagescan.operators.links import dispositions, link_sets, routed_links
from pagescan.operators.prune import among
from pagescan.operators.report import batch_summary, danger_report_rows, report_partition, report_rows
from pagescan.operators.results import RESULT_COLUMNS, placeholder_rows, result_records
from pagescan.operators.skew import absent, balanced_join, hot_keys
from pagescan.options import SCOPE_DOMAIN, SCOPE_EXTERNAL_ONCE, ScanOptions
from pagescan.plans import walk
from pagescan.sources.readers import RESPONSES, fetched
from pagescan.storage import Workspace


@dataclass(frozen=True)
class Scan:
    """What a scan found: result rows, external rows, dangerous URLs by target."""

    results: DataFrame
    external: DataFrame
    danger: DataFrame
    options: ScanOptions

    def report(self) -> DataFrame:
        """Results, unvisited externals and danger rows (``section`` 1 to 3), with the folder
        that each target's report goes to."""
        sections = [
            report_rows(self.results, "target"),
            report_rows(self.external, "target"),
            danger_report_rows(self.danger, self.options, "target"),
        ]
        parts = [part.withColumn("section", F.lit(number)) for number, part in enumerate(sections, 1)]
        union = parts[0].unionByName(parts[1]).unionByName(parts[2])
        return union.withColumn("folder", report_partition(F.col("target")))

    def summary(self) -> DataFrame:
        return batch_summary(self.results, self.external, self.danger, self.options)


def gated(responses: DataFrame, options: ScanOptions) -> DataFrame:
    """Responses with those a request gate would have refused turned into error rows."""
    refused = filters.request_error(F.col("original_url"), options)
    blocked = refused.isNotNull()
    return responses.withColumns(
        {
            "status_code": F.when(~blocked, F.col("status_code")),
            "error_type": F.when(blocked, "Exception").otherwise(F.col("error_type")),
            "error_message": F.when(blocked, refused).otherwise(F.col("error_message")),
        }
    )


def signed_results(responses: DataFrame, options: ScanOptions = ScanOptions(),
                   rules: Iterable[Rule] | None = None, keep_content: bool = False) -> DataFrame:
    """Result rows with signature."""
    if options.signature == "length_status":
        return with_signature(result_records(responses, rules, options.sample_mode, keep_content))
    hashed = responses.withColumn("content_hash", content_hash(F.col("content")))
    records = result_records(hashed, rules, options.sample_mode, keep_content)
    return with_signature(records, "content_hash").drop("content_hash")


def flagged_results(responses: DataFrame, options: ScanOptions = ScanOptions(),
                    rules: Iterable[Rule] | None = None) -> DataFrame:
    """Result rows with signature and duplicate flag.

    Flagging reads the rows twice, so they are written first: the page text is
    read and searched once.
    """
    space = Workspace(responses.sparkSession, "results")
    signed = space.write(signed_results(responses, options, rules), "signed")
    return flag_duplicates(signed, dedup_errors=options.dedup_errors)


def analysed(responses: DataFrame, options: ScanOptions = ScanOptions(),
             rules: Iterable[Rule] | None = None) -> DataFrame:
    """Signed result rows plus the link sets of each page, in one pass over the text.

    Links are looked for in ``link_text`` if there is such a column, else in
    the content.
    """
    ready = gated(_untargeted(responses), options)
    text = "link_text" if "link_text" in ready.columns else "content"
    records = signed_results(ready, options, rules, keep_content=True)
    if text == "link_text":
        records = records.drop("content").withColumn(
            text, F.when(F.col("status_code").isNotNull(), F.col(text)).otherwise("")
        )
    return link_sets(records, options, "url", text)


def in_reach(responses: DataFrame, start: DataFrame, options: ScanOptions) -> DataFrame:
    """The captures that a walk from the start URLs can ask for.

    Inside a domain these are the pages of the start URLs' domains, and the bundler chunks that a page may name on another host.
    Where everything is in scope, or names are compared without suffix rules, every capture can be asked for.
    """
    if options.scope_mode not in (SCOPE_DOMAIN, SCOPE_EXTERNAL_ONCE) or options.public_suffixes is None:
        return responses

    def domain(name: str) -> Column:
        return urls.registered_domain(F.col(name), options.public_suffixes)

    domains = start.select(F.explode(F.array(domain("target"), domain("url"))).alias("domain"))
    chunk = F.contains("original_url", F.lit("/" + catalog.WEBPACK_DIRECTORY))
    return among(responses, domain("original_url"), domains, "domain", also=chunk)


def scan(targets: DataFrame, responses: DataFrame, options: ScanOptions = ScanOptions(),
         rules: Iterable[Rule] | None = None) -> Scan:
    """Scan start URLs against captured responses.

    ``targets`` holds ``url``; ``responses`` one row per requested URL
    (``original_url``).  The captures that a walk can reach (`in_reach`) are searched in one narrow pass that
    writes records and links; text is never shuffled.  The walk and all joins
    then run on those slim tables.  External pages that are scanned once are searched when they are known.
    """
    space = Workspace(targets.sparkSession, "scan")
    start = walk.seeds(targets)
    pages = space.write(analysed(in_reach(responses, start, options), options, rules), "pages")
    records = pages.drop("full", "resolved", "chunks")
    routed = space.write(
        routed_links(pages.select("original_url", "full", "resolved", "chunks"), options), "links"
    )
    walked = walk.reachable(start, walk.edges_of(routed, options, "original_url"), options, budget=options.max_urls)
    kept, refused = walked, None
    if options.max_urls is not None:
        kept, refused = (walked.where(test).drop("request", "within_budget") for test in ("within_budget", "not within_budget"))
    kept = space.write(kept, "kept")
    signed = space.write(visited_results(kept, records, options), "results")
    results = flag_duplicates(signed, dedup_errors=options.dedup_errors)

    # External and dangerous URLs count for the targets whose walk read the page that holds them.
    read = kept.where(F.col("depth") < options.max_depth).select("target", "url").distinct()
    read = space.write(read, "read")
    either = F.concat("inside", "outside")
    side = routed.where(F.array_contains(either, "external") | F.array_contains(either, "danger"))
    side = side.withColumnRenamed("original_url", "url")
    goal = urls.target_domain(F.col("target"), options.public_suffixes)
    met = balanced_join(read, side, "url", hot_keys(read, "url"), hot_keys(side, "url"), "target", "link")
    found = (
        exploded(met, ["target", "link"], dispositions(goal, options), "disposition")
        .where(F.col("disposition").isin("external", "danger"))
        .select("target", F.col("link").alias("url"), "disposition")
        .distinct()
    )
    found = space.write(found, "found")
    danger = found.where(F.col("disposition") == "danger").select("target", "url")
    outside = found.where(F.col("disposition") == "external").groupBy("url").agg(F.min("target").alias("target"))
    outside = absent(outside, walked.where("depth > 0"), ["url"])
    if options.scope_mode == SCOPE_EXTERNAL_ONCE:
        visits = space.write(outside.select("target", "url", F.lit(0).alias("depth")), "visits")
        asked = _untargeted(among(responses, F.col("original_url"), visits, "url"))
        outside_records = space.write(signed_results(gated(asked, options), options, rules), "outside")
        outer = space.write(visited_results(visits, outside_records, options), "external")
        external = flag_duplicates(outer, dedup_errors=options.dedup_errors)
    else:
        external = placeholder_rows(outside, catalog.EXTERNAL).withColumns(
            {"signature": F.lit(None).cast("string"), "is_duplicate_signature": F.lit(False)}
        )
    columns = [*RESULT_COLUMNS, "signature", "is_duplicate_signature"]
    results = results.select(*columns)
    if refused is not None:
        over = placeholder_rows(refused, catalog.OVER_BUDGET, F.col("depth"))
        results = results.unionByName(
            over.withColumns({"signature": F.lit(None).cast("string"), "is_duplicate_signature": F.lit(False)}).select(*columns)
        )
    return Scan(results, external.select(*columns), danger, options)


def _untargeted(responses: DataFrame) -> DataFrame:
    """Responses without the columns that a walk sets."""
    none = F.lit(None)
    return responses.withColumns({"target": none.cast("string"), "depth": none.cast("int")})


def externals_once(external: DataFrame, responses: DataFrame, options: ScanOptions = ScanOptions(),
                   rules: Iterable[Rule] | None = None) -> DataFrame:
    """Each distinct external URL scanned once and not followed further."""
    space = Workspace(external.sparkSession, "external")
    records = space.write(signed_results(gated(_untargeted(responses), options), options, rules), "records")
    urls_once = external.select("url").distinct()
    visits = urls_once.select(F.lit(None).cast("string").alias("target"), "url", F.lit(0).alias("depth"))
    return visited_results(space.write(visits, "visits"), records, options)


def visited_results(wanted: DataFrame, records: DataFrame, options: ScanOptions) -> DataFrame:
    """Result rows of the wanted (target, url, depth): the page's record, or that none was captured.

    Page text was analysed before, so only slim rows are joined, and a URL
    that several targets reach was analysed once.  Hot URLs are cut into
    slices.  Both inputs should be written tables.
    """
    columns = [*RESULT_COLUMNS, "signature"]
    slim = records.drop("target", "depth").withColumnRenamed("url", "_final").withColumnRenamed("original_url", "url")
    hot = hot_keys(wanted, "url")
    met = balanced_join(wanted, slim, "url", hot, {}, "target", "_final")
    met = met.withColumnRenamed("url", "original_url").withColumnRenamed("_final", "url").select(*columns)
    unseen = absent(wanted.select("url").distinct(), slim, ["url"])
    missing = balanced_join(wanted, unseen, "url", hot, {}, "target", "url")
    nothing = fetched(missing, wanted.sparkSession.createDataFrame([], RESPONSES))
    unknown = signed_results(gated(nothing, options), options, rules=[]).select(*columns)
    return met.unionByName(unknown)
