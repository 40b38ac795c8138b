"""Level-by-level walk over the link graph of captured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescan import catalog
from pagescan.functions import urls
from pagescan.functions.match import contains_any
from pagescan.operators import filters
from pagescan.operators.links import dispositions, link_sets, routed_links
from pagescan.operators.ranking import numbered
from pagescan.operators.results import placeholder_rows
from pagescan.operators.skew import HOT_ROWS, absent, balanced_join, hot_keys
from pagescan.options import SCOPE_ALL, ScanOptions
from pagescan.storage import Workspace

_LEVEL = "target string, domain string, url string, request bigint, within_budget boolean"


def seeds(targets: DataFrame) -> DataFrame:
    """One start row per target URL at depth 0; the target is named by its URL."""
    return targets.select(F.col("url").alias("target"), "url", F.lit(0).alias("depth")).distinct()


def link_edges(pages: DataFrame, options: ScanOptions, url: str = "url", text: str = "html") -> DataFrame:
    """Edges of captured pages; their text is scanned once for all targets and levels."""
    sets = link_sets(pages.select(F.col(url).alias("src_url"), text), options, "src_url", text)
    return edges_of(routed_links(sets, options), options)


def edges_of(routed: DataFrame, options: ScanOptions, src: str = "src_url") -> DataFrame:
    """Edges (src_url, dst_url, dst_domain, always) that a walk may follow.

    Whether the destination is inside depends on the target in scope modes 0
    and 1: edges then carry its domain and the walk tests it, except for
    those that no scope holds back (``always``).
    """
    if options.scope_mode >= SCOPE_ALL:
        followed = F.array_contains(dispositions(F.lit(None).cast("string"), options), "keep")
        always = F.lit(True)
    else:
        listed = contains_any(F.col("place"), options.blacklist_domains)
        followed = F.array_contains("inside", "keep") & (F.col("chunk") | ~listed)
        always = F.col("chunk")
    domain = F.col("place") if options.public_suffixes is None else F.col("domain")
    return routed.where(followed).select(
        F.col(src).alias("src_url"), F.col("link").alias("dst_url"), domain.alias("dst_domain"), always.alias("always")
    )


def with_domain(edges: DataFrame, options: ScanOptions) -> DataFrame:
    """Ready-made edges (src_url, dst_url) with what the scope test needs."""
    return edges.withColumns(
        {
            "dst_domain": urls.target_domain(F.col("dst_url"), options.public_suffixes),
            "always": F.lit(options.scope_mode >= SCOPE_ALL),
        }
    )


def _inside(options: ScanOptions) -> Column:
    place, domain = F.col("dst_domain"), F.col("domain")
    same = place == domain
    if options.public_suffixes is None:
        same = same | F.endswith(place, F.concat(F.lit("."), domain))
    return F.col("always") | same


def reachable(start: DataFrame, edges: DataFrame, options: ScanOptions = ScanOptions(),
              hot_rows: int = HOT_ROWS, budget: int | None = None) -> DataFrame:
    """URLs each target's walk scans, with the depth of their first discovery.

    All targets advance together, one level per round, down to ``max_depth``.  A start URL is scanned at depth 0
    and once more if a page links to it.  With ``share_visited`` a URL belongs
    to the first target that finds it (lowest depth, then target).

    With a ``budget`` each target has so many requests: the URLs of a level are numbered on from those of the levels
    before, in URL order (``request``), and those past the budget are refused (``within_budget``): they count as
    visited but nothing they link to is found through them.  What the black or white list refuses is no request.

    Each level is written to the shared folder, which cuts the plan and lets a
    lost executor read it again.  Hot sources and hot frontier URLs are cut
    into slices before the join.  Without shared visits or a budget a level has a row for each URL with the set of targets
    that reach it (`_reachable_bits`).
    """
    spark = start.sparkSession
    space = Workspace(spark, "walk")
    edges = space.write(edges.select("src_url", "dst_url", "dst_domain", "always"), "edges")
    edges = edges.withColumnRenamed("src_url", "url")
    edges_hot = hot_keys(edges, "url", hot_rows)
    owner = ["url"] if options.share_visited else ["target", "url"]
    if not options.share_visited and budget is None and (options.scope_mode >= SCOPE_ALL or options.public_suffixes is not None):
        return _reachable_bits(space, start, edges, edges_hot, options, hot_rows)
    ration = _Ration(space, budget, options)

    def level(depth: int) -> str:
        return space.folder(f"levels/depth={depth}")

    def levels() -> DataFrame:
        folder = space.folder("levels")
        return spark.read.schema(f"{_LEVEL}, depth int").option("basePath", folder).parquet(folder)

    first = start.select(
        "target", urls.target_domain(F.col("target"), options.public_suffixes).alias("domain"), "url"
    )
    ration.numbered(first).write.mode("overwrite").parquet(level(0))
    for depth in range(1, options.max_depth + 1):
        before = spark.read.schema(_LEVEL).parquet(level(depth - 1))
        ration.spend(before, depth - 1)
        frontier = before.where("within_budget").select("target", "domain", "url")
        if frontier.isEmpty():
            break
        # With shared visits a URL is in one frontier once.
        frontier_hot = {} if options.share_visited else hot_keys(frontier, "url", hot_rows)
        found = balanced_join(frontier, edges, "url", frontier_hot, edges_hot, "target", "dst_url").where(
            _inside(options)
        )
        new = found.groupBy(*[F.col("dst_url").alias("url") if c == "url" else F.col(c) for c in owner]).agg(
            F.min(F.struct("target", "domain")).alias("by")
        )
        if depth > 1:
            new = absent(new, levels().where(F.col("depth") > 0), owner)
        ration.numbered(new.select("by.target", "by.domain", "url")).write.mode("overwrite").parquet(level(depth))
    return levels().select("target", "url", "depth", *([] if budget is None else ["request", "within_budget"]))


_BITS = 64


def _reachable_bits(space: Workspace, start: DataFrame, edges: DataFrame, edges_hot: dict[str, int], options: ScanOptions, hot_rows: int) -> DataFrame:
    """A walk whose levels hold, for each URL and word of 64 targets, one bit a target.

    Targets that are at the same URL go on together: a level is as long as its URLs are many, times the words.  Edges are followed once
    for all of them, arrivals are combined by OR, and what was visited before is taken away by AND NOT; in a scope each edge lets the bits of
    its domain's targets through.  Pairs of target and URL come apart at the end only.
    """
    first = start.select("target", urls.target_domain(F.col("target"), options.public_suffixes).alias("domain"), "url").distinct()
    n = F.col("n") - 1
    targets = numbered(first.select("target", "domain").distinct(), ["target"], name="n").select(
        "target", "domain", n.alias("n"), F.floor(n / _BITS).alias("word"), F.expr(f"shiftleft(1L, cast((n - 1) % {_BITS} as int))").alias("own")
    )
    targets = space.write(targets, "targets")
    doors = space.write(targets.groupBy("domain", "word").agg(F.bit_or("own").alias("let")), "doors")
    named = targets.select(F.col("target").alias("_target"), "word", "own")
    level = first.join(named, F.col("target").eqNullSafe(F.col("_target"))).groupBy("url", "word").agg(F.bit_or("own").alias("bits"))
    level = space.write(level, "bits0")
    levels, visited = level.withColumn("depth", F.lit(0)), None
    for depth in range(1, options.max_depth + 1):
        if level.isEmpty():
            break
        found = balanced_join(level, edges, "url", hot_keys(level, "url", hot_rows), edges_hot, "word", "dst_url")
        if options.scope_mode < SCOPE_ALL:
            door = doors.withColumnRenamed("domain", "dst_domain")
            let_in = F.col("bits").bitwiseAND(F.coalesce("let", F.lit(0).cast("bigint")))
            found = found.join(door, ["dst_domain", "word"], "left").withColumn("bits", F.when(F.col("always"), F.col("bits")).otherwise(let_in))
        new = found.where("bits <> 0").groupBy(F.col("dst_url").alias("url"), "word").agg(F.bit_or("bits").alias("bits"))
        if visited is not None:
            # Above the aggregate, on one row for each URL and word.
            seen = visited.withColumnRenamed("bits", "seen")
            left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("bigint"))))
            new = new.join(seen, ["url", "word"], "left").select("url", "word", left.alias("bits")).where("bits <> 0")
        level = space.write(new, f"bits{depth}")
        levels = levels.unionByName(level.withColumn("depth", F.lit(depth)))
        if depth < options.max_depth:
            both = level if visited is None else visited.unionByName(level).groupBy("url", "word").agg(F.bit_or("bits").alias("bits"))
            visited = space.write(both, f"visited{depth}")
    places = F.filter(F.sequence(F.lit(0), F.lit(_BITS - 1)), lambda i: F.call_function("bit_get", F.col("bits"), i) == 1)
    apart = levels.select("url", "depth", "word", F.explode(places).alias("bit")).withColumn("n", F.col("word") * _BITS + F.col("bit"))
    return apart.join(targets.select("n", "target"), "n").select("target", "url", "depth")


class _Ration:
    """What each target has spent of its budget so far."""

    def __init__(self, space: Workspace, budget: int | None, options: ScanOptions):
        self.space, self.budget, self.options = space, budget, options
        self.spent: DataFrame | None = None

    def numbered(self, rows: DataFrame) -> DataFrame:
        """A level's rows with their request numbers; those past the budget are refused."""
        if self.budget is None:
            return rows.withColumns({"request": F.lit(None).cast("bigint"), "within_budget": F.lit(True)})
        asks = filters.request_error(F.col("url"), self.options).isNull()
        rows = numbered(rows.withColumn("_asks", asks), ["url"], ["target", "_asks"], "request")
        request = F.col("request")
        if self.spent is not None:
            rows = rows.join(self.spent, "target", "left")
            request = request + F.coalesce("spent", F.lit(0))
        request = F.when(F.col("_asks"), request)
        return rows.select("target", "domain", "url", request.alias("request"), (~F.col("_asks") | (request <= self.budget)).alias("within_budget"))

    def spend(self, level: DataFrame, depth: int) -> None:
        """Count the requests of a written level; one row per target."""
        if self.budget is not None:
            counts = level.groupBy("target").agg(F.max("request").alias("spent")).where("spent is not null")
            if self.spent is not None:
                counts = self.spent.unionByName(counts).groupBy("target").agg(F.max("spent").alias("spent"))
            self.spent = self.space.write(counts, f"spent{depth}")


def within_budget(rows: DataFrame, max_urls: int | None, by: list[str] = ["target"],
                  order: list[str] = ["depth", "url"]) -> DataFrame:
    """Rows with their request number; past ``max_urls`` per target ``within_budget``
    is false and ``refused`` says why.  Without a budget all are within it."""
    within = F.lit(True) if max_urls is None else F.col("request") <= max_urls
    return numbered(rows, order, by, "request").withColumns(
        {"within_budget": within, "refused": F.when(~within, catalog.OVER_BUDGET)}
    )


def externals_unvisited(external: DataFrame, visited: DataFrame, label: str) -> DataFrame:
    """Placeholder rows for external URLs that no walk visited."""
    return placeholder_rows(absent(external.select("url").distinct(), visited, ["url"]), label)
