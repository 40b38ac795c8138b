"""Link extraction, cleaning, resolution and routing.

All of it is narrow: a page's candidates are collected into arrays, made
distinct inside the row, resolved against the page URL and exploded once, so
the page text is read in one stage and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescan import catalog
from pagescan.functions import urls
from pagescan.functions.match import (
    NO_MATCHES,
    all_matches,
    all_matches_sql,
    captured_sql,
    contains_any,
    exploded,
    folded,
    group_count,
    guarded_sql,
    java_regex,
    let,
)
from pagescan.functions.text import decode_entities, hide_inactive
from pagescan.operators import filters
from pagescan.options import ScanOptions

# Substrings, in lower case, of which every match of a pattern holds at least one.
_NEEDLES = {
    "quoted_escaped": ("\\/",),
    "backquoted_absolute": ("`/",),
    "quoted_dotted": ("./",),
    "any_quote_dotted": ("./",),
    "backquoted_dotted": ("`.",),
    "link_attribute": ("href", "src", "action"),
    "assets_file": ("assets/",),
    "quoted_url": ("//",),
    "css_url": ("url(",),
    "verb_call": (".get(", ".post(", ".put(", ".delete(", ".patch(", ".options(", ".head(", ".connect("),
    "window_location": ("window.location",),
    "window_open": ("window.open(",),
    "fetch_call": ("fetch(",),
    "axios_call": ("axios.",),
    "src_assignment": (".src",),
    "href_assignment": (".href",),
    "action_assignment": (".action",),
    "json_url": ("url",),
    "json_src_href": ("src", "href"),
    "template_url": ("`http",),
    "template_path": ("`/", "`."),
    "router_push": ("router.push(", "router.replace("),
    "route_element": ("<route",),
    "api_version": ("/api/v",),
    "server_page": (".php", ".aspx", ".jsp"),
    "call_argument": (".get", ".post", ".ajax", "fetch"),
    "data_interface": ("datainterface",),
    "jquery_call": ("$.get", "$.post", "$.ajax"),
    "template_any": ("`http", "`/", "`."),
    "router_add": ("router.addroute",),
    "require_call": ("require",),
    "import_call": ("import",),
}

# Shared tests, made once per page: a quoted call argument, and a quoted name before a quoted value.
_FEATURES = {"called": r"""\(\s*['"`]""", "paired": r"""['"`]\s*:\s*['"`]"""}
_NEEDED = {
    **dict.fromkeys(
        (
            "verb_call", "window_open", "fetch_call", "axios_call", "router_push", "jquery_call", "router_add",
            "require_call", "import_call",
        ),
        "called",
    ),
    "json_url": "paired",
    "json_src_href": "paired",
}

_PAIRS = [f"{tag} {attribute}" for tag, attribute in catalog.TAG_ATTRIBUTES]
_TAGS = sorted({tag for tag, _ in catalog.TAG_ATTRIBUTES})
_ATTRIBUTES = sorted({attribute for _, attribute in catalog.TAG_ATTRIBUTES})

_ATTRIBUTE = r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""
# A tag that is never closed runs to the end of the page, so that no tag inside it is tried again.
_OPEN_TAG = (
    r"(?i)<(?:" + "|".join(_TAGS) + r""")(?=[\s/>])(?:[\s/=]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+(?:>|\Z)"""
)
# Forms of patterns that are as fast on hostile text.  Where a pattern fails, every later start before the next
# character that ends its repeated class fails too; that part is passed over as a match without a group.
_LINEAR = {
    "assets_file": r"assets/(?:[a-zA-Z0-9_\-./]+\.(?:js|css|png|jpg|jpeg|svg|gif|woff2?|ttf|eot|mp4|mp3|json|map))",
    # The quote that ends the class can open the value of a call right before it.
    "css_url": r"""url\((?:['"]?([^\s'")]+)['"]?\)|['"]?(?:(?!url\(['"])[^\s'")])*+)""",
}
_LINEAR["assets_file"] = rf"({_LINEAR['assets_file']})|assets/[a-zA-Z0-9_\-./]*+"


_QUOTED, _BARE = r"""(['"])(.*?)\1""", r"([^\s>]+)"


def _attribute_pattern(tag: str, attribute: str, value: str) -> str:
    start = r"[^>]*?" if tag == "a" else r"[^>]*?\b"
    return rf"{start}{attribute}\s*=\s*{value}"


def _tag_pattern(tag: str, attribute: str, value: str) -> str:
    return rf"<{tag}\b{_attribute_pattern(tag, attribute, value)}"


def _linear_tag_pattern(tag: str, attribute: str, value: str) -> str:
    """The same matches, and as matches without a group the tags that lack the attribute.

    If the first tag before a ``>`` has no such attribute ahead of it, no later tag before that ``>`` has; the rest is passed over,
    so every part between two ``>`` is read at most twice.
    """
    return rf"<{tag}\b(?:{_attribute_pattern(tag, attribute, value)}|[^>]*+)"


def tag_patterns() -> list[tuple[str, str, str]]:
    """(name, needle, expression): quoted and bare value for each pair."""
    return _tag_forms(_tag_pattern)


def _tag_forms(form) -> list[tuple[str, str, str]]:
    patterns = []
    for tag, attribute in catalog.TAG_ATTRIBUTES:
        patterns.append((f"{tag}_{attribute}_quoted", f"<{tag}", form(tag, attribute, _QUOTED)))
        patterns.append((f"{tag}_{attribute}_bare", f"<{tag}", form(tag, attribute, _BARE)))
    return patterns


def _with_group(html: str, pattern: str) -> str:
    """SQL for what the first group of a linear form captured, without the parts passed over."""
    found = all_matches_sql(html, java_regex(pattern, ignore_case=True), 1)
    return f"filter({found}, m -> m <> '')"


def _path_matches(name: str, low: str, matches: str) -> str:
    """SQL for the matches of a path pattern, behind its cheaper tests."""
    guarded = guarded_sql(low, _NEEDLES.get(name, ()), matches)
    feature = _NEEDED.get(name)
    return guarded if feature is None else f"CASE WHEN {feature} THEN {guarded} ELSE {NO_MATCHES} END"


def path_strings(html: str, low: str) -> Column:
    """Raw strings found by the path patterns, in pages prepared by `with_features`.

    A pattern without a group captures its opening quote, which cleaning
    rejects, so those patterns are counted (`pattern_counts`) but not run here.
    """
    found = [
        _path_matches(name, low, _with_group(html, _LINEAR[name]) if name in _LINEAR else captured_sql(html, pattern))
        for name, pattern in catalog.PATH_PATTERNS
        if group_count(pattern) > 0
    ]
    return F.expr(f"concat({', '.join(found)})")


def tag_strings(html: str, low: str) -> Column:
    """Raw strings found by the bare-value tag patterns.

    The quoted forms capture the quote first, which cleaning rejects.
    """
    found = [
        guarded_sql(low, (needle,), _with_group(html, pattern))
        for name, needle, pattern in _tag_forms(_linear_tag_pattern)
        if name.endswith("_bare")
    ]
    return F.expr(f"concat({', '.join(found)})")


def dom_strings(html: str, low: str) -> Column:
    """Attribute values of link-bearing tags, any quoting, entities decoded.

    Comments and the bodies of scripts and styles hold no tags.  Of a repeated
    attribute the last one counts.
    """
    hidden = contains_any(F.expr(low), ("<!--", "<script", "<style"))
    visible = F.when(hidden, hide_inactive(F.expr(html))).otherwise(F.expr(html))

    def attributes(tag: Column) -> Column:
        body = F.regexp_replace(tag, r"(?s)^<[A-Za-z]+|>$", "")
        return F.struct(
            F.lower(F.regexp_extract(tag, "^<([A-Za-z]+)", 1)).alias("tag"),
            F.transform(all_matches(body, _ATTRIBUTE, 1), F.lower).alias("names"),
            all_matches(body, _ATTRIBUTE, 2).alias("values"),
        )

    def linked(tag: Column) -> Column:
        names, values = tag["names"], tag["values"]
        wanted = F.filter(
            F.array(*[F.lit(a) for a in _ATTRIBUTES]),
            lambda a: F.concat(tag["tag"], F.lit(" "), a).isin(_PAIRS) & F.array_contains(names, a),
        )
        return F.transform(
            wanted,
            lambda a: F.element_at(
                values, (F.size(names) - F.array_position(F.reverse(names), a) + 1).cast("int")
            ),
        )

    def unquoted(value: Column) -> Column:
        bare = F.when(value.rlike("^[\"']"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        return decode_entities(bare)

    closed = F.filter(all_matches(visible, java_regex(_OPEN_TAG), 0), lambda tag: tag.endswith(">"))
    tags = F.transform(closed, attributes)
    return F.transform(F.flatten(F.transform(tags, linked)), unquoted)


_SOURCES = {"path": path_strings, "tag": tag_strings, "dom": dom_strings}


def clean(raw: Column) -> Column:
    """Longest allowed prefix of a raw string; null if it cannot be a link."""
    prefix = F.regexp_extract(raw, catalog.ALLOWED_PREFIX, 0)
    pseudo = F.lit(False)
    for scheme in catalog.PSEUDO_SCHEMES:
        pseudo = pseudo | raw.startswith(scheme)
    return F.when(~pseudo & (prefix != ""), prefix)


def prepare(cleaned: Column, base_scheme: Column) -> Column:
    """Cleaned string ready to resolve: protocol added to ``//x``, backslashes dropped."""
    full = F.when(cleaned.startswith("//"), F.concat(base_scheme, F.lit(":"), cleaned)).otherwise(cleaned)
    return F.replace(full, F.lit("\\"), F.lit(""))


def is_full(cleaned: Column) -> Column:
    return F.contains(cleaned, F.lit("http"))


def webpack_urls(html: str, low: str, base: urls.Base) -> Column:
    """URLs of bundler chunks named in a page."""
    regex = java_regex(catalog.WEBPACK_PATTERN, ignore_case=True)
    names = F.transform(
        F.expr(guarded_sql(low, ("chunk-",), all_matches_sql(html, regex))),
        lambda m: F.concat(F.regexp_extract(m, regex, 1), F.lit("."), F.regexp_extract(m, regex, 2), F.lit(".js")),
    )
    found = F.transform(
        F.filter(names, lambda n: F.length(n).between(21, 27)),
        lambda n: F.concat(base.origin, F.lit("/" + catalog.WEBPACK_DIRECTORY), n),
    )
    return F.array_distinct(F.filter(found, lambda u: F.contains(u, F.lit("chunk"))))


def with_features(pages: DataFrame, text: str = "html") -> DataFrame:
    """Pages plus what the pattern guards look at: ``low``, the folded text, and the shared tests."""
    tests = {name: F.col(text).rlike(java_regex(regex)) for name, regex in _FEATURES.items()}
    return pages.withColumns({"low": folded(F.col(text)), **tests})


def _labelled(values: Column, name: str, label_name: str, label: str) -> Column:
    return F.transform(values, lambda v: F.struct(v.alias(name), F.lit(label).alias(label_name)))


def _keys(pages: DataFrame, *dropped: str) -> list[str]:
    return [c for c in pages.columns if c not in dropped]


def raw_links(pages: DataFrame, sources: Iterable[str] = ("path", "tag", "dom"), url: str = "url",
              text: str = "html") -> DataFrame:
    """One row per page, source and distinct raw string, with its cleaned form.

    Other columns of ``pages`` are kept, the text is not.
    """
    keys = _keys(pages, text)
    wide = with_features(pages, text).select(
        *keys, *[_SOURCES[s](f"`{text}`", "low").alias(f"raw_{s}") for s in sources]
    )
    tagged = [_labelled(F.array_distinct(F.col(f"raw_{s}")), "raw", "source", s) for s in sources]
    rows = exploded(wide, keys, F.concat(*tagged), "found")
    return rows.select(*keys, "found.source", "found.raw", clean(F.col("found.raw")).alias("cleaned"))


def resolved_links(raw: DataFrame, options: ScanOptions = ScanOptions(), url: str = "url") -> DataFrame:
    """One row per cleaned string and URL it leads to, with ``kind``.

    ``kind`` is ``full`` for URLs written out in the page, else ``resolved``.
    """
    keys = raw.columns
    parts = raw.where(F.col("cleaned").isNotNull()).withColumn("base", urls.Base.struct(F.col(url)))
    base, cleaned = urls.Base.from_struct(F.col("base")), F.col("cleaned")
    targets = F.when(is_full(cleaned), _labelled(urls.full_urls(cleaned), "link", "kind", "full")).otherwise(
        _labelled(
            _resolved(base, F.array(prepare(cleaned, base.scheme)), options), "link", "kind", "resolved"
        )
    )
    return exploded(parts, keys, targets, "found").select(*keys, "found.link", "found.kind")


def _resolved(base: urls.Base, relative: Column, options: ScanOptions) -> Column:
    """URLs of an array of prepared references."""
    if not _has_routes(options):
        return F.transform(relative, lambda rel: urls.resolve(base, rel))
    return F.flatten(F.transform(relative, lambda rel: _variants(base, rel, options)))


def _has_routes(options: ScanOptions) -> bool:
    return bool(options.fuzz and options.custom_base_urls and (options.api_routes or options.path_routes))


def _variants(base: urls.Base, rel: Column, options: ScanOptions) -> Column:
    """All valid URLs a reference stands for: itself, then API routes, then
    path routes, cut after the first dangerous one."""
    routed = F.array_distinct(
        F.concat(
            F.array(urls.resolve(base, rel)),
            urls.route_urls(rel, options.custom_base_urls, options.api_routes),
            urls.route_urls(rel, options.custom_base_urls, options.path_routes),
        )
    )
    keywords = options.active_danger_keywords

    def cut(valid: Column) -> Column:
        first = F.array_position(F.transform(valid, lambda u: filters.is_dangerous(u, keywords)), F.lit(True))
        return let(first, lambda f: F.when(f > 0, F.slice(valid, F.lit(1), f.cast("int"))).otherwise(valid))

    return let(F.filter(routed, urls.is_valid), cut)


def link_sets(pages: DataFrame, options: ScanOptions = ScanOptions(), url: str = "url",
              text: str = "html") -> DataFrame:
    """Page columns plus the distinct URLs of each page as arrays; the text is dropped.

    ``full`` are URLs written out in the page, ``resolved`` those that a
    reference leads to, ``chunks`` those of bundler chunks.
    """
    keys = _keys(pages, text)
    html, low, page = f"`{text}`", "low", F.col(url)
    strings = with_features(pages, text).select(
        *keys,
        urls.Base.struct(page).alias("_base"),
        F.array_distinct(F.concat(*[find(html, low) for find in _SOURCES.values()])).alias("_raw"),
        webpack_urls(html, low, urls.Base.of(page)).alias("chunks"),
    )
    cleaned = strings.withColumn(
        "_cleaned", F.array_distinct(F.filter(F.transform("_raw", clean), lambda c: c.isNotNull()))
    )
    base = urls.Base.from_struct(F.col("_base"))
    relative = F.transform(F.filter("_cleaned", lambda c: ~is_full(c)), lambda c: prepare(c, base.scheme))
    return cleaned.select(
        *keys,
        F.array_distinct(F.flatten(F.transform(F.filter("_cleaned", is_full), urls.full_urls))).alias("full"),
        F.array_distinct(_resolved(base, relative, options)).alias("resolved"),
        "chunks",
    )


def routed_links(sets: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """One row per page and URL, with where it goes if it is in scope and if it is not.

    ``inside`` and ``outside`` are arrays: a URL found both written out and by
    resolution is tested both ways and may end in two places.  ``place`` and
    ``domain`` are what the scope test looks at, so that it can be made later
    for each target.  Chunks (``chunk``) are kept in any case.
    """
    keys = _keys(sets, "full", "resolved", "chunks")
    full, resolved = F.col("full"), F.col("resolved")
    kinds = [
        _labelled(F.array_except(full, resolved), "link", "kind", "full"),
        _labelled(F.array_except(resolved, full), "link", "kind", "resolved"),
        _labelled(F.array_intersect(full, resolved), "link", "kind", "both"),
        _labelled(F.array_except("chunks", F.array_union(full, resolved)), "link", "kind", "chunk"),
    ]
    link = F.col("link")
    rows = exploded(sets, [*keys, "chunks"], F.concat(*kinds), "found").select(
        *keys, "found.link", "found.kind", F.array_contains("chunks", F.col("found.link")).alias("chunk")
    )
    suffixes = options.public_suffixes
    tested = rows.withColumns(
        {
            "place": urls.netloc(link),
            "domain": F.lit(None).cast("string") if suffixes is None else urls.registered_domain(link, suffixes),
            "ending": filters.has_extension(link, options.extensions),
            "refused": F.when(~urls.is_valid(link), "invalid").when(
                filters.is_dangerous(link, options.active_danger_keywords), "danger"
            ),
        }
    )
    allowed = F.when(F.col("ending"), "extension").otherwise("keep")
    as_full, as_resolved = F.col("kind").isin("full", "both"), F.col("kind").isin("resolved", "both")

    def places(if_full: Column, if_resolved: Column) -> Column:
        found = F.array(
            F.when(as_full, if_full),
            F.when(as_resolved, F.coalesce("refused", if_resolved)),
            F.when(F.col("chunk"), F.lit("keep")),
        )
        return F.array_distinct(F.array_compact(found))

    return tested.select(
        *keys,
        "link",
        "chunk",
        "place",
        "domain",
        places(allowed, allowed).alias("inside"),
        places(F.lit("external"), F.lit("out_of_scope")).alias("outside"),
    )


def dispositions(target: Column, options: ScanOptions) -> Column:
    """Where a routed link goes for a target domain."""
    domain = None if options.public_suffixes is None else F.col("domain")
    return F.when(filters.scope_test(F.col("place"), domain, target, options), F.col("inside")).otherwise(
        F.col("outside")
    )


def page_links(pages: DataFrame, options: ScanOptions = ScanOptions(), url: str = "url", text: str = "html",
               target: str | None = None) -> DataFrame:
    """Every link of every page, once per page and disposition.

    Adds ``link`` and ``disposition`` to the page columns (the text is
    dropped).  Dispositions: ``keep``, ``external``, ``danger``,
    ``out_of_scope``, ``extension``, ``invalid``.  ``target`` names the column
    with the domain that counts as inside; by default it is the page's own.
    """
    keys = _keys(pages, text)
    inside = filters.target_of(F.col(target) if target else None, F.col(url), options)
    routed = routed_links(link_sets(pages.withColumn("_target", inside), options, url, text), options)
    return exploded(routed, [*keys, "link"], dispositions(F.col("_target"), options), "disposition")


def kept_links(links: DataFrame) -> DataFrame:
    return links.where(F.col("disposition") == "keep")


def external_links(links: DataFrame) -> DataFrame:
    """Distinct URLs outside the scope."""
    return links.where(F.col("disposition") == "external").select(F.col("link").alias("url")).distinct()


def danger_links(links: DataFrame) -> DataFrame:
    """Distinct dangerous URLs."""
    return links.where(F.col("disposition") == "danger").select(F.col("link").alias("url")).distinct()


def pattern_counts(pages: DataFrame, text: str = "html") -> DataFrame:
    """Number of matches of every path, tag and chunk pattern over all pages.

    Counted per page in one narrow stage, then summed: the shuffle carries one
    partial row per pattern and task.
    """
    def found(pattern: str) -> str:
        return all_matches_sql(f"`{text}`", java_regex(pattern, ignore_case=True))

    html = f"`{text}`"
    matches = {name: _path_matches(name, "low", _with_group(html, _LINEAR[name]) if name in _LINEAR else found(p)) for name, p in catalog.PATH_PATTERNS}
    # Of a quoted form the first group is the quote: its matches are counted, empty values too.
    matches.update({name: guarded_sql("low", (needle,), _with_group(html, p)) for name, needle, p in _tag_forms(_linear_tag_pattern)})
    matches["webpack_chunk"] = guarded_sql("low", ("chunk-",), found(catalog.WEBPACK_PATTERN))
    counts = [
        f"named_struct('pattern', '{name}', 'matches', cast(size({sql}) AS bigint))" for name, sql in matches.items()
    ]
    counts = F.expr(f"array({', '.join(counts)})")
    return (
        exploded(with_features(pages.select(text), text), [], counts, "c")
        .groupBy(F.col("c.pattern").alias("pattern"))
        .agg(F.sum("c.matches").alias("matches"))
    )
