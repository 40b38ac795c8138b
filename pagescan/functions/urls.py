"""URL splitting, joining, resolution and classification as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagescan import catalog
from pagescan.functions.match import all_matches, empty_strings, let

# RFC 3986, appendix B, with the scheme restricted to legal scheme characters.
_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
_PARTS = rf"(?s)^(?:({_SCHEME}):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_NETLOC = rf"^(?:{_SCHEME}:)?//([^/?#]*)"
_HOST = rf"^(?:{_SCHEME}:)?//(?:[^/?#]*@)?([^/?#:@]*)"
_PORT = r"^\s*\+?[0-9]+(?:_[0-9]+)*\s*$"
_IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, f"^({_SCHEME}):", 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _NETLOC, 1)


def full_path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 4)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 5)


def path(url: Column) -> Column:
    """Path without the parameters after a ``;`` in its last segment."""
    return F.regexp_replace(full_path(url), r";[^/]*$", "")


def host(url: Column) -> Column:
    """Host name: no user, no port, no trailing dots."""
    return F.rtrim(F.trim(F.regexp_extract(url, _HOST, 1)), F.lit("."))


@dataclass(frozen=True)
class Base:
    """Parts of the page URL, split once per page and used for all its links."""

    scheme: Column
    netloc: Column
    path: Column
    full_path: Column
    query: Column
    url: Column

    @classmethod
    def of(cls, url: Column) -> "Base":
        return cls(scheme(url), netloc(url), path(url), full_path(url), query(url), url)

    @classmethod
    def struct(cls, url: Column) -> Column:
        return F.struct(
            scheme(url).alias("scheme"),
            netloc(url).alias("netloc"),
            path(url).alias("path"),
            full_path(url).alias("full_path"),
            query(url).alias("query"),
            url.alias("url"),
        )

    @classmethod
    def from_struct(cls, column: Column) -> "Base":
        return cls(*(column[name] for name in ("scheme", "netloc", "path", "full_path", "query", "url")))

    @property
    def origin(self) -> Column:
        return F.concat(self.scheme, F.lit("://"), self.netloc)


def collapse_slashes(text: Column) -> Column:
    return F.regexp_replace(text, "/{2,}", "/")


def _directory(url_path: Column) -> Column:
    """Directory part of a path; a path that already ends in a slash stays."""
    head = F.regexp_extract(url_path, r"^(.*/)", 1)
    parent = F.when(head.rlike(r"^/*$"), head).otherwise(F.rtrim(head, F.lit("/")))
    return F.when(url_path.endswith("/"), url_path).otherwise(parent)


def _climb(base: Base, rel: Column) -> Column:
    """``../x``: every ``..`` in the reference climbs one directory, wherever it stands."""
    steps = F.split(rel, "/")
    ups = F.size(F.filter(steps, lambda s: s == ".."))
    names = F.filter(steps, lambda s: ~s.isin("..", ".", ""))
    directory = F.when(base.path.endswith("/"), base.path).otherwise(
        F.regexp_replace(base.path, r"/?[^/]*$", "")
    )
    kept = F.filter(F.split(directory, "/"), lambda s: s != "")
    kept = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - ups, F.lit(0)))
    return F.concat(base.origin, F.lit("/"), F.array_join(F.concat(kept, names), "/"))


def _merged_path(base_path: Column, rel_path: Column) -> Column:
    """Base directory plus relative path with dot segments removed."""
    above = let(
        F.split(base_path, "/"),
        lambda a: F.when(F.element_at(a, -1) == "", a).otherwise(F.slice(a, F.lit(1), F.size(a) - 1)),
    )

    def tidy(segments: Column) -> Column:
        size = F.size(segments)
        inner = F.filter(F.slice(segments, F.lit(2), F.greatest(size - 2, F.lit(0))), lambda s: s != "")
        return F.when(size < 2, segments).otherwise(
            F.concat(F.slice(segments, 1, 1), inner, F.slice(segments, -1, 1))
        )

    def walk(segments: Column) -> Column:
        done = F.aggregate(
            segments,
            empty_strings(),
            lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(s == ".", done)
            .otherwise(F.concat(done, F.array(s))),
        )
        return F.when(
            F.element_at(segments, -1).isin(".", ".."), F.concat(done, F.array(F.lit("")))
        ).otherwise(done)

    steps = F.split(rel_path, "/")
    segments = F.when(rel_path.startswith("/"), steps).otherwise(let(F.concat(above, steps), tidy))
    return let(
        F.array_join(let(segments, walk), "/"), lambda text: F.when(text == "", F.lit("/")).otherwise(text)
    )


def _assemble(scheme_: Column, netloc_: Column, path_: Column, query_: Column, fragment_: Column) -> Column:
    rooted = F.when(
        (netloc_ != "") & (path_ != "") & ~path_.startswith("/"), F.concat(F.lit("/"), path_)
    ).otherwise(path_)
    return F.concat(
        F.when(scheme_ != "", F.concat(scheme_, F.lit(":"))).otherwise(""),
        F.when(netloc_ != "", F.concat(F.lit("//"), netloc_)).otherwise(""),
        rooted,
        F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise(""),
        F.when(fragment_ != "", F.concat(F.lit("#"), fragment_)).otherwise(""),
    )


def _joined(base: Base, rel: Column) -> Column:
    """RFC 3986 reference resolution, then repeated slashes in the path collapsed."""

    def join(r: Column) -> Column:
        foreign = (r["scheme"] != "") & (r["scheme"] != base.scheme)
        own = foreign | (r["netloc"] != "")
        same_page = r["path"] == ""
        bare_base = F.regexp_replace(base.full_path, ";$", "")
        new_path = (
            F.when(own, r["path"])
            .when(same_page, bare_base)
            .otherwise(_merged_path(base.path, r["path"]))
        )
        return _assemble(
            F.when(r["scheme"] != "", r["scheme"]).otherwise(base.scheme),
            F.when(own, r["netloc"]).otherwise(base.netloc),
            collapse_slashes(new_path),
            F.when(~own & same_page & (r["query"] == ""), base.query).otherwise(r["query"]),
            F.when(rel == "", fragment(base.url)).otherwise(r["fragment"]),
        )

    parts = F.struct(
        scheme(rel).alias("scheme"),
        netloc(rel).alias("netloc"),
        full_path(rel).alias("path"),
        query(rel).alias("query"),
        fragment(rel).alias("fragment"),
    )
    return let(parts, join)


def resolve(base: Base, rel: Column) -> Column:
    """Absolute URL of a reference found on a page.

    The forms are tested in this order: protocol-relative, hash route,
    absolute path, ``./``, ``../``, full URL, anything else.
    """
    return (
        F.when(rel.startswith("//"), F.concat(base.scheme, F.lit(":"), rel))
        .when(rel.startswith("#/"), F.concat(base.origin, base.path, rel))
        .when(rel.startswith("/"), F.concat(base.origin, F.lit("/"), F.ltrim(rel, F.lit("/"))))
        .when(
            rel.startswith("./"),
            F.concat(
                base.origin, _directory(base.path), F.lit("/"), F.ltrim(F.substr(rel, F.lit(3)), F.lit("/"))
            ),
        )
        .when(rel.startswith("../"), _climb(base, rel))
        .when(rel.startswith("http://") | rel.startswith("https://"), rel)
        .otherwise(_joined(base, rel))
    )


def route_urls(rel: Column, bases: Iterable[str], routes: Iterable[str]) -> Column:
    """One URL per configured base and route: base / route / reference.

    The lists are configuration, so they become one literal array of prefixes
    and each link is expanded in place.
    """
    prefixes = []
    for base in bases:
        for route in routes:
            inner = route.strip("/")
            prefixes.append(base.rstrip("/") + "/" + (inner + "/" if inner else ""))
    if not prefixes:
        return empty_strings()
    absolute = rel.startswith("http://") | rel.startswith("https://")
    return F.when(absolute, F.array(rel)).otherwise(
        F.transform(
            F.array(*[F.lit(p) for p in prefixes]), lambda p: F.concat(p, F.ltrim(rel, F.lit("/")))
        )
    )


def is_valid(url: Column) -> Column:
    """True for a URL that may be scanned; false for null and blank ones."""
    text = F.regexp_replace(url, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    place = netloc(text)
    labels = F.split(place, r"\.")
    colons = F.split(place, ":")
    port = F.element_at(colons, 2)
    number = F.regexp_replace(port, r"[_+\s]", "").try_cast("bigint")
    port_ok = port.rlike(_PORT) & F.coalesce(number.between(1, 65535), F.lit(False))
    brackets_ok = F.contains(place, F.lit("[")) == F.contains(place, F.lit("]"))
    return F.coalesce(
        scheme(text).isin(*catalog.VALID_SCHEMES)
        & (F.size(labels) >= 2)
        & (F.length(F.element_at(labels, -1)) >= 2)
        & F.when(F.size(colons) == 2, port_ok).otherwise(True)
        & brackets_ok
        & (F.length(text) <= catalog.MAX_URL_LENGTH),
        F.lit(False),
    )


def _suffix_test(rules: set[str]) -> Callable[[Column, Column], Column]:
    """(tail, tail without its first label) -> is the tail a public suffix?

    Plain rules and the parents of ``*.`` rules become hash sets, so a look-up costs the same for ten rules and for ten thousand.
    Only the few other forms (``?``, or ``*`` elsewhere) are a regex.
    """
    wild = {rule[2:] for rule in rules if rule.startswith("*.") and not set(rule[2:]) & set("*?")}
    odd = sorted(rule for rule in rules if set(rule) & set("*?") and not (rule.startswith("*.") and rule[2:] in wild))
    plain = {rule for rule in rules if not set(rule) & set("*?")}
    shapes = "|".join(re.escape(rule).replace(r"\*", "[^.]+").replace(r"\?", "[^.]") for rule in odd)

    def test(tail: Column, parent: Column) -> Column:
        found = _among(tail, plain) | (_among(parent, wild) & ~tail.startswith("."))
        return found | tail.rlike(f"^(?:{shapes})$") if shapes else found

    return test


def _among(value: Column, names: set[str]) -> Column:
    return value.isin(sorted(names)) if names else F.lit(False)


def registered_domain(url: Column, suffixes: Iterable[str]) -> Column:
    """Domain plus public suffix, found by the longest matching suffix.

    The host's tails, from the longest on, are looked up in the suffix rules.  Rules may hold ``*`` for a
    label and ``?`` for a character; ``!`` names a domain that is none of the
    suffixes a rule makes; ``*`` alone makes the last label a suffix.  An
    address or a name without known suffix keeps an empty suffix, that is a
    trailing dot.
    """
    rules = {s.lower() for s in suffixes}
    named = {rule[1:] for rule in rules if rule.startswith("!")}
    is_suffix = _suffix_test({rule for rule in rules if not rule.startswith("!") and rule != "*"})
    default = F.lit("*" in rules)

    def of(name: Column) -> Column:
        labels = F.split(name, r"\.")
        # The name without 0, 1, 2, ... of its first labels; the last one is empty.
        tails = F.transform(
            F.sequence(F.lit(1), F.size(labels) + 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
        )
        return let(tails, lambda tails: let(F.transform(tails, F.lower), lambda lower: chosen(name, tails, lower)))

    def chosen(name: Column, tails: Column, lower: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(tails) - 1)
        excepted = F.get(F.filter(tails, lambda t: _among(F.lower(t), named)), F.lit(0)) if named else F.lit(None).cast("string")
        known = F.filter(places, lambda i: is_suffix(F.get(lower, i - 1), F.get(lower, i)))
        first = F.get(known, F.lit(0))
        # Without a rule the last of several labels is the suffix, if the rules say so.
        count = F.size(tails)
        last = F.when(default & (count > 2) & (F.get(tails, count - 2) != ""), count - 1)
        return (
            F.when(excepted.isNotNull(), excepted)
            .when(first == 1, F.concat(F.lit("."), name))
            .when(first > 1, F.get(tails, first - 2))
            .when(last.isNotNull(), F.get(tails, last - 2))
            .otherwise(F.concat(F.substring_index(name, ".", -1), F.lit(".")))
        )

    return let(host(url), lambda name: F.when(name.rlike(_IPV4), F.concat(name, F.lit("."))).otherwise(of(name)))


def target_domain(url: Column, suffixes: Iterable[str] | None) -> Column:
    """What a start URL's own pages are recognised by."""
    return netloc(url) if suffixes is None else registered_domain(url, suffixes)


def link_type(url: Column) -> Column:
    """Upper-cased extension of the last path segment, or the API label."""
    segment = F.element_at(F.split(F.element_at(F.split(url, r"\?", 2), 1), "/"), -1)
    return F.when(
        F.contains(segment, F.lit(".")), F.upper(F.element_at(F.split(segment, r"\."), -1))
    ).otherwise(catalog.API_LINK)


def report_name(url: Column) -> Column:
    """Host without port, only ASCII letters, digits and dots."""
    place = netloc(url)
    text = F.when(place != "", place).otherwise(url)
    return F.regexp_replace(F.split_part(text, F.lit(":"), F.lit(1)), r"[^a-zA-Z0-9.]", "")


def full_urls(text: Column) -> Column:
    return all_matches(text, catalog.FULL_URL, 0)
