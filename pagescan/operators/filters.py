"""Predicates on URLs: scope, extension, danger keywords, request gate."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagescan import catalog
from pagescan.functions import urls
from pagescan.functions.match import contains_any, escaped_any
from pagescan.options import SCOPE_ALL, SCOPE_WHITELIST, ScanOptions


def target_of(target: Column | None, url: Column, options: ScanOptions) -> Column:
    """Domain that counts as inside: the given one, else the URL's own."""
    return target if target is not None else urls.target_domain(url, options.public_suffixes)


def in_scope(url: Column, target: Column, options: ScanOptions) -> Column:
    """True if the URL's host may be scanned under the scope mode."""
    suffixes = options.public_suffixes
    domain = None if suffixes is None else urls.registered_domain(url, suffixes)
    return scope_test(urls.netloc(url), domain, target, options)


def scope_test(place: Column, domain: Column | None, target: Column, options: ScanOptions) -> Column:
    """`in_scope` for an already known network location and registered domain."""
    if options.scope_mode == SCOPE_ALL:
        allowed = F.lit(True)
    elif options.scope_mode == SCOPE_WHITELIST:
        allowed = contains_any(place, options.whitelist_domains)
    elif domain is not None:
        allowed = F.coalesce(domain == target, F.lit(False))
    else:
        inside = (place == target) | F.endswith(place, F.concat(F.lit("."), target))
        allowed = F.coalesce(inside, F.lit(False))
    return allowed & ~contains_any(place, options.blacklist_domains)


def has_extension(url: Column, extensions: Iterable[str]) -> Column:
    """True if the path ends in one of the extensions (path in any case)."""
    return F.lower(urls.path(url)).rlike(f"(?:{escaped_any(extensions)})\\z")


def is_dangerous(url: Column, keywords: Iterable[str]) -> Column:
    """True if the URL holds a keyword in any case; scripts are exempt."""
    keywords = [k.lower() for k in keywords]
    if not keywords:
        return F.lit(False)
    return ~url.endswith(".js") & F.lower(url).rlike(escaped_any(keywords))


def danger_types(url: Column, keywords: Iterable[str], ignore_case: bool = True) -> Column:
    """Keywords a dangerous URL holds, in list order, or the unknown label."""
    text = F.lower(url) if ignore_case else url
    words = F.array(*[F.lit(k.lower() if ignore_case else k) for k in keywords])
    hits = F.when(url.endswith(".js"), F.array().cast("array<string>")).otherwise(
        F.filter(words, lambda k: F.contains(text, k))
    )
    return F.when(F.size(hits) > 0, F.array_join(hits, ", ")).otherwise(catalog.UNKNOWN)


def request_error(url: Column, options: ScanOptions) -> Column:
    """Why a URL would not be requested, or null: the lists are searched in the whole URL."""
    gate = F.when(contains_any(url, options.blacklist_domains), F.concat(F.lit(catalog.BLACKLISTED), url))
    if options.scope_mode == SCOPE_WHITELIST:
        gate = gate.when(
            ~contains_any(url, options.whitelist_domains), F.concat(F.lit(catalog.NOT_WHITELISTED), url)
        )
    return gate
