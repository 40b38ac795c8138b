"""Result records built from captured responses."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescan import catalog
from pagescan.functions.text import title_of
from pagescan.operators.detect import FINDING, Rule, with_findings

RESULT_COLUMNS = [
    "target", "url", "status_code", "status", "title", "length", "redirects", "depth", "time",
    "sensitive_raw", "content_type", "headers_count", "error_type", "original_url",
]


def error_status(error_type: Column, message: Column) -> Column:
    """Status text of a failed request: class prefix and message."""
    text = F.coalesce(message, F.lit(""))
    names, prefix = catalog.ERROR_PREFIXES[0]
    status = F.when(error_type.isin(names), F.concat(F.lit(prefix), text))
    for names, prefix in catalog.ERROR_PREFIXES[1:]:
        status = status.when(error_type.isin(names), F.concat(F.lit(prefix), text))
    return status.otherwise(F.concat(F.lit("Error("), error_type, F.lit("): "), text))


def collapsed_status(status_code: Column, status: Column) -> Column:
    """Status as signatures and reports show it: texts that name an error become ``Err``."""
    return F.when(status_code.isNull() & F.contains(status, F.lit("Err")), "Err").otherwise(status)


def status_class(status_code: Column, status: Column) -> Column:
    return (
        F.when(status_code.between(200, 299), "2xx")
        .when(status_code.between(300, 399), "3xx")
        .when(status_code.between(400, 499), "4xx")
        .when(status_code.between(500, 599), "5xx")
        .when(status_code.isNull() & F.contains(status, F.lit("Err")), "error")
        .otherwise("other")
    )


def title(status_code: Column, html: Column) -> Column:
    """Title of a page; other answers than 200 say so instead, errors have none."""
    return (
        F.when(status_code == 200, title_of(html))
        .when(status_code.isNotNull(), F.concat(F.lit(catalog.TITLE_FAILED), status_code.cast("string")))
        .otherwise("")
    )


def content_type(headers: Column) -> Column:
    return F.coalesce(F.try_element_at(headers, F.lit("Content-Type")), F.lit(""))


def header_count(headers: Column) -> Column:
    return F.when(headers.isNull(), 0).otherwise(F.size(headers))


def result_records(responses: DataFrame, rules: Iterable[Rule] | None = None, mode: str = "findall",
                   keep_content: bool = False) -> DataFrame:
    """One result per response, failed request or missing capture.

    The page text is dropped in the stage that read it, unless the same stage
    goes on to look for links in it (``keep_content``).
    """
    code, error = F.col("status_code"), F.col("error_type")
    answered = code.isNotNull()
    content = F.when(answered, F.coalesce(F.col("content"), F.lit(""))).otherwise("")
    status = (
        F.when(answered, code.cast("string"))
        .when(error.isNotNull(), error_status(error, F.col("error_message")))
        .otherwise(catalog.NO_RESPONSE)
    )
    redirects = F.coalesce(F.col("redirects"), F.array().cast("array<string>"))
    headers = F.col("headers")
    known = {
        "target": F.col("target"),
        "url": F.when(answered, F.coalesce("url", "original_url")).otherwise(F.col("original_url")),
        "status_code": code,
        "status": status,
        "title": title(code, content),
        "length": F.length(content),
        "redirects": F.when(answered, F.array_join(redirects, catalog.REDIRECT_SEPARATOR)).otherwise(""),
        "depth": F.col("depth"),
        "time": F.when(answered, F.coalesce(F.col("elapsed"), F.lit(0.0))).otherwise(F.lit(0.0)),
        "content_type": F.when(answered, content_type(headers)).otherwise(""),
        "headers_count": F.when(answered, header_count(headers)).otherwise(0),
        "error_type": F.when(~answered, error),
        "original_url": F.col("original_url"),
        "content": content,
    }
    extra = [c for c in responses.columns if c not in known and c not in _CONSUMED]
    wide = responses.select(*extra, *[column.alias(name) for name, column in known.items()])
    found = with_findings(wide, "content", rules, mode, keep_content)
    return found.select(*extra, *RESULT_COLUMNS, *(["content"] if keep_content else []))


_CONSUMED = {"headers", "elapsed", "error_message", "body", "charset"}


def placeholder_rows(urls: DataFrame, label: str, depth: Column | None = None) -> DataFrame:
    """Rows for URLs that were found but not scanned: ``label`` as status and title."""
    blank = F.lit("")
    values = {
        "target": F.col("target") if "target" in urls.columns else F.lit(None).cast("string"),
        "url": F.col("url"),
        "status_code": F.lit(None).cast("int"),
        "status": F.lit(label),
        "title": F.lit(label),
        "length": F.lit(0),
        "redirects": blank,
        "depth": F.lit(0) if depth is None else depth,
        "time": F.lit(0.0),
        "sensitive_raw": F.array().cast(f"array<{FINDING}>"),
        "content_type": blank,
        "headers_count": F.lit(0),
        "error_type": F.lit(None).cast("string"),
        "original_url": F.col("url"),
    }
    return urls.select(*[column.alias(name) for name, column in values.items()])
