"""Counts and rates of a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescan.operators.skew import absent

DISPOSITIONS = ["keep", "external", "danger", "out_of_scope", "extension", "invalid"]


def scan_stats(results: DataFrame, max_urls: int, by: list[str] = ["target"]) -> DataFrame:
    """Requests, budget left, seconds and URLs per second of each target."""
    totals = results.groupBy(*by).agg(
        F.count("*").alias("url_count"),
        F.sum("time").alias("total_time"),
    )
    return totals.select(
        *by,
        F.col("url_count").alias("current_requests"),
        F.lit(max_urls).cast("bigint").alias("max_requests"),
        F.greatest(F.lit(0).cast("bigint"), F.lit(max_urls) - F.col("url_count")).alias("remaining_requests"),
        "url_count",
        "total_time",
        F.when(F.col("total_time") > 0, F.col("url_count") / F.col("total_time"))
        .otherwise(F.lit(0.0))
        .alias("urls_per_second"),
    )


def link_stats(links: DataFrame, visited: DataFrame, page: str = "page_id", link: str = "link") -> DataFrame:
    """Per page: links by disposition, and kept links that are new or already known.

    A kept link counts as added on the first page (by id) that holds it unless
    it was visited before, else as skipped.  First pages are found by a
    pre-aggregated minimum per URL and marked through (page, URL), so a URL
    that a third of all pages link to does not pile up in one task.

    ``links`` is read three times: pass a written table, not a fresh extraction.
    """
    kept = links.where(F.col("disposition") == "keep").select(page, link)
    first = kept.groupBy(link).agg(F.min(page).alias(page))
    first = absent(first, visited.select(F.col("url").alias(link)), [link]).withColumn("added", F.lit(1))
    added = (
        kept.join(first, [page, link], "left")
        .groupBy(page)
        .agg(
            F.coalesce(F.sum("added"), F.lit(0)).cast("bigint").alias("added"),
            F.sum(F.when(F.col("added").isNull(), 1).otherwise(0)).cast("bigint").alias("skipped"),
        )
    )
    counts = links.groupBy(page).agg(
        *[
            F.sum(F.when(F.col("disposition") == name, 1).otherwise(0)).cast("bigint").alias(f"n_{name}")
            for name in DISPOSITIONS
        ]
    )
    zero = F.lit(0).cast("bigint")
    return counts.join(added, page, "left").select(
        *counts.columns,
        F.coalesce("added", zero).alias("added"),
        F.coalesce("skipped", zero).alias("skipped"),
    )
