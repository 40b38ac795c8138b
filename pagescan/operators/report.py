"""Report rows, danger rows and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescan import catalog
from pagescan.functions import urls
from pagescan.operators import detect, filters
from pagescan.operators.ranking import numbered
from pagescan.operators.results import collapsed_status, placeholder_rows
from pagescan.options import ScanOptions


def yes_no(flag: Column) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), catalog.YES).otherwise(catalog.NO)


def report_rows(results: DataFrame, *extra: str) -> DataFrame:
    """The eleven report columns of results, after any ``extra`` ones."""
    types, counts, details = detect.flat(F.col("sensitive_raw"))
    flag = F.col("is_duplicate_signature") if "is_duplicate_signature" in results.columns else F.lit(False)
    return results.select(
        *extra,
        F.coalesce("url", F.lit("")).alias("url"),
        collapsed_status(F.col("status_code"), F.col("status")).alias("status"),
        "title",
        "length",
        F.coalesce(urls.link_type(F.col("url")), F.lit(catalog.API_LINK)).alias("link_type"),
        "redirects",
        "depth",
        types.alias("sensitive_types"),
        counts.alias("sensitive_counts"),
        details.alias("sensitive_details"),
        yes_no(flag).alias("is_duplicate"),
    )


def danger_types(url: Column, options: ScanOptions) -> Column:
    return filters.danger_types(url, options.active_danger_keywords, options.danger_label_ignores_case)


def danger_report_rows(danger: DataFrame, options: ScanOptions, *extra: str) -> DataFrame:
    """Report rows of a scan's dangerous URLs."""
    types = danger_types(F.col("url"), options)
    return danger.select(
        *extra,
        "url",
        F.lit(catalog.DANGER).alias("status"),
        F.lit(catalog.DANGER_TITLE).alias("title"),
        F.lit(0).alias("length"),
        F.lit(catalog.DANGER).alias("link_type"),
        F.lit("").alias("redirects"),
        F.lit(0).alias("depth"),
        types.alias("sensitive_types"),
        F.lit("1").alias("sensitive_counts"),
        F.concat(F.lit(catalog.DANGER_TITLE + ": "), types).alias("sensitive_details"),
        F.lit(catalog.NO).alias("is_duplicate"),
    )


def danger_results(danger: DataFrame, options: ScanOptions) -> DataFrame:
    """Result rows of dangerous URLs, as a batch summary lists them: the URL is the sample."""
    found = F.array(
        F.struct(
            F.lit(0).alias("ord"),
            F.lit("danger").alias("rule"),
            danger_types(F.col("url"), options).alias("type"),
            F.lit(1).alias("count"),
            F.array("url").alias("samples"),
            F.lit(1).alias("total"),
        )
    ).cast(f"array<{detect.FINDING}>")
    rows = placeholder_rows(danger, catalog.DANGER)
    return rows.withColumns(
        {"title": F.lit(catalog.DANGER_TITLE), "sensitive_raw": found, "original_url": F.coalesce("target", "url")}
    )


def ranked_danger(danger: DataFrame, options: ScanOptions) -> DataFrame:
    """Dangerous URLs numbered in URL order, with the keywords they hold."""
    return numbered(danger, ["url"], name="rank").withColumn("danger_types", danger_types(F.col("url"), options))


def batch_summary(results: DataFrame, external: DataFrame, danger: DataFrame, options: ScanOptions) -> DataFrame:
    """Results of all targets, then their external rows, then their danger rows.

    The three parts are told apart and ordered by ``section``.
    """
    sections = (results, external, danger_results(danger, options))
    parts = [
        report_rows(part.withColumn("section", F.lit(number)), "section", "target")
        for number, part in enumerate(sections, 1)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def report_partition(url: Column) -> Column:
    """Folder a target's report goes to."""
    return urls.report_name(url)
