"""Response signatures and duplicate flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescan.operators.results import collapsed_status

# What identifies a result row; also the order in which rows count as first seen.
ROW_KEY = ["target", "depth", "url"]


def content_hash(content: Column) -> Column:
    return F.coalesce(F.md5(content), F.lit(""))


def signature(length: Column, status: Column, hashed: Column | None = None) -> Column:
    """Length, status and content hash; without a hash that part is empty."""
    return F.concat_ws("|", length.cast("string"), status, F.lit("") if hashed is None else hashed)


def with_signature(results: DataFrame, hashed: str | None = None) -> DataFrame:
    """Results plus ``signature``; ``hashed`` names a column with the content hash."""
    status = collapsed_status(F.col("status_code"), F.col("status"))
    return results.withColumn(
        "signature", signature(F.col("length"), status, F.col(hashed) if hashed else None)
    )


def signature_counts(results: DataFrame, by: list[str] = ["target", "signature"]) -> DataFrame:
    return results.groupBy(*by).agg(F.count("*").alias("n"))


def flag_duplicates(results: DataFrame, by: list[str] = ["target", "signature"],
                    order: list[str] = ["depth", "url"], key: list[str] = ROW_KEY,
                    dedup_errors: bool = True) -> DataFrame:
    """Results plus ``is_duplicate_signature``: true if the signature came earlier in the scan.

    The first row of each signature is found by a minimum, which is
    pre-aggregated, and marked through the row key.  No task ever holds all
    rows of a signature, however many there are (all failed requests of a scan
    share one).  Rows that redirects lead to one URL differ in the URL asked for;
    of rows alike in all of these one is the first, by its place in the table, which should be a stored one.
    """
    asked = ["original_url"] if "original_url" in results.columns else []
    ordered = list(dict.fromkeys([*order, *key, *asked, "_row"]))
    whole = list(dict.fromkeys([*by, *ordered]))
    columns, results = results.columns, results.withColumn("_row", F.monotonically_increasing_id())
    firsts = (
        results.groupBy(*by)
        .agg(F.min(F.struct(*ordered)).alias("first"))
        .select(*[F.col(c if c in by else f"first.{c}").alias(f"_{c}") for c in whole], F.lit(True).alias("_first"))
    )
    same = None
    for c in whole:
        test = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = test if same is None else same & test
    duplicate = F.col("_first").isNull()
    if not dedup_errors:
        duplicate = duplicate & F.col("status_code").isNotNull()
    joined = results.join(firsts, same, "left")
    return joined.select(*columns, duplicate.alias("is_duplicate_signature"))


def live_rows(flagged: DataFrame) -> DataFrame:
    """Rows that are reported as they come: no duplicates."""
    return flagged.where(~F.col("is_duplicate_signature"))
