"""Writing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescan import catalog

_CSV = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "encoding": "UTF-8"}


def titled(report: DataFrame, *extra: str) -> DataFrame:
    """The eleven report columns under their report names."""
    titles = zip(catalog.REPORT_COLUMNS, catalog.REPORT_HEADER)
    return report.select(*[F.col(name).alias(title) for name, title in titles], *extra)


def write_report(report: DataFrame, path: str, partition: str | None = None, order: list[str] = []) -> None:
    """Overwrite a report: CSV with a header, the eleven report columns.

    ``partition`` names a column that gives one folder per value, ``order``
    the columns that rows are sorted by (a range-partitioned sort).  Rows are
    sorted by folder first: a task then writes to few folders, only large folders get
    several files, and the order holds inside each folder.
    """
    extra = [partition] if partition else []
    by = [*extra, *order]
    rows = report.orderBy(*by) if by else report
    writer = titled(rows, *extra).write.mode("overwrite").options(**_CSV)
    (writer.partitionBy(partition) if partition else writer).csv(path)


def append_report(rows: DataFrame, path: str) -> None:
    """Add rows to a report folder."""
    titled(rows).write.mode("append").options(**_CSV).csv(path)


def write_summary(summary: DataFrame, path: str) -> bool:
    """Write a batch summary in section order; an empty one is not written."""
    if summary.isEmpty():
        return False
    write_report(summary, path, order=["section", "url"])
    return True
