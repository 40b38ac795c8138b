"""Exact row numbers over ordered rows without one task holding a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagescan.storage import Workspace

_ROW_BITS = 33


def numbered(rows: DataFrame, order: list[str], by: list[str] = [], name: str = "ordinal",
             partitions: int | None = None) -> DataFrame:
    """Rows plus their number, from 1, in ``order`` within each group ``by``.

    The rows are range-partitioned and sorted, numbered inside each partition
    and written; the number of rows of the group in earlier partitions is then
    added.  ``by`` and ``order`` together must identify a row.
    """
    spark = rows.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    placed = (
        rows.repartitionByRange(count, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    stored = Workspace(spark, "numbered").write(placed, "rows")
    part = F.shiftright("_place", _ROW_BITS)
    # One row per group and partition; a group spans few partitions unless it
    # is large, and then it has at most one row per partition here.
    spans = stored.groupBy(*by, part.alias("_part")).agg(
        F.count("*").alias("_rows"), F.min("_place").alias("_first")
    )
    before = Window.partitionBy(*by, F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    joined = stored.withColumn("_part", part).join(
        offsets.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("_part").alias("_span"), "_first", "_before"),
        (F.col("_part") == F.col("_span")) & _all_equal(by),
    )
    number = F.col("_place") - F.col("_first") + F.col("_before") + 1
    return joined.select(*rows.columns, number.cast("bigint").alias(name))


def _all_equal(by: list[str]) -> Column:
    test = F.lit(True)
    for b in by:
        test = test & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return test
