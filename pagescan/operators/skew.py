"""Joins that stay balanced when single keys hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot if it holds more than 1/HOT_SHARE of the rows, so there are
# fewer than HOT_SHARE hot keys however large the table is: some 10 MB of URLs on the driver.
HOT_SHARE = 100_000
HOT_ROWS = 100_000


def hot_keys(rows: DataFrame, key: str, min_rows: int = HOT_ROWS) -> dict[str, int]:
    """Hot keys with the number of slices each is cut into.

    ``rows`` should be a written table: it is counted, and, if it is larger
    than ``min_rows``, counted by key.  That count is pre-aggregated, so a hot
    key costs one partial row per task; at most `HOT_SHARE` keys are returned.
    """
    total = rows.count()
    limit = max(min_rows, total // HOT_SHARE)
    if total <= limit:
        return {}
    hot = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > limit).collect()
    return {row[key]: -(-row["n"] // limit) for row in hot}


def balanced_join(left: DataFrame, right: DataFrame, key: str, left_hot: dict[str, int], right_hot: dict[str, int],
                  left_by: str, right_by: str) -> DataFrame:
    """Inner join on ``key`` in which hot keys of either side are cut up.

    Rows of a hot left key go to one of its slices by the hash of ``left_by``
    and the matching right rows are repeated for each slice, and the other way
    round, so each pair still meets exactly once.
    """
    keys = sorted({k for k in (*left_hot, *right_hot) if k is not None})
    if not keys:
        return left.join(right, key)
    hot = left.sparkSession.createDataFrame(
        [(k, left_hot.get(k, 1), right_hot.get(k, 1)) for k in keys],
        f"`{key}` string, left_slices int, right_slices int",
    )

    def slices(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(1))

    def spread(rows: DataFrame, own: str, other: str, by: str) -> DataFrame:
        # The hot table has at most 2 * HOT_SHARE rows.
        marked = rows.join(F.broadcast(hot), key, "left")
        return (
            marked.withColumn(own, F.pmod(F.xxhash64(by), slices(f"{own}_slices")).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), slices(f"{other}_slices") - 1)))
            .drop("left_slices", "right_slices")
        )

    joined = spread(left, "left", "right", left_by).join(spread(right, "right", "left", right_by), [key, "left", "right"])
    return joined.drop("left", "right")


def absent(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not among the known ones (null keys never are).

    For aggregated ``rows``: an anti join would be pushed below the aggregate,
    and all copies of a hot key would be shuffled before they are combined.
    An outer join with a test stays above it.
    """
    marked = known.select(*keys).distinct().withColumn("_known", F.lit(True))
    return rows.join(marked, keys, "left").where(F.col("_known").isNull()).select(*rows.columns)
