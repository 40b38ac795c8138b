"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescan.storage import Workspace

TASK_ROWS = 50_000


def sized(rows: DataFrame, count: int) -> DataFrame:
    """At most one partition for so many rows: a small table is no work for hundreds of tasks, and a large one keeps all of its."""
    return rows.coalesce(max(1, -(-count // TASK_ROWS)))


def components(edges: DataFrame) -> DataFrame:
    """id and label (the smallest id it is connected to, itself included) of every id in the edges ``a``, ``b``.

    Alternates two steps until nothing changes: each id hands its smallest neighbour to its larger
    neighbours, then to its smaller ones.  Every step is a combined minimum and a join, on tables
    in the shared folder; the number of steps grows with the logarithm of the largest component's diameter.
    """
    work = Workspace(edges.sparkSession, "components")
    now = work.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges0"
    )
    print_, step = _print(now), 0
    while True:
        step += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = work.write(sized(large, print_[0]), f"large{step}")
        # Every id also keeps its link to its smallest neighbour.
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = work.write(sized(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), print_[0]), f"edges{step}")
        if (found := _print(now)) == print_:
            break
        print_ = found
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("label"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots)


def _print(edges: DataFrame) -> tuple:
    """The number of edges, and a sum that is equal for equal lists."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
