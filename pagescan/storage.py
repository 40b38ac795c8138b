"""Shared folder for intermediate tables.

Iterative plans cut their lineage by writing tables that survive the loss of
an executor.  They go below the folder the cluster names in
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; local sessions without one get a temporary folder."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="pagescan-")
    spark.conf.set(_SETTING, folder)
    return folder


class Workspace:
    """A fresh folder for the tables of one run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def folder(self, table: str) -> str:
        return f"{self.path}/{table}"

    def write(self, rows: DataFrame, table: str) -> DataFrame:
        """The rows, read back from a written table."""
        rows.write.mode("overwrite").parquet(self.folder(table))
        return self.read(table, rows)

    def read(self, table: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.folder(table))
