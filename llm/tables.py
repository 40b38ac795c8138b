"""What the operators share: how they read documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


# Rows go to Python in batches of this many bytes: every running task holds a batch three times or more, in the JVM and in Python.
BATCH_BYTES = 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(rows: DataFrame) -> DataFrame:
    """The same rows; the session sends rows to Python in batches of `BATCH_BYTES`, unless it has a size of its own."""
    if rows.sparkSession.conf.get(_SETTING, None) is None:
        rows.sparkSession.conf.set(_SETTING, str(BATCH_BYTES))
    return rows


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` of the documents and nothing else.

    A null text is empty.  A row without an id can't be named in a result and
    is left out.  Other columns, whatever their names, don't get through.
    """
    return bounded(docs).select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    ).where(F.col("doc_id").isNotNull())


def bucket(column: Column, n: int) -> Column:
    """CRC-32 of a value's text modulo ``n``: the split into folds."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def sampled(rows: DataFrame, total: int, most: int, id_column: str = "doc_id") -> DataFrame:
    """About ``most`` of ``total`` rows by the hash of their id; all if there are no more.  The share has 62 bits, so no total is too large."""
    if total <= most:
        return rows
    return rows.where(F.xxhash64(id_column).bitwiseAND((1 << 62) - 1) < (most << 62) // total)
