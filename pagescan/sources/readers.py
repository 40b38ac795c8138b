"""Reading targets, captured pages and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DoubleType,
    IntegerType,
    MapType,
    StringType,
    StructField,
    StructType,
)

from pagescan.functions.text import decode_body, strip, text_for_links

RESPONSES = StructType(
    [
        StructField("url", StringType()),
        StructField("original_url", StringType()),
        StructField("status_code", IntegerType()),
        StructField("error_type", StringType()),
        StructField("error_message", StringType()),
        StructField("content", StringType()),
        StructField("headers", MapType(StringType(), StringType())),
        StructField("redirects", ArrayType(StringType())),
        StructField("elapsed", DoubleType()),
        StructField("target", StringType()),
        StructField("depth", IntegerType()),
    ]
)


# Of compressed page text; link extraction takes some seconds of a core for each MB.
PART_BYTES = 4 << 20


def targets(spark: SparkSession, path: str) -> DataFrame:
    """Target list from text files: one URL per line, trimmed, blank lines dropped, repeats kept."""
    return clean_targets(spark.read.text(path))


def clean_targets(lines: DataFrame) -> DataFrame:
    return lines.select(strip(F.col("value")).alias("url")).where(F.col("url") != "")


def single_target(spark: SparkSession, url: str) -> DataFrame:
    return spark.createDataFrame([(url,)], "url string")


def spread(rows: DataFrame, key: str, partitions: int) -> DataFrame:
    """Rows dealt by key over so many partitions.

    Page text costs far more to scan than to read, and a table of a few large row groups keeps
    most cores idle.  This shuffles the text, so it is only for a caller who knows
    the table to be one of these; others set ``spark.sql.files.maxPartitionBytes``.
    """
    return rows.repartition(partitions, key)


def text_parts(spark: SparkSession, path: str) -> int:
    """So many partitions that none has more than some `PART_BYTES` of the files, and every core has one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def responses_from_pages(captured: DataFrame, target: Column | None = None) -> DataFrame:
    """Captured pages (url, html) as successful responses."""
    none = F.lit(None)
    return captured.select(
        *[c for c in captured.columns if c not in ("url", "html")],
        "url",
        F.col("url").alias("original_url"),
        F.lit(200).alias("status_code"),
        none.cast("string").alias("error_type"),
        none.cast("string").alias("error_message"),
        F.col("html").alias("content"),
        none.cast("map<string,string>").alias("headers"),
        F.array().cast("array<string>").alias("redirects"),
        F.lit(0.0).alias("elapsed"),
        (none.cast("string") if target is None else target).alias("target"),
        F.lit(0).alias("depth"),
    )


def declared_charset(headers: Column) -> Column:
    """The charset that a ``Content-Type`` header names, null if there is none."""
    kind = F.map_filter(headers, lambda name, _: F.lower(name) == "content-type")
    value = F.try_element_at(F.map_values(kind), F.lit(1))
    return F.nullif(F.regexp_extract(value, r"""(?i)charset\s*=\s*["']?([^\s"';,]+)""", 1), F.lit(""))


def decoded(responses: DataFrame) -> DataFrame:
    """Responses with a binary ``body`` turned into text by ``charset`` or else by what their headers declare.

    ``content`` is what detection reads, ``link_text`` what links are looked for in.
    """
    charset = F.nullif(F.col("charset"), F.lit(""))
    if "headers" in responses.columns:
        charset = F.coalesce(charset, declared_charset(F.col("headers")))
    texts = {
        "content": decode_body(F.col("body"), charset),
        "link_text": text_for_links(F.col("body")),
    }
    return responses.withColumns(texts).drop("body", "charset")


def responses(spark: SparkSession, path: str, source: str = "parquet") -> DataFrame:
    """Captured responses from any file source Spark reads.

    Files hold the `RESPONSES` columns; a binary ``body`` with its ``charset``
    may take the place of ``content``.  What a file leaves out is null.
    Files that name their columns and have no body are read without a decoding step.
    """
    if source in ("parquet", "orc") and "body" not in spark.read.format(source).load(path).columns:
        rows = spark.read.format(source).schema(RESPONSES).load(path)
        return rows.withColumns({"original_url": F.coalesce("original_url", "url"), "link_text": F.col("content")})
    schema = StructType([*RESPONSES, StructField("body", BinaryType()), StructField("charset", StringType())])
    rows = spark.read.format(source).schema(schema).load(path)
    rows = rows.withColumn("original_url", F.coalesce("original_url", "url"))
    given = decoded(rows.withColumnRenamed("content", "_given"))
    return given.withColumns(
        {"content": F.coalesce("_given", "content"), "link_text": F.coalesce("_given", "link_text")}
    ).drop("_given")


def fetched(frontier: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per requested URL with its captured response; columns are null where none was captured.

    This takes the place of fetching.  ``responses`` hold one row per
    requested URL (``original_url``).  The join shuffles what it is given:
    analyse page text first and pass slim rows.
    """
    captured = responses.drop(*[c for c in ("target", "depth") if c in frontier.columns])
    wanted = frontier.withColumnRenamed("url", "_requested")
    joined = wanted.join(captured, F.col("_requested") == F.col("original_url"), "left")
    return joined.withColumn("original_url", F.col("_requested")).drop("_requested")
