"""Rows that can matter, found before anything costly is done to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescan.storage import Workspace

MOST_BITS = 26  # 2 ** 26 places are 8 MB of 64-bit words


def _places(value: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(value, F.lit(seed)), F.lit(1 << bits)) for seed in (1, 2)]


def bloom_words(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """A Bloom filter of the keys as 64-bit words: at most ``2 ** (bits - 6)`` rows, whatever the number of keys."""
    places = keys.select(F.explode(F.array(*_places(F.col(key), bits))).alias("place"))
    return places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))


def among(rows: DataFrame, key: Column, known: DataFrame, column: str, also: Column | None = None) -> DataFrame:
    """Rows whose key is among the known ones, and few others; ``also`` names rows to keep in any case.

    For rows that are too wide to shuffle: the known keys come as a Bloom filter, which is sized by their number and bounded, so the
    rows are only read past it.  A later join on the key settles the false alarms.
    """
    known = Workspace(rows.sparkSession, "prune").write(known.select(column).where(F.col(column).isNotNull()).distinct(), "known")
    bits = min(max((16 * known.count()).bit_length(), 10), MOST_BITS)
    words, columns, hit = bloom_words(known, column, bits), rows.columns, F.lit(True)
    for name, place in zip(("_a", "_b"), _places(key, bits)):
        side = words.select(F.col("word").alias(f"{name}_word"), F.col("bits").alias(f"{name}_bits"))
        # At most 2 ** (MOST_BITS - 6) rows of 16 bytes.
        rows = rows.withColumn(name, F.when(key.isNotNull(), place)).join(F.broadcast(side), F.shiftright(name, 6) == F.col(f"{name}_word"), "left")
        bit = F.call_function("bit_get", F.coalesce(F.col(f"{name}_bits"), F.lit(0).cast("bigint")), F.coalesce(F.col(name), F.lit(0).cast("bigint")).bitwiseAND(63).cast("int"))
        hit = hit & F.col(name).isNotNull() & (bit == 1)
    return rows.where(hit if also is None else hit | also).select(*columns)
