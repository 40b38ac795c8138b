"""Exact dedup: a two-pass Bloom filter finds possibly repeated hashes; only their rows shuffle.

Pass one hashes every text to two places of a table of ``2 ** bits`` places
and keeps the places hit at least twice, as a bit map of 64-bit words.  Pass two
looks both places of every row up.  A row with a place hit once has no copy and
passes straight through; the others, copies and false alarms, are grouped by
their full hash.  The bit map has at most ``2 ** (bits - 6)`` words whatever
the input (16 MB at the default), which bounds what is broadcast; a table
far larger than that sends more rows through the exact step and nothing is lost.

Texts are equal if they are identical once each run of white space
(space, tab to carriage return) is one space; equality is judged by SHA-256.
Null texts count as empty, and all empty texts are one group.  Rows without an
id have no row in `verdicts`; `deduplicate` takes them like others, after all
ids.  Of rows that repeat an id and a text, `verdicts` has one row each
(all of them named kept if their id is the smallest), `deduplicate` leaves one.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.tables import texts
from pagescan.storage import Workspace

BITS = 26
_WHITE = r"[\x20\x09-\x0D]+"


def text_hash(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text with its white space made even."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), _WHITE, " "), 256)


def _places(value: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(value, F.lit(seed)), F.lit(1 << bits)) for seed in (1, 2)]


def _hit_twice(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """Pass one: the 64-bit words of the bit map of places hit at least twice."""
    hits = rows.select(F.explode(F.array(*_places(F.col(column), bits))).alias("place")).groupBy("place").count()
    return (
        hits.where("count >= 2")
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
    )


def _flagged(rows: DataFrame, column: str, words: DataFrame, bits: int) -> DataFrame:
    """Pass two: rows with ``maybe``, false if no other row can have the same hash."""
    flag = F.lit(True)
    for name, place in zip(("_a", "_b"), _places(F.col(column), bits)):
        side = words.select(F.col("word").alias(f"{name}_word"), F.col("bits").alias(f"{name}_bits"))
        # At most 2 ** (bits - 6) rows of 16 bytes.
        rows = rows.withColumn(name, place)
        rows = rows.join(F.broadcast(side), F.shiftright(name, 6) == F.col(f"{name}_word"), "left")
        shift = (F.col(name).bitwiseAND(63)).cast("int")
        one = F.call_function("bit_get", F.coalesce(F.col(f"{name}_bits"), F.lit(0).cast("bigint")), shift)
        flag = flag & (one == 1)
    return rows.withColumn("maybe", flag).drop("_a", "_b", "_a_word", "_b_word", "_a_bits", "_b_bits")


def verdicts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id, keep_id (smallest id of the equal texts), group_size, kept, text_sha256 of every row."""
    work = Workspace(docs.sparkSession, "exact")
    rows = texts(docs, id_column, text_column).select("doc_id", text_hash(F.col("text")).alias("text_sha256"))
    rows = work.write(rows, "hashes")
    flagged = _flagged(rows, "text_sha256", _hit_twice(rows, "text_sha256", bits), bits)
    flagged = work.write(flagged, "flagged")
    alone = flagged.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "text_sha256"
    )
    maybe = flagged.where("maybe").select("doc_id", "text_sha256")
    # Combined before the shuffle, and a written table: a join with it can be cut at a hot group.
    groups = work.write(
        maybe.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups"
    )
    shared = maybe.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256")
    return alone.unionByName(shared).withColumn("kept", F.col("doc_id") == F.col("keep_id"))


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = BITS) -> DataFrame:
    """The documents, all columns, without the rows whose text an earlier id has."""
    rows = docs.select(F.struct("*").alias("doc"), text_hash(F.col(text_column).cast("string")).alias("hash"))
    words = _hit_twice(rows, "hash", bits)
    flagged = _flagged(rows, "hash", words, bits)
    alone = flagged.where("not maybe").select("doc.*")
    order = F.struct(F.col(f"doc.{id_column}").isNull(), F.col(f"doc.{id_column}"))
    first = flagged.where("maybe").groupBy("hash").agg(F.min_by("doc", order).alias("doc"))
    return alone.unionByName(first.select("doc.*"))
