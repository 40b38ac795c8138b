"""Sharding: best-fit-decreasing packing of indivisible groups into a fixed number of equal shards.

The law is ``bytes``: shards get near equal sizes.  Equal texts are a group,
and a group stays in one shard unless it is larger than a shard's fair
part; such a group is cut by the hash of the id into parts of parcel size.

Two levels keep every task and the driver bounded.  Groups are dealt by hash
over partitions; each partition sorts its groups by size and packs them
best-fit decreasing into parcels of a fixed capacity, 1/64 of a fair part.
A sorted list of remaining capacities (a binary search in blocks, the role of the
balanced tree) finds the tightest parcel.  The parcels, at most about two for each
parcel capacity of the input and one for each partition, however many rows there are, are packed the same way into shards
of the smallest capacity that needs no further shard.

Null texts have no bytes and are one group with empty texts.  Rows without an
id are left out; rows that repeat an id are rows of their own.  No rows, no shards.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.tables import texts
from pagescan.operators.ranking import numbered
from pagescan.storage import Workspace

SHARDS = 40
PARCELS = 64
ROW_BYTES = 16
UNITS_PER_PARTITION = 200_000


class Bins:
    """Bins of one capacity; `place` finds the tightest open one for a size."""

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, 0
        self._room: list[tuple[int, int]] = []  # (remaining capacity, bin), ordered

    def place(self, size: int) -> int:
        """The bin that takes the size; one beyond the capacity gets its own."""
        at = bisect_left(self._room, (size, -1))
        if at < len(self._room):
            room, name = self._room.pop(at)
        else:
            room, name = self.capacity, self.count
            self.count += 1
        if room > size:
            insort(self._room, (room - size, name))
        return name


def pack(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """Best-fit decreasing: a bin for each size, and the number of bins."""
    bins, out = Bins(capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        out[i] = bins.place(sizes[i])
    return out, bins.count


def into(sizes: list[int], shards: int) -> list[int]:
    """A bin for each size, with the smallest capacity found that needs no more than ``shards`` bins."""
    low = max([*sizes, -(-sum(sizes) // shards)], default=1)
    high = low
    while pack(sizes, high)[1] > shards:
        high += max(1, high // 100)
    while low < high:
        middle = (low + high) // 2
        if pack(sizes, middle)[1] <= shards:
            high = middle
        else:
            low = middle + 1
    return pack(sizes, high)[0]


def _parcels(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, partition = Bins(capacity), None
        for batch in batches:
            if batch.num_rows:
                partition = batch.column("partition")[0].as_py() if partition is None else partition
                names = [(partition << 32) + bins.place(size) for size in batch.column("total").to_pylist()]
                yield pa.record_batch({"key": batch.column("key"), "part": batch.column("part"), "total": batch.column("total"), "parcel": pa.array(names, pa.int64())})

    return run


def shard(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark = docs.sparkSession
    work = Workspace(spark, "shards")
    rows = work.write(
        texts(docs, id_column, text_column).select(
            "doc_id",
            (F.octet_length("text") + ROW_BYTES).cast("bigint").alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            F.md5(F.col("text").cast("binary")).alias("key"),
        ),
        "rows",
    )
    count, total = rows.agg(F.count("*"), F.sum("size")).first()
    fair = max(1, -(-(total or 0) // shards))
    capacity = max(1, fair // PARCELS)
    groups = rows.groupBy("key").agg(F.sum("size").alias("total"))
    large = work.write(groups.where(F.col("total") > fair), "large")  # fewer than ``shards`` rows
    cut = F.coalesce(F.ceil(F.col("total") / capacity), F.lit(1))
    rows = rows.join(F.broadcast(large), "key", "left").withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "text_crc32"), cut).cast("int")
    ).drop("total")
    rows = work.write(rows, "cut")
    partitions = max(1, -(-count // UNITS_PER_PARTITION))
    units = (
        rows.groupBy("key", "part").agg(F.sum("size").alias("total"))
        .withColumn("partition", F.pmod(F.xxhash64("key", "part"), F.lit(partitions)))
        .repartition(partitions, "partition")
        .sortWithinPartitions("partition", F.desc("total"), "key", "part")
    )
    # A task may get several partitions' hashes or none; each task names its parcels after its first.
    units = work.write(
        units.mapInArrow(_parcels(capacity), "key string, part int, total bigint, parcel bigint"), "units"
    )
    # At most about 2 * shards * PARCELS + partitions parcels: bounded by parameters, not by the rows' number.
    parcels = units.groupBy("parcel").agg(F.sum("total").alias("total")).orderBy("parcel").collect()
    bins = into([p["total"] for p in parcels], shards)
    plan = spark.createDataFrame([(p["parcel"], b) for p, b in zip(parcels, bins)], "parcel bigint, shard int")
    placed = units.join(F.broadcast(plan), "parcel").select("key", "part", "shard")
    out = rows.join(work.write(placed, "placed"), ["key", "part"])
    out = numbered(out.select("doc_id", "size", "text_crc32", "shard", "key"), ["doc_id", "text_crc32", "key"], ["shard"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("ordinal") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
