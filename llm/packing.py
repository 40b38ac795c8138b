"""Best-fit packing of documents into token sequences, certified by lower bounds.

A document is its ids and an end id; only one longer than a sequence is cut, into whole
sequences and a rest.  Rests and short documents are dealt by hash over partitions of at most
`ITEMS` and packed there best-fit decreasing.  Dual feasible
functions over the partition's lengths give a number of sequences that no packing of
it can beat.  A partition that reaches its bound is certified and done.  One with a
gap keeps its fullest sequences and gives up the emptiest, `EXCHANGE` for each sequence of the
gap but half of all at most; what all partitions give up is dealt anew, over as few
partitions as hold it, and packed again, until nothing is given up or after `ROUNDS` rounds.

Each task holds one partition's lengths and no texts.  A null text is empty
and one end id long; rows without an id are left out; rows that
repeat an id are documents of their own; no rows, no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.bpe import encoded
from llm.sharding import Bins
from llm.tables import texts
from pagescan.storage import Workspace

LENGTH = 2048
END_ID = 0
ITEMS = 200_000
ROUNDS = 4
EXCHANGE = 8


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing of the lengths needs fewer bins: the best of several dual feasible functions."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    up_to_n, up_to_sum = np.cumsum(count), np.cumsum(count * size)
    # Sizes above capacity - cut count in full, those below cut as nothing, the rest as they are.
    cut = np.arange(0, capacity // 2 + 1)
    large = up_to_n[capacity] - up_to_n[capacity - cut]
    below = np.where(cut > 0, up_to_sum[np.maximum(cut - 1, 0)], 0)
    middle = up_to_sum[capacity - cut] - below
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, 33):
        # Multiples of capacity / (k + 1) count as they are, others rounded to the k-th parts below; all times k * capacity.
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, int(-(-(count * value).sum() // (k * capacity))))
    return best


def pieces(docs: DataFrame, path: str, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, last in encoded(batches, path):
            rows, number, start, size, crc = [], [], [], [], []
            for i in range(batch.num_rows):
                own = np.append(ids[last[i] : last[i + 1]], np.uint32(END_ID)).astype("<u4")
                for at in range(0, len(own), length):
                    part = own[at : at + length]
                    rows.append(i)
                    number.append(at // length)
                    start.append(at)
                    size.append(len(part))
                    crc.append(zlib.crc32(part))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())),
                "piece": pa.array(number, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(size, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            })

    return texts(docs, id_column, text_column).mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def fill(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing of lengths in falling order: bin and offset of each, number of bins."""
    bins, used = Bins(capacity), []
    names, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        name = bins.place(size)
        if name == len(used):
            used.append(0)
        names[i], offsets[i] = name, used[name]
        used[name] += size
    return names, offsets, bins.count


def given_up(lengths: np.ndarray, names: np.ndarray, count: int, capacity: int) -> np.ndarray:
    """Which bins are exchanged: none at the lower bound, else the emptiest, by the size of the gap."""
    gap = count - lower_bound(lengths, capacity)
    room = capacity - np.bincount(names, weights=lengths, minlength=count).astype(np.int64)
    out = np.zeros(count, dtype=bool)
    if gap > 0:
        emptiest = np.argsort(-room, kind="stable")
        out[emptiest[: min(EXCHANGE * gap, -(-count // 2))]] = True
    return out


def _packed(capacity: int, number: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        lengths = table.column("length").to_numpy()
        names, offsets, count = fill(lengths, capacity)
        free = np.zeros(count, bool) if last else given_up(lengths, names, count, capacity)
        prefix = (number << 56) + (table.column("partition")[0].as_py() << 28)
        out = pa.table({
            "row": table.column("row"), "length": table.column("length"),
            "sequence_id": prefix + names, "offset": offsets, "done": ~free[names],
        })
        yield from out.to_batches()

    return run


def pack(parts: DataFrame, capacity: int = LENGTH, items: int = ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``parts`` (a column ``length``, at most ``capacity``) plus sequence_id and offset."""
    work = Workspace(parts.sparkSession, "packing")
    stored = work.write(parts.withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = stored.where(F.col("length") == capacity)
    placed = whole.select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = stored.where(F.col("length") < capacity).select("row", "length")
    for number in range(rounds):
        count = rest.count()
        if not count:
            break
        partitions = -(-count // items)
        dealt = (
            rest.withColumn("partition", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(partitions)))
            .repartition(partitions, "partition")
            .sortWithinPartitions(F.desc("length"), "row")
        )
        run = _packed(capacity, number, number == rounds - 1)
        done = work.write(
            dealt.mapInArrow(run, "row bigint, length bigint, sequence_id bigint, offset bigint, done boolean"), f"round{number}"
        )
        placed = placed.unionByName(done.where("done").select("row", "sequence_id", "offset"))
        rest = done.where("not done").select("row", "length")
        if partitions == 1 and number + 1 < rounds:
            # One partition can't exchange with others: its own second packing would be the same.
            placed = placed.unionByName(rest.join(done, "row").select("row", "sequence_id", "offset"))
            break
    return stored.join(placed, "row").drop("row")
