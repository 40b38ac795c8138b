"""Substring dedup: words covered by a run of 13 words that an earlier document has too are removed.

A compressed FM-index per shard answers for every window of 13 words how far it is
matched (its matching statistics, up to the threshold) and in which documents.  Backward search goes word by word over
a wavelet matrix of packed bits; a window whose matches stay above the
threshold is reported with the smallest id it occurs under, any other is its own first.

Documents reach the shards by content.  Each window has a minimizer, the least hash of its runs of five words, so
equal windows have the same one wherever they are.  Consecutive windows with one minimizer are a
segment.  A minimizer that only one document has settles its windows; the segments
of all others go to the shard of their minimizer, where the index holds each distinct segment once,
with its smallest id.  What a batch of documents repeats is combined before it is shuffled, on both ways, so a passage that a
third of all documents share costs a row for each batch.  A task builds its index over `SYMBOLS` words at a time.
A minimizer whose segments hold more words than that, as at the border of a passage that many documents have between
words of their own, is hot: its segments are cut into single windows, which are dealt by their own hash.  These are counted before, from the
minimizers with `REPORTED` segments or more in a piece of `PIECE` bytes of text.

The text is shuffled once, by id, for the segments and for the result.  Words are told apart by 64-bit hashes on the
way and by 32 of these bits inside an index, where a mix-up would need twelve equal words around it.

Null texts have no words.  Rows without an id are left out.  Rows that repeat an id
each have a row in the result and never count as earlier than each other.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.tables import texts
from llm.words import Words, lists, mix, ragged, runs, slices, words

WINDOW = 13
SEED = 5  # words whose hash can be a minimizer
LONGEST = 256  # windows of a segment
SYMBOLS = 2_000_000
REPORTED = 4
PIECE = 16 << 20


class FmIndex:
    """Counts and places of word runs in a sequence of symbols (0 separates segments)."""

    def __init__(self, symbols: np.ndarray, depth: int = WINDOW):
        n = len(symbols)
        # Suffixes sorted by their first ``depth`` symbols or more; backward search up to that length needs no more.
        rank, length = symbols.astype(np.int64), 1
        while length < depth:
            behind = np.zeros(n, np.int64)
            behind[: max(n - length, 0)] = rank[length:] + 1
            key = rank << 32 | behind
            order = np.argsort(key)
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            length *= 2
        self.suffixes = order
        count = np.bincount(symbols)
        before = np.cumsum(count) - count
        self._levels = max(1, int(len(count) - 1).bit_length())
        self._words, self._blocks, self._zeros = [], [], []
        row = symbols[order - 1]  # the Burrows-Wheeler transform
        for level in reversed(range(self._levels)):
            bit = row >> level & 1
            packed = np.packbits(np.concatenate([bit.astype(np.uint8), np.zeros(64 + -n % 64, np.uint8)]), bitorder="little").view(np.uint64)
            ones = np.bitwise_count(packed).astype(np.int32)
            self._words.append(packed)
            self._blocks.append((np.cumsum(ones) - ones).astype(np.int32))
            self._zeros.append(n - int(ones.sum()))
            one = bit.astype(bool)
            row = np.concatenate([row[~one], row[one]])
        every = np.arange(len(count))
        self._shift = before - self._descend(every, np.zeros(len(count), np.int64))
        self._first, self._last = before, before + count

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for i, level in enumerate(reversed(range(self._levels))):
            block = place >> 6
            inside = self._words[i][block] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1))
            ones = self._blocks[i][block] + np.bitwise_count(inside)
            place = np.where(symbol >> level & 1, self._zeros[i] + ones, place - ones)
        return place

    def search(self, runs_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of equally long rows of symbols: matched length, first and last place.

        A search stops when the run occurs once only: its matching statistics end there.
        """
        size = runs_.shape[1]
        low, high = self._first[runs_[:, -1]], self._last[runs_[:, -1]]
        matched = np.ones(len(runs_), np.int64)
        live = np.flatnonzero(high - low > 1)
        for j in range(size - 2, -1, -1):
            if not len(live):
                break
            symbol = runs_[live, j]
            both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            low[live] = both[: len(live)] + self._shift[symbol]
            high[live] = both[len(live) :] + self._shift[symbol]
            matched[live] += 1
            live = live[high[live] - low[live] > 1]
        return matched, low, high


def first_documents(codes: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of the segments, one after the other, the smallest id that has it; windows per segment.

    ``codes``: the segments' words, ``sizes``: their numbers, ``docs``: their smallest ids.
    """
    _, symbols = np.unique(codes, return_inverse=True)
    first = np.cumsum(sizes) - sizes
    # A separator behind each segment.
    at = np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)
    sequence = np.zeros(len(codes) + len(sizes), np.int64)
    sequence[at] = symbols + 1
    owner = np.zeros(len(sequence), np.int64)
    owner[at] = np.repeat(docs, sizes)
    counts = sizes - WINDOW + 1
    start = np.arange(int(counts.sum())) + np.repeat(first + np.arange(len(sizes)) - (np.cumsum(counts) - counts), counts)
    # Equal windows are searched for once.
    _, one, which = np.unique(runs(sequence.astype(np.uint64), WINDOW)[start], return_index=True, return_inverse=True)
    index = FmIndex(sequence)
    asked = start[one]
    matched, low, high = index.search(sequence[asked[:, None] + np.arange(WINDOW)])
    out = owner[asked]
    above = np.flatnonzero((matched >= WINDOW) & (high - low > 1))
    if len(above):
        order = above[np.argsort(low[above])]
        bounds = np.stack([low[order], high[order]], axis=1).ravel()
        ids = np.append(owner[index.suffixes], np.iinfo(np.int64).max)
        out[order] = np.minimum.reduceat(ids, bounds)[::2]
    return out[which], counts


def segments(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, row, first word (of all) and windows of every segment."""
    hashes = found.hashes()
    least = runs(hashes, SEED)
    width, have = WINDOW - SEED + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        have += step
    at = np.flatnonzero(found.starts_of(WINDOW)[: len(least)])
    least, row = least[at], found.row[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    offset = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    begin = np.flatnonzero(offset % LONGEST == 0)
    return least[begin], row[begin], at[begin], np.diff(np.append(begin, len(at)))


def _short(seed: np.ndarray) -> np.ndarray:
    """The upper 32 bits of a minimizer: enough to find it again in its document and to place it."""
    return (seed >> np.uint64(32)).astype(np.int64)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place, doc_id, seed: where each minimizer is compared with other batches, and whose it is.

    A minimizer of one document of the piece is compared at its own place, its upper 48 bits, and needs no seed.  One
    of several documents is known to be repeated: it leaves one note (no doc_id) at its place, and its rows,
    with their seed, take no place of their own.
    """
    for batch in batches:
        for piece in slices(batch, "text", PIECE):
            seeds, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for part in slices(piece, "text"):
                seed, row, _, _ = segments(words(part.column("text")))
                seeds.append(seed)
                ids.append(part.column("doc_id").to_numpy()[row])
            seed, doc = np.concatenate(seeds), np.concatenate(ids)
            order = np.lexsort((doc, seed))
            seed, doc = seed[order], doc[order]
            new = np.ones(len(seed), dtype=bool)
            new[1:] = (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])
            seed, doc = seed[new], doc[new]
            new = np.ones(len(seed), dtype=bool)
            new[1:] = seed[1:] != seed[:-1]
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(seed)))
            known = np.repeat(size > 1, size)
            notes = seed[begin[size > 1]]
            place = np.concatenate([np.where(known, mix(seed, doc.view(np.uint64)), seed), notes]) >> np.uint64(16)
            note = np.arange(len(place)) >= len(doc)
            yield pa.record_batch({
                "place": pa.array(place.view(np.int64)),
                "doc_id": pa.array(np.concatenate([doc, np.zeros(len(notes), np.int64)]), mask=note),
                "seed": pa.array(np.concatenate([_short(seed), _short(notes)]), mask=note | ~np.concatenate([known, note[len(doc) :]])),
            })


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the minimizers (upper bits) it shares with another document."""
    rows = docs.mapInArrow(_sampled, "place bigint, doc_id bigint, seed bigint")
    # At most a row for each batch of documents has a minimizer's place.
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("place")))
    rows = rows.where("doc_id is not null and (seed is not null or n > 1)")
    own = F.shiftright("place", 16)
    return rows.groupBy("doc_id").agg(F.collect_list(F.coalesce("seed", own)).alias("seeds"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words in the segments of each minimizer (upper bits) that a piece repeats."""
    for batch in batches:
        for piece in slices(batch, "text", PIECE):
            seeds, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for part in slices(piece, "text"):
                seed, _, _, count = segments(words(part.column("text")))
                seeds.append(_short(seed))
                sizes.append(count + WINDOW - 1)
            seed, which, times = np.unique(np.concatenate(seeds), return_inverse=True, return_counts=True)
            total = np.bincount(which, weights=np.concatenate(sizes), minlength=len(seed)).astype(np.int64)
            often = times >= REPORTED
            yield pa.record_batch({"seed": pa.array(seed[often]), "n": pa.array(total[often])})


def hot_minimizers(docs: DataFrame) -> np.ndarray:
    """The minimizers (upper bits) of more than `SYMBOLS` words; at most all words / `SYMBOLS` of them."""
    counted = docs.select("text").mapInArrow(_counted, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n"))
    return np.array(sorted(row["seed"] for row in counted.where(F.col("n") > SYMBOLS).select("seed").collect()), np.int64)


def _chosen(piece: pa.RecordBatch, hot: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The segments of the rows whose minimizer is among the row's seeds, and which are single windows of a hot one."""
    found = words(piece.column("text"))
    seed, row, first, count = segments(found)
    seed, own = _short(seed), piece.column("seeds")
    owner = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy(zero_copy_only=False))
    wanted = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + (owner << 32)
    keep = np.isin(seed + (row << 32), wanted)
    seed, row, first, count = seed[keep], row[keep], first[keep], count[keep]
    cut = np.isin(seed, hot)
    times = np.where(cut, count, 1)
    inside = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    count = np.where(cut, 1, count)
    return found, np.repeat(seed, times), np.repeat(row, times), np.repeat(first, times) + inside, np.repeat(count, times), np.repeat(cut, times)


def _keys(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit key of each segment."""
    if not len(sizes):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(sizes) - sizes
    place = (np.arange(len(codes)) - np.repeat(begin, sizes)).astype(np.uint64)
    return mix(np.add.reduceat(mix(codes.astype(np.uint64), place), begin), sizes.astype(np.uint64))


def _codes(found: Words, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments' words as 32-bit codes, one after the other, and their numbers."""
    sizes = count + WINDOW - 1
    return ragged((found.hashes() >> np.uint64(32)).astype(np.uint32), first, sizes), sizes


def _to_shards(hot: np.ndarray):
    """Each distinct segment of a piece with its smallest id and, if others have it too, its largest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 8 << 20):
                found, seed, row, first, count, cut = _chosen(piece, hot)
                codes, sizes = _codes(found, first, count)
                if not len(sizes):
                    continue
                keys, doc = _keys(codes, sizes), piece.column("doc_id").to_numpy()[row]
                order = np.lexsort((doc, keys))
                begin = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
                one, low = order[begin], doc[order[begin]]
                high = doc[order[np.append(begin[1:], len(order)) - 1]]
                starts = np.cumsum(sizes) - sizes
                packed = ragged(codes, starts[one], sizes[one]).astype("<u4").tobytes()
                offsets = np.concatenate([[0], np.cumsum(sizes[one] * 4)]).astype(np.int32)
                yield pa.record_batch({
                    "shard": pa.array(np.where(cut, keys.view(np.int64), seed)[one]), "low": pa.array(low), "high": pa.array(high, mask=high == low),
                    "codes": pa.BinaryArray.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]),
                })

    return run


def _occurrences(hot: np.ndarray):
    """Where each segment is: doc_id, version (hash) of its text, first word, and its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 8 << 20):
                found, _, row, first, count, _ = _chosen(piece, hot)
                keys = _keys(*_codes(found, first, count))
                yield pa.record_batch({
                    "doc_id": piece.column("doc_id").take(pa.array(row)), "version": piece.column("version").take(pa.array(row)),
                    "first": pa.array((first - found.first[row]).astype(np.int32)), "key": pa.array(keys.view(np.int64)),
                })

    return run


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and, for each window of the segment, the smallest id; batches are sorted by shard."""
    held: list[pa.RecordBatch] = []

    def answer() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        data = table.column("codes").combine_chunks()
        data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
        codes = np.frombuffer(b"".join(data.to_pylist()), "<u4")
        sizes = pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
        firsts, counts = first_documents(codes, sizes, low)
        # A segment of one document that nobody has earlier needs no answer.
        wanted = np.minimum.reduceat(firsts, np.cumsum(counts) - counts) < high
        return pa.record_batch({
            "key": pa.array(_keys(codes, sizes)[wanted].view(np.int64)),
            "firsts": lists(firsts[np.repeat(wanted, counts)], counts[wanted], pa.int64()),
        })

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        shard = batch.column("shard").to_numpy()
        same = held and held[-1].column("shard")[-1].as_py() == shard[0]
        cut = int(np.searchsorted(shard != shard[0], True)) if same else 0
        if held and size > SYMBOLS and cut < len(shard):
            if cut:
                held.append(batch.slice(0, cut))
            yield answer()
            held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.column("codes").nbytes // 4
    if held:
        yield answer()


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, version, found in zip(batch.column("text"), batch.column("version"), batch.column("windows")):
            own = text.as_py().encode().split()
            keep = np.ones(len(own), dtype=bool)
            if found.is_valid:
                edges = np.zeros(len(own) + 1, np.int64)
                for item in found.as_py():
                    if item["version"] == version.as_py():
                        at = np.array(item["at"], np.int64)
                        np.add.at(edges, at, 1)
                        np.add.at(edges, at + WINDOW, -1)
                keep = np.cumsum(edges[:-1]) == 0
            n_words.append(len(own))
            n_removed.append(int((~keep).sum()))
            kept.append(b" ".join(compress(own, keep.tolist())).decode())
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string()),
        })


def sharded(shared: DataFrame, hot: np.ndarray) -> DataFrame:
    """shard, codes, low and high of each distinct segment, each shard in one partition."""
    shards = shared.mapInArrow(_to_shards(hot), "shard bigint, low bigint, high bigint, codes binary")
    # Grouped where it is: the shards are the partitions by the column.
    return (
        shards.repartition("shard").groupBy("shard", "codes")
        .agg(F.min("low").alias("low"), F.max(F.coalesce("high", "low")).alias("high"))
        .sortWithinPartitions("shard")
    )


def remove(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the kept words, joined by a space) of every row with an id."""
    rows = texts(docs, id_column, text_column).withColumn("version", F.hash("text"))
    shared = rows.join(candidates(rows.select("doc_id", "text")), "doc_id")
    hot = hot_minimizers(rows)
    answers = sharded(shared, hot).mapInArrow(_indexed, "key bigint, firsts array<bigint>")
    places = shared.mapInArrow(_occurrences(hot), "doc_id bigint, version int, first int, key bigint")
    at = F.filter(
        F.transform("firsts", lambda f, i: F.when(f < F.col("doc_id"), F.col("first") + i)), lambda p: p.isNotNull()
    )
    windows = (
        places.join(answers, "key").select("doc_id", F.struct("version", at.alias("at")).alias("w"))
        .where(F.size("w.at") > 0).groupBy("doc_id").agg(F.collect_list("w").alias("windows"))
    )
    return rows.join(windows, "doc_id", "left").mapInArrow(
        _removed, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"
    )
