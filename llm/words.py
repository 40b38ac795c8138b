"""Words of a batch of texts as numpy arrays, taken from the UTF-8 bytes.

A word is a maximal run of bytes other than space, tab, line feed, vertical
tab, form feed and carriage return.  Nothing here depends on Spark; the
operators call it inside tasks, one bounded batch of texts at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BATCH_BYTES = 4 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG = 64
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(state: np.ndarray, value: np.ndarray | np.uint64) -> np.ndarray:
    """A 64-bit state after one more 64-bit value."""
    state = (state ^ value) * _M1
    state ^= state >> _S
    state *= _M2
    return state ^ (state >> _S)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: none) and the len + 1 offsets of its rows."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    data: np.ndarray  # bytes of all rows
    offsets: np.ndarray  # rows + 1 byte offsets
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    first: np.ndarray  # rows + 1 offsets into the words

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every process."""
        length = self.end - self.start
        # Eight readable bytes behind every start; unaligned 64-bit reads.
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(self.data) + 1,), (1,))
        out = length.astype(np.uint64)
        live = np.flatnonzero(length <= _LONG)
        at = 0
        while len(live):
            rest = length[live] - at
            out[live] = mix(out[live], eight[self.start[live] + at] & _MASKS[np.minimum(rest, 8)])
            live = live[rest > 8]
            at += 8
        for i in np.flatnonzero(length > _LONG):
            digest = hashlib.blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest()
            out[i] = int.from_bytes(digest, "little")
        return out

    def starts_of(self, size: int) -> np.ndarray:
        """Which words begin a run of ``size`` words of their row."""
        begins = np.zeros(len(self.start), dtype=bool)
        last = np.repeat(self.first[1:], np.diff(self.first))
        begins[np.arange(len(begins)) + size <= last] = True
        return begins


def words(column: pa.Array, lower: bool = False) -> Words:
    """The words of each row; ``lower`` maps A-Z to a-z first."""
    data, offsets = flat(column)
    if lower:
        data = _LOWER[data]
    inside = np.empty(len(data) + 1, dtype=bool)
    np.logical_not(_SPACE[data], out=inside[:-1])
    inside[-1] = False
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:]
    ends = np.zeros(len(data) + 1, dtype=bool)
    ends[1:] = inside[:-1] & (~inside[1:] | edge[1:])
    start = np.flatnonzero(begins)
    return Words(data, offsets, start, np.flatnonzero(ends), np.searchsorted(start, offsets))


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` values from each place on (the array is shorter by size - 1)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(size))
    for j in range(size):
        out = mix(out, hashes[j : j + n])
    return out


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text, one row at least."""
    _, offsets = flat(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def ragged(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenated pieces data[start : start + length]."""
    total = int(length.sum())
    first = np.cumsum(length) - length
    return data[np.arange(total) + np.repeat(start - first, length)]


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column out of concatenated values and each row's size."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, kind))
