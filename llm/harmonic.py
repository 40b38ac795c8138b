"""Harmonic packing: classes of reciprocal capacity, each with a fixed number of documents a sequence.

A document is its ids and an end id.  Class j holds lengths from above capacity / (j + 1) to capacity / j, and a
sequence of the class takes j of them.  What pads a sequence is the difference to capacity / j.  As documents may be cut
freely, each is cut into whole sequences and the fewest pieces that are exactly capacity / j long with j a power of two
(the binary digits of its rest), so no class has any difference.

Each task packs the pieces of its own documents and needs no other: it fills the sequences of
every class in turn as texts come by and holds back only a class's open sequence, fewer than two times capacity pieces in all.  At
its end these are laid out by falling length; all sequences but the last come out full, and the last
is cut at its binary digits into sequences with powers of two, which need no padding either: at most log2(capacity) a task.

Nothing is shuffled, and a task that is run again gives the same rows.  Null and empty texts are the end id alone;
rows without an id are left out; rows that repeat an id are documents of their own; no rows, no sequences.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from llm.bpe import Cache, byte_letters
from llm.tables import texts
from llm.words import slices

LENGTH = 1024
END_ID = 0
_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_SCHEMA = ", ".join(f"{c} bigint" for c in _COLUMNS)
# How a byte-level vocabulary of this kind cuts text into words (a fixed value), its classes spelled out up to U+017F.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\\s{_L}{_N}]+|\\s+(?!\\S)|\\s+")
# Texts with other characters go to the library.
_UNUSUAL = re.compile("[^\t\n\r -~¡-ſ]")
_WORDS = 200_000  # words a worker keeps


class ByteCodec:
    """Ids of a byte-level vocabulary, as the tokenizers library gives them."""

    def __init__(self, path: str):
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        byte = byte_letters()
        ranks = {bytes(byte[c] for c in token): i for token, i in content["model"]["vocab"].items()}
        # Ids can serve as ranks if they follow the merges.
        merged = [ranks[bytes(byte[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in content["model"]["merges"]]
        usual = content["normalizer"] is None and content["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self._fast = None
        if usual and merged == sorted(merged) and len(ranks) == len(merged) + 256:
            merge = tiktoken.Encoding("bytes", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
            self._fast = Cache(lambda word: array("I", merge(word.encode())).tobytes(), _WORDS)
        self._added = [t["content"] for t in content["added_tokens"]]

    def encode(self, text: str) -> np.ndarray:
        if self._fast is None or _UNUSUAL.search(text) or any(a in text for a in self._added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(map(self._fast.__getitem__, _WORD.findall(text))), "<u4")


_CODECS: dict[str, ByteCodec] = {}


def codec(path: str) -> ByteCodec:
    """One codec per worker process and file."""
    if path not in _CODECS:
        _CODECS[path] = ByteCodec(path)
    return _CODECS[path]


def parts(tokens: int, capacity: int = LENGTH) -> list[int]:
    """The lengths that a document is cut into: whole sequences, then the binary digits of the rest."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Classes:
    """The open sequences of one task.  Rows are (doc_id, start, length, ids_crc32, doc_tokens)."""

    def __init__(self, capacity: int, first: int):
        if capacity < 1 or capacity & (capacity - 1):
            raise ValueError("the capacity must be a power of two")
        self.capacity, self.next = capacity, first
        self.open: dict[int, np.ndarray] = {}

    def add(self, rows: np.ndarray) -> np.ndarray:
        """The rows of all sequences that are now full, with their places."""
        out = [np.zeros((0, len(_COLUMNS)), np.int64)]
        for size in np.unique(rows[:, 2]).tolist():
            own = rows[rows[:, 2] == size]
            if size in self.open:
                own = np.concatenate([self.open[size], own])
            each = self.capacity // size
            full = len(own) // each * each
            place = np.arange(full)
            out.append(np.column_stack([own[:full], self.next + place // each, place % each * size]))
            self.next += full // each
            self.open[size] = own[full:]
        return np.concatenate(out)

    def close(self) -> np.ndarray:
        """The rows that were held back, the longest first."""
        held = [self.open[size] for size in sorted(self.open, reverse=True)]
        rows = np.concatenate([np.zeros((0, 5), np.int64), *held])
        end = np.cumsum(rows[:, 2])
        begin, total = end - rows[:, 2], int(rows[:, 2].sum())
        starts = list(range(0, total // self.capacity * self.capacity, self.capacity))
        at = total // self.capacity * self.capacity
        for size in parts(total % self.capacity, self.capacity):
            starts.append(at)
            at += size
        # Lengths are powers of two that fall, so no piece lies across a start.
        number = np.searchsorted(np.array(starts, np.int64), begin, side="right") - 1
        out = np.column_stack([rows, self.next + number, begin - np.array([*starts, 0], np.int64)[number]]) if len(rows) else np.zeros((0, len(_COLUMNS)), np.int64)
        self.next += len(starts)
        self.open = {}
        return out


def _packed(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(capacity, TaskContext.get().partitionId() << 40)

        def record(rows: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch({c: pa.array(rows[:, i]) for i, c in enumerate(_COLUMNS)})

        for batch in batches:
            for piece in slices(batch, "text"):
                rows = []
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                    ids = np.append(codec(path).encode(text), np.uint32(END_ID)).astype("<u4")
                    at = 0
                    for size in parts(len(ids), capacity):
                        rows.append((doc_id, at, size, zlib.crc32(ids[at : at + size]), len(ids)))
                        at += size
                if rows:
                    yield record(classes.add(np.array(rows, np.int64)))
        yield record(classes.close())

    return run


def pack(docs: DataFrame, path: str, capacity: int = LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece; ``capacity`` is a power of two."""
    return texts(docs, id_column, text_column).mapInArrow(_packed(path, capacity), _SCHEMA)
