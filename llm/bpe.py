"""BPE encoding and decoding by forced-boundary splitting.

From the vocabulary comes a table of all byte pairs that occur inside some token.
A pair that occurs in none is a certain cut: no merge can ever join its two bytes.
Cuts are made where such a pair has white space, a digit, or a letter next to a sign, so that both
sides are whole words to the tokenizer (a cut between two letters
would need the end-of-word mark left out, so none is made there).
A batch of texts is cut at once, by one look-up for each byte.  Fragments are encoded independently, each distinct one
of a batch once, and a worker keeps what it has encoded in a bounded pool; then the ids are joined.

A fragment of letters alone is merged by a byte-pair merger that is given the
vocabulary as ranks, with byte 0xFF (which UTF-8 never has) for the
end-of-word mark; other fragments go to the tokenizers library.  So do, word by word, texts with
characters beyond ASCII and the Latin letters below U+0100, with control characters, or with
special tokens; these are matched in the raw text first, as the library does.
Fragments are told apart by 64-bit hashes.  Decoding goes from ids through the table of tokens.

Null and empty texts have no ids.  Texts are taken whole, whatever their length.
Rows without an id are left out of `coded`; a repeated row gives a repeated result.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame

from llm.tables import texts
from llm.words import Words, flat, ragged, slices

END = "</w>"
POOL = 2_000_000  # fragments a worker keeps
WORDS = 100_000  # words of unusual texts a worker keeps
BATCH = 1 << 20  # bytes of text that are encoded at a time
_WHITE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    out[33:127] = _SIGN
    out[48:58] = _DIGIT
    out[65:91] = out[97:123] = out[128:] = _LETTER
    out[[9, 10, 11, 12, 13, 32]] = _WHITE
    return out


_CLASS = _classes()


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Cache(dict):
    """Ids (little-endian 32-bit) by word; emptied when full."""

    def __init__(self, make, limit: int):
        super().__init__()
        self._make, self._limit = make, limit

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self._limit:
            self.clear()
        self[word] = ids = self._make(word)
        return ids


class Codec:
    """Encodes and decodes as the tokenizers library does with this file."""

    def __init__(self, path: str):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        byte = byte_letters()

        def raw(token: str) -> bytes:
            end = token.endswith(END)
            return bytes(byte[c] for c in (token[: -len(END)] if end else token)) + b"\xff" * end

        tokens = {raw(t): i for t, i in content["model"]["vocab"].items()}
        inside = np.zeros((256, 256), dtype=bool)
        for token in tokens:
            token = token.rstrip(b"\xff")
            for pair in zip(token, token[1:]):
                inside[pair] = True
        left, right = _CLASS[:, None], _CLASS[None, :]
        self.cuts = ~inside & ((left != right) | (left == _DIGIT))
        white = _CLASS == _WHITE
        assert self.cuts[white][:, ~white].all() and self.cuts[~white][:, white].all()
        self._merge, self._merged_ids = self._merger(content["model"], tokens, raw)
        self.special = {t["content"]: t["id"] for t in content["added_tokens"] if t["special"]}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self._openings = {s.encode()[:2] for s in self.special}
        self.table = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(True))]
        self._words = Cache(self._by_library, WORDS)
        self._empty_pool()

    @staticmethod
    def _merger(model: dict, tokens: dict, raw):
        """Ranks: the 256 bytes, the bytes that end a word, then the merges in their order."""
        ranks = {bytes([b]): b for b in range(256)}
        for b in range(255):
            ranks[bytes([b, 255])] = len(ranks)
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            ranks.setdefault(raw(left + right), len(ranks))
        core = tiktoken.Encoding("fragments", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        return core._core_bpe.encode_single_piece, [tokens.get(t, -1) for t in ranks]

    def _by_library(self, fragment: str) -> bytes:
        return array("I", self.tokenizer.encode(fragment, add_special_tokens=False).ids).tobytes()

    def _one(self, fragment: bytes) -> list[int]:
        """The ids of a fragment of lower-case text."""
        if (_CLASS[np.frombuffer(fragment, np.uint8)] == _LETTER).all() if len(fragment) > 64 else fragment.decode().isalpha():
            ids = self._merged_ids
            return [ids[i] for i in self._merge(fragment + b"\xff")]
        return self.tokenizer.encode(fragment.decode(), add_special_tokens=False).ids

    def _empty_pool(self) -> None:
        self._known = np.zeros(0, np.uint64)  # sorted hashes
        self._start, self._size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._pool = np.zeros(0, np.uint32)

    def encode(self, text: str) -> bytes:
        """The ids of any text, word by word through the library, as little-endian unsigned 32-bit integers."""
        parts = self._special.split(text) if self.special else [text]
        return b"".join(
            array("I", [self.special[part]]).tobytes() if part in self.special
            else b"".join([self._words[w] for w in re.split("[ \t-\r]+", part) if w])
            for part in parts
        )

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, special tokens included."""
        table = self.table
        return " ".join([table[i] for i in ids.tolist()])

    def _fragments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
        """The fragments of the rows, lower-cased, and the rows that need the library throughout."""
        before = np.concatenate([[np.uint8(0)], data[:-1]])
        latin = (before == 0xC3) & (data >= 0x80) & (data != 0x97) & (data != 0xB7)
        odd = (_CLASS[data] == _OTHER) | ((data >= 0x80) & (data != 0xC3) & ~latin)
        for opening in self._openings:
            odd |= (before == opening[0]) & (data == opening[1])
        unusual = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1)
        data = data + (((data >= 65) & (data <= 90)) | (latin & (data <= 0x9E))) * np.uint8(32)
        solid = np.ones(len(data) + 1, dtype=bool)
        solid[:-1] = _CLASS[data] != _WHITE
        solid[-1] = False
        for row in unusual:
            solid[offsets[row] : offsets[row + 1]] = False
        edge = np.ones(len(data) + 1, dtype=bool)  # between a byte and the one before it
        edge[1:-1] = self.cuts[data[:-1], data[1:]]
        edge[offsets] = True
        start = np.flatnonzero(solid & edge)
        end = np.flatnonzero(solid[:-1] & edge[1:]) + 1
        return Words(data, offsets, start, end, np.searchsorted(start, offsets)), unusual

    def _look_up(self, found: Words) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of each fragment start, and how many there are."""
        if len(self._known) > POOL:
            self._empty_pool()
        distinct, one, which = np.unique(found.hashes(), return_index=True, return_inverse=True)
        place = np.searchsorted(self._known, distinct)
        new = np.ones(len(distinct), dtype=bool)
        within = place < len(self._known)
        new[within] = self._known[place[within]] != distinct[within]
        if new.any():
            raw = found.data.tobytes()
            ids = [self._one(raw[s:e]) for s, e in zip(found.start[one[new]].tolist(), found.end[one[new]].tolist())]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            start = len(self._pool) + np.cumsum(size) - size
            self._pool = np.concatenate([self._pool, np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))])
            self._known = np.insert(self._known, place[new], distinct[new])
            self._start = np.insert(self._start, place[new], start)
            self._size = np.insert(self._size, place[new], size)
            place = np.searchsorted(self._known, distinct)
        return self._start[place][which], self._size[place][which]

    def encode_rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the rows + 1 offsets into them."""
        data, offsets = flat(column)
        found, unusual = self._fragments(data, offsets)
        start, size = self._look_up(found)
        ids = ragged(self._pool, start, size)
        last = np.concatenate([[0], np.cumsum(size)])[found.first]
        if not len(unusual):
            return ids, last
        raw, pieces, counts = data.tobytes(), [], np.diff(last)
        for row in range(len(counts)):
            pieces.append(ids[last[row] : last[row + 1]])
        for row in unusual:
            pieces[row] = np.frombuffer(self.encode(raw[offsets[row] : offsets[row + 1]].decode()), np.uint32)
            counts[row] = len(pieces[row])
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum(counts)])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of the batches with their ids and the rows + 1 offsets into these."""
    for batch in batches:
        for piece in slices(batch, "text", BATCH):
            yield piece, *codec(path).encode_rows(piece.column("text"))


def coded(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) of every row with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, ids, last in encoded(batches, path):
            for i in range(piece.num_rows):  # a row at a time, as its arrays may be long
                own = ids[last[i] : last[i + 1]]
                yield pa.record_batch({
                    "doc_id": piece.column("doc_id").slice(i, 1),
                    "ids": pa.array([own.view(np.int32)], pa.list_(pa.int32())),
                    "decoded": pa.array([codec(path).decode(own)], pa.string()),
                })

    return texts(docs, id_column, text_column).mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row with an id, without moving ids out of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, ids, last in encoded(batches, path):
            own = [ids[a:b] for a, b in zip(last, last[1:])]
            yield pa.record_batch({
                "doc_id": piece.column("doc_id"),
                "n_tokens": pa.array(np.diff(last), pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4")).hexdigest() for x in own], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(codec(path).decode(x).encode()).hexdigest() for x in own], pa.string()),
            })

    return texts(docs, id_column, text_column).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
