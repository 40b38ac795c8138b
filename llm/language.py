"""Language ID of documents and of the spans inside mixed-language ones.

Words are scored by hashed byte trigrams, edges of the word included, and by the word itself if it is short; the
scores are log probabilities learned from labelled texts.  The script of a word, told by
the range of its lead bytes, narrows the languages: one that hardly uses the
script in the labelled texts can't have the word.  A Viterbi pass over a document's words with a
penalty for each switch finds the best sequence of languages, and so the spans.  The
document's language is the one with most letters, the score its part of them, smoothed.

Learning takes at most about `SAMPLE` labelled rows, drawn evenly by the hash of their ids; the model is
`BUCKETS` numbers for each language.  Prediction covers every row and every word.

A text without a letter, null or empty, is ``und`` with score 0, and so is every text if nothing could be learned;
`with_language` then keeps the texts with a letter.
Rows without an id are left out, repeated rows give repeated results, an empty table an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.tables import bounded, sampled, texts
from llm.words import Words, mix, slices, words

BUCKETS = 1 << 15
SAMPLE = 20_000
SWITCH = 8.0
WORST = 6.0  # a word counts at most this much against a language
SHORT = 8
SLICE = 1 << 20  # bytes of text whose words are scored at a time
NONE = "und"
# Lead-byte ranges of scripts in UTF-8: fixed values.
SCRIPTS = [
    ("latin", 0x00, 0xCC), ("greek", 0xCD, 0xCF), ("cyrillic", 0xD0, 0xD4), ("hebrew", 0xD5, 0xD7),
    ("arabic", 0xD8, 0xDD), ("indic", 0xE0, 0xE0), ("other", 0xE1, 0xE2), ("han", 0xE3, 0xE9), ("hangul", 0xEA, 0xED),
    ("rest", 0xEE, 0xFF),
]
_SCRIPT = np.zeros(256, np.uint8)
for _i, (_, _low, _high) in enumerate(SCRIPTS):
    _SCRIPT[_low : _high + 1] = _i
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages, log probabilities
    possible: np.ndarray  # scripts x languages


def _features(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, the first feature of each word, and each word's letters and script."""
    length = found.end - found.start
    first = np.cumsum(length) - length
    at = np.arange(int(length.sum())) + np.repeat(found.start - first, length)
    data = found.data
    here = data[at].astype(np.uint32)
    before = np.where(at > np.repeat(found.start, length), data[np.maximum(at - 1, 0)], 32).astype(np.uint32)
    behind = np.where(at + 1 < np.repeat(found.end, length), data[np.minimum(at + 1, len(data) - 1)], 32).astype(np.uint32)
    grams = ((before << 16 | here << 8 | behind) * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    letter = _LETTER[data[at]]
    if not len(length):
        return grams, first, np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters = np.add.reduceat(letter, first, dtype=np.int64)
    script = np.maximum.reduceat(_SCRIPT[data[at]] * (here >= 0xC3), first).astype(np.int64)
    return grams, first, letters, script


def _whole(found: Words) -> np.ndarray:
    """Bucket of each word as a whole."""
    return (mix(found.hashes(), np.uint64(7)) % np.uint64(BUCKETS)).astype(np.int64)


def word_scores(found: Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Words x languages scores, 0 for the best language of a word; letters of each word."""
    grams, first, letters, script = _features(found)
    out = np.zeros((len(first), len(model.languages)), np.float32)
    if not len(first):
        return out, letters
    short = (found.end - found.start <= SHORT)[:, None]
    own = np.where(short, model.scores[_whole(found)], 0)
    for k in range(len(model.languages)):
        out[:, k] = np.add.reduceat(model.scores[grams, k], first) + own[:, k]
    possible = model.possible[script]
    out[~possible & possible.any(axis=1)[:, None]] = -np.inf
    out -= out.max(axis=1, keepdims=True)
    np.maximum(out, -WORST, out=out)
    out[letters == 0] = 0
    return out, letters


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of every word; rows are words first[i] to first[i + 1], all rows step together."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, counts = first[:-1][order], counts[order]
    steps = int(counts[0]) if len(counts) else 0
    live = np.searchsorted(-counts, -np.arange(steps), side="left")  # rows longer than the step
    kind = np.min_scalar_type(max(scores.shape[1] - 1, 0))
    back = np.zeros(scores.shape, kind)
    best = np.zeros((len(counts), scores.shape[1]), np.float32)
    rows = np.arange(len(counts))
    itself = np.arange(scores.shape[1], dtype=kind)
    for t in range(steps):
        n = live[t]
        at, state = begin[:n] + t, best[:n]
        top = state.argmax(axis=1)
        other = state[rows[:n], top][:, None] - switch
        moved = other > state
        back[at] = np.where(moved, top[:, None], itself)
        best[:n] = np.where(moved, other, state) + scores[at]
    out = np.zeros(len(scores), kind)
    now = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        n = live[t]
        at = begin[:n] + t
        out[at] = now[:n]
        now[:n] = back[at, now[:n]]
    return out


def learn(docs: DataFrame, lang_column: str = "lang", id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE) -> Model:
    """A model from the rows with a language."""
    labelled = bounded(docs).select(
        F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    labelled = sampled(labelled, labelled.count(), sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        width = BUCKETS + len(SCRIPTS)
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                found = words(piece.column("text"), lower=True)
                grams, first, letters, script = _features(found)
                own = _whole(found)
                langs = piece.column("lang").to_pylist()
                gram_row = np.repeat(found.row, found.end - found.start)
                for lang in set(langs):
                    mine = np.array([x == lang for x in langs])
                    total = sums.setdefault(lang, np.zeros(width, np.int64))
                    total[:BUCKETS] += np.bincount(grams[mine[gram_row]], minlength=BUCKETS)
                    total[:BUCKETS] += np.bincount(own[mine[found.row] & (found.end - found.start <= SHORT)], minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(script[mine[found.row]], weights=letters[mine[found.row]], minlength=len(SCRIPTS)).astype(np.int64)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "at": pa.array(at), "n": pa.array(total[at])})

    counted = labelled.mapInArrow(count, "lang string, at bigint, n bigint").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    # At most BUCKETS + len(SCRIPTS) rows for each language.
    rows = counted.toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    counts[rows["at"].to_numpy(np.int64), np.searchsorted(languages, rows["lang"].to_numpy(str)) if languages else []] = rows["n"]
    grams, scripts = counts[:BUCKETS] + 0.5, counts[BUCKETS:]
    possible = scripts >= 0.01 * np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, np.log(grams / grams.sum(axis=0)).astype(np.float32), possible)


def _lettered(column: pa.Array) -> pa.Array:
    return pc.match_substring_regex(column, r"\p{L}").fill_null(False)


def _labels(batch: pa.RecordBatch, model: Model, switch: float, text_column: str = "text"):
    """For each row of a batch its language and score, and of its words the first in the batch and the labels."""
    rows, size = batch.num_rows, len(model.languages)
    if not size:
        return [NONE] * rows, np.zeros(rows), np.zeros(rows + 1, np.int64), np.zeros(0, np.uint8)
    share, counts, path = [np.zeros((0, size))], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    for piece in slices(batch, text_column, SLICE):
        found = words(piece.column(text_column), lower=True)
        scores, letters = word_scores(found, model)
        best = viterbi(scores, found.first, switch)
        share.append(np.bincount(found.row * size + best, weights=letters, minlength=piece.num_rows * size).reshape(-1, size))
        counts.append(np.diff(found.first))
        path.append(best)
    share, path = np.concatenate(share), np.concatenate(path)
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    total = share.sum(axis=1)
    # All bytes beyond ASCII count as letters above, so the characters are asked as well; the first letter answers.
    known = (total > 0) & _lettered(batch.column(text_column)).to_numpy(zero_copy_only=False)
    score = np.where(known, (share.max(axis=1) + 1) / (total + size), 0.0)
    return [model.languages[p] if k else NONE for p, k in zip(share.argmax(axis=1).tolist(), known.tolist())], score, first, path


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and spans (first word, word behind the last, lang) of every row with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, first, path = _labels(batch, model, switch)
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            new = np.ones(len(path), dtype=bool)
            new[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(path)).astype(np.int64)
            owner = row[begin]
            spans = pa.StructArray.from_arrays(
                [
                    pa.array(begin - first[owner], pa.int64()), pa.array(end - first[owner], pa.int64()),
                    pa.array([model.languages[i] for i in path[begin]], pa.string()),
                ],
                ["first", "last", "lang"],
            )
            offsets = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()),
                "score": pa.array(score, pa.float64()), "spans": pa.ListArray.from_arrays(offsets, spans),
            })

    schema = "doc_id bigint, lang_pred string, score double, spans array<struct<first:bigint,last:bigint,lang:string>>"
    return texts(docs, id_column, text_column).mapInArrow(run, schema)


def with_language(docs: DataFrame, model: Model, text_column: str = "text", switch: float = SWITCH) -> DataFrame:
    """The documents, all columns, whose text has a language (or a letter, if none was learned); the rows stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not model.languages:
                yield batch.filter(_lettered(batch.column(text_column)))
                continue
            names, _, _, _ = _labels(batch, model, switch, text_column)
            yield batch.filter(pa.array([name != NONE for name in names], pa.bool_()))

    return bounded(docs).mapInArrow(run, docs.schema)
