"""Quality classifier: ridge regression on random Fourier features, calibrated by isotonic regression.

Every text becomes `STATISTICS` numbers about its bytes, words and lines, its meaning aside.  Standardised,
they pass through random Fourier features, whose inner products approximate a Gaussian kernel.
Each partition sums its part of the normal equations; the sums are
added by Spark and the small system is solved.  Isotonic regression (pool adjacent
violators) then maps raw scores to the share of good texts seen at that score, on
a part of the labelled rows that the ridge fit did not see.

Statistics cover every row and the whole text.  Fitting takes at most about `SAMPLE` labelled rows, evenly by the hash of their ids;
what reaches the driver are matrices of `FEATURES` squared numbers and 1,000 bins of scores.

A null or empty text has the statistics of an empty text and a score like any other.  Without labels
every score is 0.5; with one class only, that class.  Null labels are no labels, repeated
rows of a label count each, rows without an id are left out, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.tables import sampled, texts
from llm.words import Words, runs, slices, words
from pagescan.storage import Workspace

FEATURES = 256
SAMPLE = 100_000
RIDGE = 1e-3
WIDTH = 3.0  # of the kernel, in standard deviations over all statistics
BINS = 1000
SLICES = 64
SEED = 11
SIGNS = "!#$%&*|.,;:?-@/=<>()\"'"
STATISTICS = 18 + len(SIGNS)


def _sum_by(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values[edges[i]:edges[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[edges[1:]] - total[edges[:-1]]


def _distinct(row: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the number of distinct values and the count of the most frequent one."""
    order = np.lexsort((hashes, row))
    r, h = row[order], hashes[order]
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(r)))
    top = np.zeros(rows)
    np.maximum.at(top, r[at], size)
    return np.bincount(r[at], minlength=rows).astype(float), top


def statistics(found: Words) -> np.ndarray:
    """Rows x STATISTICS, all finite."""
    data, edges, rows = found.data, found.offsets, len(found.first) - 1
    n_bytes = np.diff(edges).astype(float)
    n = np.maximum(n_bytes, 1)
    length = (found.end - found.start).astype(float)
    n_words = np.diff(found.first).astype(float)
    w = np.maximum(n_words, 1)
    hashes, row = found.hashes(), found.row
    lines = _sum_by(data == 10, edges) + 1
    mean = _sum_by(length, found.first) / w
    distinct, top = _distinct(row, hashes, rows)
    same_row = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    repeated = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & same_row]) if len(row) else np.zeros(0, bool)
    pairs = runs(hashes, 3)
    whole = found.starts_of(3)[: len(pairs)]
    triples, _ = _distinct(row[: len(pairs)][whole], pairs[whole], rows)
    first = data[found.start] if len(row) else np.zeros(0, np.uint8)
    last = data[found.end - 1] if len(row) else np.zeros(0, np.uint8)
    upper = (data >= 65) & (data <= 90)
    plain = (last >= 97) | ((last >= 65) & (last <= 90)) | ((last >= 48) & (last <= 57))
    out = [
        np.log1p(n_bytes), np.log1p(n_words), np.log1p(lines), mean,
        np.sqrt(np.maximum(_sum_by(length * length, found.first) / w - mean * mean, 0)),
        np.log1p(n_words / lines),
        _sum_by(upper, edges) / n, _sum_by((data >= 48) & (data <= 57), edges) / n, _sum_by(data >= 128, edges) / n,
        _sum_by((data == 32) | (data == 10), edges) / n,
        distinct / w, top / w, _sum_by(repeated, found.first) / w,
        triples / np.maximum(n_words - 2, 1),
        _sum_by((first >= 65) & (first <= 90), found.first) / w, _sum_by(~plain, found.first) / w,
        _sum_by(length <= 3, found.first) / w, _sum_by(length > 12, found.first) / w,
    ]
    out += [np.sqrt(_sum_by(data == ord(s), edges) / n) for s in SIGNS]
    return np.stack(out, axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray  # raw scores at which the calibrated score steps up
    levels: np.ndarray

    def raw(self, values: np.ndarray) -> np.ndarray:
        return fourier((values - self.mean) / self.scale) @ self.weights

    def score(self, values: np.ndarray) -> np.ndarray:
        if not len(self.levels):
            return np.full(len(values), 0.5)
        return np.clip(np.interp(self.raw(values), self.edges, self.levels), 0, 1)


def fourier(values: np.ndarray, features: int = FEATURES) -> np.ndarray:
    """Random Fourier features of standardised statistics, a constant last."""
    random = np.random.default_rng(SEED)
    directions = random.standard_normal((values.shape[1], features - 1)) / WIDTH
    shift = random.uniform(0, 2 * np.pi, features - 1)
    waves = np.cos(np.clip(values, -6, 6) @ directions + shift) * np.sqrt(2 / (features - 1))
    return np.concatenate([waves, np.ones((len(values), 1))], axis=1)


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and the statistics of every row with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                values = statistics(words(piece.column("text"))).astype(np.float32)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), STATISTICS)
                yield pa.record_batch({"doc_id": piece.column("doc_id"), "statistics": flat.cast(pa.list_(pa.float32()))})

    return texts(docs, id_column, text_column).mapInArrow(run, "doc_id bigint, statistics array<float>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("statistics").flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS).astype(np.float64)


def _summed(rows: DataFrame, sums) -> np.ndarray | None:
    """The sum over all partitions of what ``sums(values, label)`` gives for a batch, an array of fixed shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = sums(_matrix(batch), batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64))
                total = part if total is None else total + part
        if total is not None:
            total = total.reshape(-1, total.shape[-1])
            yield pa.record_batch({"line": pa.array(np.arange(len(total))), "sums": pa.array(list(total), pa.list_(pa.float64()))})

    def add(key, lines):
        return lines.iloc[:1].assign(sums=[np.sum(np.stack(lines["sums"].to_list()), axis=0)])

    # One line of the matrix from each of at most SLICES partitions meets in a group.
    lines = rows.coalesce(SLICES).mapInArrow(run, "line bigint, sums array<double>")
    found = lines.groupBy("line").applyInPandas(add, "line bigint, sums array<double>").toPandas().sort_values("line")
    return np.stack(found["sums"].to_list()) if len(found) else None


def isotonic(good: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Rising levels nearest to good / all_ in weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for g, a in zip(good.tolist(), all_.tolist()):
        blocks.append([g, a, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g, a, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g, blocks[-1][1] + a, blocks[-1][2] + n]
    return np.concatenate([np.full(int(n), g / a) for g, a, n in blocks]) if blocks else np.zeros(0)


def fit(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from rows of doc_id, statistics and label (1: good, 0: not)."""
    rows = rows.where("label is not null")
    # Written, as the three sums below read it each.
    rows = Workspace(rows.sparkSession, "quality").write(sampled(rows, rows.count(), sample), "sample")
    none = Model(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(FEATURES), np.zeros(0), np.zeros(0))

    moments = _summed(rows, lambda x, y: np.stack([x.sum(0), (x * x).sum(0), np.full(x.shape[1], len(x))]))
    if moments is None:
        return none
    mean = moments[0] / moments[2]
    scale = np.sqrt(np.maximum(moments[1] / moments[2] - mean * mean, 0))
    scale[scale < 1e-9] = 1
    calibration = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = fourier((x - mean) / scale)
        return np.concatenate([z.T @ z, (z.T @ y)[None, :], np.full((1, FEATURES), len(x))])

    sums = _summed(rows.where(~calibration), equations)
    if sums is None:
        sums = _summed(rows, equations)
    system = sums[:FEATURES] + RIDGE * sums[-1, 0] * np.diag([1.0] * (FEATURES - 1) + [1e-6])
    model = Model(mean, scale, np.linalg.solve(system, sums[FEATURES]), np.zeros(0), np.zeros(0))

    low, high = -0.5, 1.5

    def histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(((model.raw(x) - low) / (high - low) * BINS).astype(int), 0, BINS - 1)
        return np.stack([np.bincount(at, weights=y, minlength=BINS), np.bincount(at, minlength=BINS).astype(float)])

    counts = _summed(rows.where(calibration), histogram)
    if counts is None:
        counts = _summed(rows, histogram)
    seen = np.flatnonzero(counts[1])
    model.edges = low + (seen + 0.5) * (high - low) / BINS
    model.levels = isotonic(counts[0][seen], counts[1][seen])
    return model


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of rows of doc_id and statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(model.score(_matrix(batch)), pa.float64())})

    return rows.select("doc_id", "statistics").mapInArrow(run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, learn_from, id_column: str = "doc_id", text_column: str = "text",
             label_column: str = "quality") -> DataFrame:
    """doc_id and score of every document; the labels whose id passes ``learn_from`` (a test on a column) are learned."""
    rows = Workspace(docs.sparkSession, "quality").write(measured(docs, id_column, text_column), "statistics")
    label = labels.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(label_column).alias("label"))
    model = fit(rows.join(label.where(learn_from(F.col("doc_id"))), "doc_id"))
    return scored(rows, model)
