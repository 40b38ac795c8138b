"""Centroid clustering of vectors by a bisector tournament, in exact integers.

Every component x becomes floor(`SCALE` * x).  Centroids start as the `CENTROIDS` vectors with the
smallest SHA-256 of ``1:<vec_id>`` and move in `ROUNDS` rounds to the componentwise floor of their vectors' mean;
one without vectors stays.

For a pair of centroids i < j the points nearer to i lie on one side of a bisector:
|x - ci|^2 <= |x - cj|^2 exactly if x . 2(cj - ci) <= |cj|^2 - |ci|^2.  Normals and thresholds of all pairs are worked out
once a round.  A vector starts with centroid 0 as its champion and meets the others in turn; one sign
test eliminates the loser, and zero favours the smaller number, which the champion always has.  After k - 1 tests
only the nearest is left, and only its distance is computed.

Each task hands on one row of sums for each centroid; the driver sees these added up, k rows whatever the number of
vectors.  The tables between the rounds are not needed: a round reads the written integer vectors again.

Vectors with another number of components, a null or a non-finite one are left out.  Components beyond `FAR` either way
after scaling count as `FAR`, so that every distance fits 64 bits.  Vectors without an id are assigned like
others but start no centroid unless ids run out; repeated rows are vectors of their own, and of vectors with one id the one with
smaller components comes first.  Fewer vectors than `CENTROIDS` give as many centroids; no vectors, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescan.storage import Workspace

DIMENSION = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
FAR = 1 << 26
_BATCH = 4096


def whole_vectors(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", dimension: int = DIMENSION) -> DataFrame:
    """vec_id and place (array of bigint) of the vectors that count."""
    vector = F.col(vector_column).cast("array<double>")
    # A comparison with null is null, which `forall` does not take as true; NaN is above every number here.
    usable = (F.size(vector) == dimension) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    scaled = F.transform("vector", lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x, F.lit(float(FAR))), F.lit(-float(FAR))) * SCALE), F.lit(FAR)), F.lit(-FAR)))
    return (
        rows.select(F.col(id_column).cast("bigint").alias("vec_id"), vector.alias("vector"), usable.alias("usable"))
        .where("usable").select("vec_id", scaled.alias("place"))
    )


def first_centroids(vectors: DataFrame, count: int = CENTROIDS) -> np.ndarray:
    """The places of the ``count`` vectors with the smallest hashes of their ids."""
    marked = vectors.withColumn("hash", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    rows = marked.orderBy(F.asc_nulls_last("hash"), "place").limit(count).collect()
    return np.array([r["place"] for r in rows], np.int64)


class Tournament:
    """The bisectors of all pairs of centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        squares = (centroids * centroids).sum(axis=1)
        self.normals = 2 * (centroids[None, :, :] - centroids[:, None, :])  # [i, j]: 2 * (cj - ci)
        self.thresholds = squares[None, :] - squares[:, None]

    def winners(self, x: np.ndarray) -> np.ndarray:
        """The nearest centroid of each row."""
        champion = np.zeros(len(x), np.int64)
        for challenger in range(1, len(self.centroids)):
            side = np.einsum("ij,ij->i", x, self.normals[champion, challenger])
            champion[side > self.thresholds[champion, challenger]] = challenger
        return champion

    def distances(self, x: np.ndarray, winner: np.ndarray) -> np.ndarray:
        away = x - self.centroids[winner]
        return np.einsum("ij,ij->i", away, away)


def _blocks(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _BATCH):
            part = batch.slice(at, _BATCH)
            yield part, part.column("place").flatten().to_numpy().reshape(-1, dimension)


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contest, (k, dimension) = Tournament(centroids), centroids.shape
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dimension), np.int64)
        for _, x in _blocks(batches, dimension):
            winner = contest.winners(x)
            counts += np.bincount(winner, minlength=k)
            np.add.at(sums, winner, x)
        some = np.flatnonzero(counts)
        yield pa.record_batch({
            "cluster": pa.array(some, pa.int32()), "n": pa.array(counts[some]), "sums": pa.array(list(sums[some]), pa.list_(pa.int64())),
        })

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contest = Tournament(centroids)
        for part, x in _blocks(batches, centroids.shape[1]):
            winner = contest.winners(x)
            yield pa.record_batch({
                "vec_id": part.column("vec_id"), "cluster": pa.array(winner, pa.int32()), "distance": pa.array(contest.distances(x, winner)),
            })

    return run


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of exact means; one without vectors stays."""
    partial = vectors.mapInArrow(_sums(centroids), "cluster int, n bigint, sums array<bigint>")
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"sum{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for row in partial.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():  # at most k rows
        out[row["cluster"]] = [int(row[f"sum{i}"]) // row["n"] for i in range(centroids.shape[1])]
    return out


def cluster(rows: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, id_column: str = "vec_id", vector_column: str = "embedding",
            dimension: int = DIMENSION) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid (its components) of every vector that counts."""
    spark = rows.sparkSession
    work = Workspace(spark, "clusters")
    vectors = work.write(whole_vectors(rows, id_column, vector_column, dimension), "vectors")
    centroids = first_centroids(vectors, count)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    assigned = work.write(vectors.mapInArrow(_assigned(centroids), "vec_id bigint, cluster int, distance bigint"), "assigned")
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    named = [(c, inertia[c], sum(inertia.values()), centroids[c].tolist()) for c in sorted(inertia)]
    final = spark.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    # At most ``count`` rows.
    return assigned.join(F.broadcast(final), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")

