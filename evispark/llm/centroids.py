"""Clusters of vectors around centroids (Lloyd's rounds) with partial-distance search in integers.

Components are integers, so distances and means are exact and reruns agree whatever the partitioning. A vector's distance to a
centroid is summed over dimensions of high variance first, and a centroid is given up as soon as its partial sum is above the best
whole distance so far. What leaves a task in a round is one row of sums for each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

DIMENSIONS, SCALE = 64, 256
#: Dimensions that are summed between two looks at the best distance, the first of them the widest.
STEPS = (16, 8, 8, 8, 8, 8, 8)
#: Components are held to this size, so that a squared distance fits in 62 bits.
LARGEST = 1 << 27


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and q: the components x of vectors with exactly 64 finite ones as integers floor(256 * x).

    Vectors that are null, of another length or with a null, NaN or infinite component are left out. Integers beyond 2^27
    are set to it. Other columns, whatever their names, are left out; repeated rows stay.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = lambda v: F.greatest(F.lit(-LARGEST / SCALE), F.least(F.lit(LARGEST / SCALE), v))
    whole = F.transform(x, lambda v: F.floor(held(v) * SCALE).cast("int"))
    return vectors.where((F.size("embedding") == DIMENSIONS) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("q"))


def first_centroids(stored: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of "seed:vec_id" (null: of "seed:"), in that order; of equal ids, by components."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return [list(r["q"]) for r in stored.select(F.sha2(name, 256).alias("h"), "q").orderBy("h", "q").limit(k).collect()]


def variances(stored: DataFrame) -> list[int]:
    """The dimensions, the one with the highest variance over all vectors first."""
    parts = [F.var_pop(F.col("q")[i].cast("double")).alias(f"v{i}") for i in range(DIMENSIONS)]
    found = stored.agg(*parts).first()
    return sorted(range(DIMENSIONS), key=lambda i: (-(found[i] or 0.0), i))


def nearest(vectors: np.ndarray, centroids: np.ndarray, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid, the smaller number of equally near ones.

    After the first dimensions in ``order`` the centroid that is nearest by them is measured in whole; all others go on
    for the rows at which their partial sum isn't above the best whole distance so far.
    """
    rows, near = np.ascontiguousarray(vectors[:, order].T), centroids[:, order]  # rows by dimension
    n, head = rows.shape[1], STEPS[0]
    partial = np.zeros((len(near), n), dtype=np.int64)
    for d in range(head):
        gap = rows[d][None, :] - near[:, d][:, None]
        partial += gap * gap
    who = partial.argmin(axis=0)
    gap = rows[head:] - near[who, head:].T
    best = partial[who, np.arange(n)] + (gap * gap).sum(axis=0)
    for c in range(len(near)):
        left = np.flatnonzero((partial[c] <= best) & (who != c))
        reached, at = partial[c][left], head
        for width in STEPS[1:]:
            if not len(left):
                break
            gap = rows[at : at + width, left] - near[c, at : at + width, None]
            reached = reached + (gap * gap).sum(axis=0)
            alive = reached <= best[left]  # given up only when strictly above
            left, reached, at = left[alive], reached[alive], at + width
        if len(left):
            won = (reached < best[left]) | (c < who[left])
            left, reached = left[won], reached[won]
            best[left], who[left] = reached, c
    return who, best


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("q"))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, DIMENSIONS)


def _pieces(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def round_sums(stored: DataFrame, centroids: list[list[int]], order: list[int]) -> dict[int, tuple[int, list[int]]]:
    """Of each centroid that has vectors, how many and the sums of their components; the driver gets one row a centroid."""
    model = np.array(centroids, dtype=np.int64)
    shared = stored.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(shared.value), DIMENSIONS), dtype=np.int64), np.zeros(len(shared.value), dtype=np.int64)
        for batch in _pieces(batches):
            vectors = _matrix(batch)
            who, _ = nearest(vectors, shared.value, order)
            by = np.argsort(who, kind="stable")
            seen, starts = np.unique(who[by], return_index=True)
            sums[seen] += np.add.reduceat(vectors[by], starts, axis=0)
            counts += np.bincount(who, minlength=len(counts))
        for c in np.flatnonzero(counts):
            yield pa.RecordBatch.from_arrays([pa.array([int(c)], pa.int32()), pa.array([int(counts[c])]), pa.array([sums[c].tolist()], pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = stored.select("q").mapInArrow(run, "cluster int, n long, sums array<long>")
    added = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(DIMENSIONS)]
    return {r["cluster"]: (r["n"], [int(r[f"s{i}"]) for i in range(DIMENSIONS)]) for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect()}


def fit(stored: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> tuple[list[list[int]], list[int]]:
    """(centroids, order of dimensions) after ``rounds`` rounds over all of ``stored`` (vec_id, q).

    Each round moves every centroid that has vectors to the floor of their mean; those without stay where they are.
    """
    centroids, order = first_centroids(stored, k, seed), variances(stored)
    for _ in range(rounds if centroids else 0):
        for c, (n, sums) in round_sums(stored, centroids, order).items():
            centroids[c] = [s // n for s in sums]
    return centroids, order


def assigned(stored: DataFrame, centroids: list[list[int]], order: list[int]) -> DataFrame:
    """vec_id, cluster and distance (squared) of each vector's nearest centroid."""
    shared = stored.sparkSession.sparkContext.broadcast(np.array(centroids, dtype=np.int64).reshape(-1, DIMENSIONS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            who, best = nearest(_matrix(batch), shared.value, order)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(who.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    return stored.select("vec_id", "q").mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """Every kept vector's vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256.

    Which vectors are kept, and what becomes of odd components, is in ``quantised``; equal ids and null ids are vectors like
    others. With fewer than ``k`` vectors each is a centroid; without any the result is empty. Sums that don't fit in a
    long are null. Integers are stored once and read in each round; the driver holds ``k`` centroids.
    """
    stored = materialise(quantised(vectors), "centroid-vectors")
    centroids, order = fit(stored, k, rounds, seed)
    found = materialise(assigned(stored, centroids, order), "centroid-clusters")
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    total = fits(sum(sums.values()))
    about = [(c, fits(s), total, names[c]) for c, s in sums.items()]
    table = found.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row a centroid.
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
