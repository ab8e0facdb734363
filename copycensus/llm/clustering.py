"""Centroid clustering of integer vectors with Ptolemaic pivot bounds.

Components become integers, so every distance, sum and mean is exact and no result depends on the order of rows. The start
vectors are the pivots of the first round and the means after it those of all later ones; a vector's squared distances to the
pivots are written beside it. Each pivot p has a fixed partner s, the pivot farthest from it. For a vector x and a centroid c
Ptolemy's inequality gives

    d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s)

which is close to d(x, p) where the centroid is close to p; the largest bound of the ``PAIRS`` pairs whose p is nearest to the
centroid counts. It is rounded down by more than the floating-point error of its few operations, so it never exceeds the true
distance. A row's centroid with the least bound is measured first; those whose bound exceeds that distance are left out, and
all others are measured exactly. Ties go to the smaller number.

Each round is one pass over the written vectors: a task folds its rows to a sum per centroid and component, and only those
``k * dims`` numbers are shuffled and come to the driver, whatever the number of rows. Vectors are never shuffled.

Defined cases: a vector that is null, has another number of components, or one that is null or not finite, is left out; so is
one with a component of ``LARGEST`` or more after scaling, as its distances could exceed 64 bits. With fewer than ``k``
vectors there are as many centroids as vectors. Repeated rows are vectors of their own; of equal hashes the one with smaller
components comes first. A row without an id is assigned and counted but starts no centroid; without any id there are no
centroids and no rows. Other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copycensus.session import materialize

#: Pairs of pivots tried for a centroid.
PAIRS = 2
LARGEST = 1 << 27
#: Rows measured at once in a task.
ROWS = 2048
#: More than the relative error of a root, two products, their difference and a quotient, by a wide margin.
SLACK = 1e-12


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows."""
    return ((x - y) ** 2).sum(axis=-1)


def pivot_pairs(pivots: np.ndarray) -> np.ndarray:
    """The farthest other pivot of each (ties: the first); itself where all are equal."""
    far = squared(pivots[:, None], pivots[None])
    return np.where(far.max(axis=1) > 0, np.argmax(far, axis=1), np.arange(len(pivots)))


def lower_bounds(rows: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Ptolemaic lower bounds of squared distances (row x centroid), never above the true ones; rows as squared distances to the pivots."""
    x = np.sqrt(rows.astype(float))
    partner = pivot_pairs(pivots)
    apart = np.sqrt(squared(pivots, pivots[partner]).astype(float))
    best = np.zeros((len(x), len(centroids)))
    for i, c in enumerate(centroids):
        own = squared(pivots, c)
        c = np.sqrt(own.astype(float))
        for p in np.argsort(own, kind="stable")[:PAIRS]:
            s = partner[p]
            if apart[p] > 0:
                one, two = x[:, p] * c[s], x[:, s] * c[p]
                np.maximum(best[:, i], (np.abs(one - two) - SLACK * (one + two)) / apart[p], out=best[:, i])
    return best * best * (1 - SLACK)


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centroid, squared distance and number of centroids measured, per row."""
    bounds = lower_bounds(to_pivots, centroids, pivots)
    first = np.argmin(bounds, axis=1)
    reach = squared(x, centroids[first])
    row, column = np.nonzero(bounds <= reach[:, None])  # holds the first one, as its bound is not above its distance
    exact = squared(x[row], centroids[column])
    order = np.lexsort((column, exact, row))
    begin = order[np.searchsorted(row, np.arange(len(x)))]
    return column[begin], exact[begin], np.bincount(row, minlength=len(x))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def integer_vectors(vectors: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """``id, components`` of the vectors that count."""
    scaled = F.transform(F.col(f"`{vector}`"), lambda v: F.floor(v.cast("double") * scale))
    x = F.col(f"`{vector}`")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) * scale < LARGEST))
    return vectors.where((F.size(x) == dims) & finite).select(
        F.col(f"`{key}`").cast("long").alias("id"), scaled.cast("array<int>").alias("components"))


def clustered(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64,
    scale: int = 64,
) -> tuple[DataFrame, np.ndarray]:
    """Rows ``id, cluster, distance, measured`` of the last assignment, and the centroids.

    Centroids start as the ``k`` vectors with the least hash of their id; ``measured`` counts exact distances of a row.
    """
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, key, vector, dims, scale)
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    start = kept.where("id IS NOT NULL").orderBy(hashed, "components").limit(k).collect()
    centroids = np.array([r["components"] for r in start], np.int64).reshape(len(start), dims)
    if not len(centroids):
        return spark.createDataFrame([], "id long, cluster int, distance long, measured int"), centroids

    def measured(pivots: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1), dims)
                far = np.stack([squared(x, p) for p in pivots], axis=1)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(pivots))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.ListArray.from_arrays(ends, pa.array(far.ravel()))], names=["id", "components", "pivots"])

        return materialize(kept.mapInArrow(run, "id long, components array<int>, pivots array<long>"))

    def parts(batch: pa.RecordBatch, now: np.ndarray, pivots: np.ndarray) -> Iterator[tuple]:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            x = _matrix(part.column(1), dims)
            yield part.column(0), x, *nearest(x, _matrix(part.column(2), len(pivots)), now, pivots)

    def moved(cached: DataFrame, now: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((len(now), dims), np.int64), np.zeros(len(now), np.int64)
            for batch in batches:
                for _, x, own, _, _ in parts(batch, now, pivots):
                    for c in np.unique(own):
                        total[c] += x[own == c].sum(axis=0)
                    n += np.bincount(own, minlength=len(now))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(some, dims)), pa.array(np.tile(np.arange(dims), len(some))), pa.array(total[some].ravel()), pa.array(np.repeat(n[some], dims))],
                names=["cluster", "component", "total", "n"])

        sums = cached.mapInArrow(fold, "cluster long, component long, total long, n long").groupBy("cluster", "component").agg(
            F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        out = now.copy()  # an empty cluster's centroid stays
        for r in sums:
            out[r["cluster"], r["component"]] = r["total"] // r["n"]
        return out

    pivots, cached = centroids, measured(centroids)
    for i in range(rounds):
        centroids = moved(cached, centroids, pivots)
        if i == 0:
            pivots, cached = centroids, measured(centroids)
    last = centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, own, distance, n in parts(batch, last, pivots):
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(own.astype(np.int32)), pa.array(distance), pa.array(n.astype(np.int32))],
                    names=["id", "cluster", "distance", "measured"])

    return materialize(cached.mapInArrow(assign, "id long, cluster int, distance long, measured int")), last


def summarised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """``<key>, cluster, distance, cluster_inertia, inertia, centroid_sha256`` per vector."""
    rows, centroids = clustered(vectors, key, vector, **options)
    spark = vectors.sparkSession
    sums = {r["cluster"]: r["n"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame(
        [(c, sums.get(c, 0), sum(sums.values()), d) for c, d in enumerate(digests)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # one row per centroid
    return rows.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
