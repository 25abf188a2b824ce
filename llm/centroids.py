"""Centroid clustering of integer vectors with heap-ordered bounds.

Every vector has a gap: how much nearer its own centroid is than the next one. When centroids move, the gap of a
vector of cluster c shrinks by no more than what c's centroid and the farthest-moving other one drifted. So each cluster adds
up its drift in one offset, and a vector enters its cluster's heap with the key *gap + offset at that time*. As long
as the key is above the offset, nothing about the vector can have changed; when the offset passes it, the vector is
popped, compared with all centroids anew, and pushed with a new key into the heap of its cluster.

On Spark a heap is a written run of (cluster, key) in key order: pops take its front, so they are a filter on
``key`` that reaches the scan. A round reads the fronts only, writes what it popped as the next run, and changes the sums of
the clusters by the vectors that moved. Runs are never rewritten: an entry of an earlier run is alive while its key is above the
offset, and those below it have been popped, into a later run, when the offset passed them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Beyond this a component's squared differences, summed, may leave 64 bits; such vectors are not kept.
LARGEST = 1 << 27


def whole_numbers(vectors: DataFrame, column: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and v, floor(scale * x) of every component, of the vectors with just ``dim`` components, none null or non-finite.

    Vectors with a component beyond ``LARGEST`` after scaling are left out as well: their distances are no 64-bit numbers.
    """
    x = F.transform(column, lambda y: F.floor(y.cast("double") * scale))
    fine = F.forall(F.col(column), lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y.cast("double")) * scale <= LARGEST))
    kept = vectors.where(F.coalesce((F.size(column) == dim) & fine, F.lit(False)))
    return kept.select("vec_id", x.cast("array<int>").alias("v"))


def seeds(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors (all, if there are fewer) with the smallest sha256 of ``seed:vec_id``, ties by vec_id and components."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r.v for r in vectors.select("v", "vec_id", name.alias("h")).orderBy("h", "vec_id", "v").limit(k).collect()], np.int64)


# --- inside a task ------------------------------------------------------------------------------------------


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vector by centroid."""
    return (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)


def scan(x: np.ndarray, centroids: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid (ties: the smaller number) and its key in that cluster's heap."""
    far = squared(x, centroids)
    rows, best = np.arange(len(x)), far.argmin(1)
    upper = np.sqrt(far[rows, best].astype(float))
    rest = far.astype(float)
    rest[rows, best] = np.inf
    lower = np.sqrt(rest.min(1))
    # rounded down by far more than the doubles' error; a gap of nothing is popped at the first drift
    gap = (lower - upper) - 1e-9 * (1 + upper + np.where(np.isinf(lower), 0, lower))
    return best, np.maximum(gap + offset[best], np.nextafter(offset[best], np.inf))


def _push(rows: DataFrame, centroids: np.ndarray, offset: np.ndarray) -> DataFrame:
    """Rows (vec_id, v, was) compared with all centroids, as a written run: vec_id, v, was, cluster, key."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                best, key = scan(_matrix(batch.column("v")), centroids, offset)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.int32()), pa.array(key)], [*batch.schema.names, "cluster", "key"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    run = rows.select("vec_id", "v", "was").mapInArrow(assign, f"vec_id {kind}, v array<int>, was int, cluster int, key double")
    return stored(run.sortWithinPartitions("cluster", "key"), "heap")


def _moved(run: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What the run's vectors that changed cluster add to the clusters' sizes and sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            x = np.column_stack([np.ones(len(batch), np.int64), _matrix(batch.column("v"))]) if len(batch) else np.zeros((0, dim + 1), np.int64)
            for name, sign in (("cluster", 1), ("was", -1)):
                at = batch.column(name).to_numpy()
                np.add.at(total, at[at >= 0], sign * x[at >= 0])
        cluster, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(place, pa.int32()), pa.array(total[cluster, place])], ["cluster", "place", "n"])

    parts = run.where("cluster <> was").select("v", "was", "cluster").mapInArrow(add, "cluster int, place int, n long")
    out = np.zeros((k, dim + 1), np.int64)
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n")).collect():  # k * (dim + 1) rows at most
        out[r.cluster, r.place] = r.n
    return out[:, 0], out[:, 1:]


# --- the operator -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Clustering:
    """Final centroids, and vec_id, cluster and (squared) distance of every vector."""

    centroids: np.ndarray = field(repr=False)
    vectors: DataFrame = field(repr=False)
    #: How many vectors each assignment compared with all centroids; the first one compares all.
    scanned: tuple[int, ...] = ()


def _between(low: np.ndarray | None, high: np.ndarray | None) -> Column:
    """Entries of a run above their cluster's ``low`` and up to its ``high``."""
    k = len(high if low is None else low)
    sides = []
    for c in range(k):
        test = F.col("cluster") == c
        if low is not None:
            test &= F.col("key") > float(low[c])
        if high is not None:
            test &= F.col("key") <= float(high[c])
        sides.append(test)
    return reduce(Column.__or__, sides)


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> Clustering:
    """Lloyd's rounds over integer vectors (vec_id, v; other columns are not read), exact, and a last assignment.

    A round assigns every vector to its nearest centroid, ties to the smaller number, and moves each centroid with vectors to
    the floor of their mean; an empty one stays. Rows of one vec_id are vectors of their own; a null vec_id is kept. With fewer
    than k vectors each starts a cluster. Without vectors there are no clusters. Vectors have the same number of components.
    """
    centers = seeds(vectors, k, seed)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not len(centers):
        return Clustering(centers, vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long"))
    offset = np.zeros(len(centers))
    runs = [_push(vectors.select("vec_id", "v", F.lit(-1).alias("was")), centers, offset)]
    count, total = _moved(runs[0], *centers.shape)
    for _ in range(rounds):
        moved = centers.copy()
        some = count > 0
        moved[some] = total[some] // count[some, None]
        drift = np.sqrt(((moved - centers) ** 2).sum(1).astype(float))
        others = np.array([np.delete(drift, c).max(initial=0) for c in range(len(drift))])
        centers, before, offset = moved, offset, offset + drift + others
        expired = [r.where(_between(before, offset)).select("vec_id", "v", F.col("cluster").alias("was")) for r in runs]
        runs.append(_push(reduce(DataFrame.union, expired), centers, offset))
        more, change = _moved(runs[-1], *centers.shape)
        count, total = count + more, total + change

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                own = _matrix(batch.column("v")) - centers[batch.column("cluster").to_numpy()]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array((own * own).sum(1))], ["vec_id", "cluster", "distance"])

    alive = reduce(DataFrame.union, [r.where(_between(offset, None)).select("vec_id", "v", "cluster") for r in runs])
    out = stored(alive.mapInArrow(measure, f"vec_id {kind}, cluster int, distance long"), "clusters")
    return Clustering(centers, out, tuple(r.count() for r in runs))
