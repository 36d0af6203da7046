"""Operator 11: centroid clustering; nearest centroids by the threshold algorithm.

Vectors become integer vectors once (floor(scale * x)), written to the shared
folder.  Every round is one pass over them: tasks find each vector's nearest
centroid and hand on one row of component sums per centroid, which Spark adds
up; the driver sees the centroids alone (k * dims numbers).

Nearest centroid: in each dimension the centroids lie in a sorted list.  A
vector walks all lists at once, outward from its own value, one entry a step in
each; a centroid met for the first time gets its exact squared distance.  A
centroid not met yet is at least as far as the walk has come in every
dimension, so the walk stops when the sum of the squared frontier distances
strictly exceeds the best exact distance (strictly: an unmet centroid of a
smaller number may tie).

Defined results: vectors that are null, of another length, or hold null or
non-finite components are not kept and give no row; a null id counts as '' in
the choice of starts; repeated rows are vectors of their own, equal hashes go
by components; fewer vectors than k give as many centroids; an empty table
gives no rows; input columns other than id and vector are not read.  Integers
beyond +-2^27 would leave the range of long distances: the job fails and says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsheet.session import saved

#: Largest integer component: squared distances over 64 dimensions stay below 2^63.
LIMIT = 1 << 27
#: Cells (vectors * centroids * dimensions) of one numpy block.
CELLS = 1 << 21
FAR = 1 << 30


def integer_vectors(vectors: DataFrame, dims: int, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): the kept vectors as floor(scale * x)."""
    x = F.col(embedding).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))

    def whole(c):
        y = c * F.lit(float(scale))
        return F.when(F.abs(y) <= LIMIT, F.floor(y).cast("int")).otherwise(
            F.raise_error(F.lit(f"a component times {scale} lies beyond +-{LIMIT}")).cast("int"))

    return vectors.where((F.size(x) == dims) & finite).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


class Lists:
    """The sorted centroid list of every dimension, with an end mark on both sides."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        k, d = centroids.shape
        order = np.argsort(centroids, axis=0, kind="stable")
        ends = np.full((1, d), FAR)
        self.value = np.concatenate([-ends, np.take_along_axis(centroids, order, 0), ends])
        self.number = np.concatenate([np.zeros((1, d), int), order, np.zeros((1, d), int)])
        self.block = max(1, CELLS // max(1, k * d))

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of each vector's nearest centroid, its squared distance, and how many exact distances it took."""
        parts = [self._walk(v[i:i + self.block]) for i in range(0, len(v), self.block)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), sum(p[2] for p in parts)

    def _walk(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        (n, d), k = v.shape, len(self.c)
        dims = np.arange(d)
        up = np.stack([np.searchsorted(self.value[1:-1, j], v[:, j]) for j in range(d)], axis=1) + 1
        down = up - 1
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        met = np.zeros((n, k), bool)
        rows = np.arange(n)
        while len(rows):
            x = v[rows]
            below, above = x - self.value[down, dims], self.value[up, dims] - x
            lower = below <= above
            frontier = np.where(lower, below, above)
            entry = np.where(lower, self.number[down, dims], self.number[up, dims])
            down, up = down - lower, up + ~lower
            now = np.zeros((len(rows), k), bool)
            now[np.arange(len(rows))[:, None], entry] = True
            now &= ~met[rows]
            met[rows] |= now
            r, j = np.nonzero(now)
            far = np.full((len(rows), k), np.iinfo(np.int64).max)
            far[r, j] = ((x[r] - self.c[j]) ** 2).sum(axis=1)
            number = far.argmin(axis=1)
            distance = far[np.arange(len(rows)), number]
            better = (distance < best[rows]) | (distance == best[rows]) & (number < who[rows])
            best[rows[better]], who[rows[better]] = distance[better], number[better]
            on = ((frontier ** 2).sum(axis=1) <= best[rows]) & ~met[rows].all(axis=1)
            rows, down, up = rows[on], down[on], up[on]
        return who, best, int(met.sum())


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def component_sums(kept: DataFrame, centroids: np.ndarray) -> dict[int, tuple[list[int], int]]:
    """By centroid that has vectors: their exact component sums and their number."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, sums, count = Lists(centroids), np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(0), d)
                who, _, _ = lists.nearest(v)
                np.add.at(sums, who, v)
                count += np.bincount(who, minlength=k)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))],
                                         ["cluster", "n", "sums"])

    parts = kept.select("v").mapInArrow(run, "cluster int, n long, sums array<long>")
    cells = parts.select("cluster", "n", F.posexplode("sums")).groupBy("cluster", "pos").agg(
        F.sum(F.col("col").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out: dict[int, tuple[list[int], int]] = {}
    for r in cells.collect():  # k * dims rows
        out.setdefault(r["cluster"], ([0] * d, r["n"]))[0][r["pos"]] = int(r["s"])
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3,
            vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared),
    cluster_inertia, inertia, centroid_sha256 and centroid (its components)."""
    spark = vectors.sparkSession
    kept = saved(integer_vectors(vectors, dims, scale, vec_id, embedding))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = np.array([r["v"] for r in kept.orderBy(name, "v").select("v").limit(k).collect()], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for number, (sums, n) in component_sums(kept, centroids).items():
            moved[number] = [s // n for s in sums]
        if np.array_equal(moved, centroids):
            break  # every further round would repeat this one
        centroids = moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        for batch in batches:
            if batch.num_rows:
                who, distance, _ = lists.nearest(matrix(batch.column(1), dims))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(who, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = saved(kept.mapInArrow(run, "vec_id long, cluster int, distance long"))
    inertia = {r[0]: r[1] for r in assigned.groupBy("cluster").agg(F.sum("distance")).collect()}  # k rows
    totals = [(number, total, hashlib.sha256(",".join(map(str, centroids[number])).encode()).hexdigest(), centroids[number].tolist())
              for number, total in inertia.items()]
    totals = spark.createDataFrame(totals, "cluster int, cluster_inertia long, centroid_sha256 string, centroid array<long>")
    return assigned.join(F.broadcast(totals), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(inertia.values())).cast("long").alias("inertia"), "centroid_sha256", "centroid")
