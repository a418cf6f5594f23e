"""Centroid clustering on integer vectors: Lloyd's rounds with Elkan's bounds, exact to the last tie.

The table of vectors carries its state: each vector's cluster, an upper bound of the distance to its centroid and a lower
bound to every centroid. A round is one pass (no shuffle): bounds move by what the centroids moved, and a distance is only
computed if neither the bounds nor half the distance between two centroids rules it out. Bounds are doubles, rounded away
from the distance they bound, and only strict inequalities prune, so a centroid that ties is always compared; compared are
exact integers. Each task adds a row with its clusters' sums, so the driver gets a few rows for each task's table, folded by
Spark to one for each cluster and component. The table before is dropped once the next one is written.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part, nor do those
with a component beyond 2**53 after scaling; a repeated vec_id is a vector for each row; null ids take part, their hash is
the last; of rows with equal hashes the smaller vector seeds first; with fewer vectors than centroids each is a centroid;
equal centroids leave the later one empty; distances and inertia beyond a long are the largest long; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import drop_table, trimmed, written

#: The largest magnitude of a component: doubles hold all integers up to it.
LARGEST = 2**53
#: Factors that outweigh the rounding of a square root, a sum and a product.
UP, DOWN = 1 + 1e-12, 1 - 1e-12
_MOST = 2**63 - 1
_STATE = "vec_id long, v array<long>, cluster int, upper double, lower array<double>, distance decimal(38,0), n long, sums array<decimal(38,0)>"
_NUMBER = pa.decimal128(38, 0)


def quantised(vectors: DataFrame, dims: int = 64, scale: int = 1024, vector: str = "embedding") -> DataFrame:
    """vec_id, v (array<bigint> of floor(scale * x)) of the vectors that take part."""
    x = F.col(vector)
    scaled = lambda e: e.cast("double") * F.lit(float(scale))
    fine = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(scaled(e)) <= F.lit(float(LARGEST))), F.lit(False)))
    return vectors.where(F.size(x) == dims).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(scaled(e)).cast("long")).alias("v"))


def seeds(points: DataFrame, k: int = 8, salt: str = "3:") -> list[list[int]]:
    """The first centroids: the k vectors of the smallest sha256 of salt and id."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return [list(r["v"]) for r in points.orderBy(digest.asc_nulls_last(), "v").limit(k).collect()]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, as integers: in doubles or 64 bits where they suffice, else in Python's integers."""
    largest = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    bits = (2 * largest).bit_length() * 2 + max(1, a.shape[1]).bit_length()
    if bits <= 52:
        d = a.astype(np.float64) - b
        return np.einsum("ij,ij->i", d, d).astype(np.int64)
    d = (a - b).astype(np.int64 if bits <= 62 else object)
    return (d * d).sum(axis=1)


def _root(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


def between(centres: np.ndarray) -> np.ndarray:
    """Lower bounds of half the distances between centroids."""
    return np.stack([_root(squared(centres, np.broadcast_to(c, centres.shape))) for c in centres]) * (DOWN / 2)


class Assignment:
    """Cluster and bounds of some vectors, brought up to date with centroids that moved by `moved` at most."""

    def __init__(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.v, self.cluster, self.upper, self.lower = v, cluster, upper, lower
        #: Distances computed, for measurements.
        self.computed = 0

    def _distance(self, rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
        self.computed += len(rows)
        return squared(self.v[rows], np.broadcast_to(centre, (len(rows), self.v.shape[1])))

    def update(self, centres: np.ndarray, half: np.ndarray, moved: np.ndarray) -> None:
        k = len(centres)
        self.upper = (self.upper + moved[self.cluster]) * UP
        self.lower = np.maximum(self.lower - moved * UP, 0) * DOWN
        apart = np.where(np.eye(k, dtype=bool), np.inf, half).min(axis=1)
        rows = np.flatnonzero(self.upper >= apart[self.cluster])
        first = self.cluster[rows]
        best = self._distance(rows, centres[first])
        own, upper = first.copy(), _root(best) * UP
        self.lower[rows, first] = _root(best) * DOWN
        for j in range(k):
            some = np.flatnonzero((first != j) & (upper >= self.lower[rows, j]) & (upper >= half[own, j]))
            d = self._distance(rows[some], centres[j])
            self.lower[rows[some], j] = _root(d) * DOWN
            closer = (d < best[some]) | ((d == best[some]) & (j < own[some]))
            at = some[closer]
            best[at], own[at], upper[at] = d[closer], j, _root(d[closer]) * UP
        self.cluster[rows], self.upper[rows] = own, upper

    def sums(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, componentwise sums) of each cluster, as Python's integers."""
        whole = int(np.abs(self.v).max(initial=0)).bit_length() + len(self.v).bit_length() > 62
        v = self.v.astype(object) if whole else self.v
        sums = np.zeros((k, self.v.shape[1]), object)
        for j in range(k):
            sums[j] += v[self.cluster == j].sum(axis=0)
        return np.bincount(self.cluster, minlength=k).astype(object), sums


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.ravel(), kind))


def _rows(column: pa.Array, n: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(n, -1)


def _round(state: DataFrame, centres: np.ndarray, moved: np.ndarray, last: bool) -> DataFrame:
    """The state after another assignment, and a row for each cluster and task with its number of vectors and sums."""
    k, half = len(centres), between(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "v", "cluster", "upper", "lower", "distance", "n", "sums"]
        count, total = np.zeros(k, object), np.zeros(centres.shape, object)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            v = _rows(batch.column("v"), n, np.int64)
            now = Assignment(v, batch.column("cluster").to_numpy().astype(np.int64), batch.column("upper").to_numpy().copy(), _rows(batch.column("lower"), n, np.float64))
            now.update(centres, half, moved)
            none = lambda kind: pa.nulls(n, kind)
            distance = none(_NUMBER)
            if last:
                distance = pa.array([Decimal(x) for x in squared(v, centres[now.cluster]).tolist()], _NUMBER)
            else:
                c, s = now.sums(k)
                count, total = count + c, total + s
            columns = [batch.column("vec_id"), batch.column("v"), pa.array(now.cluster, pa.int32()), pa.array(now.upper), _lists(now.lower, pa.float64()), distance, none(pa.int64()), none(pa.list_(_NUMBER))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        some = np.flatnonzero(count > 0)
        if len(some):
            m = len(some)
            sums = pa.array([[Decimal(int(x)) for x in total[j]] for j in some], pa.list_(_NUMBER))
            columns = [pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int64())), pa.array(some, pa.int32()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.list_(pa.float64())), pa.nulls(m, _NUMBER), pa.array(count[some].tolist(), pa.int64()), sums]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return state.where("n IS NULL").mapInArrow(trimmed(run), _STATE)


def _means(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centroids of what the state assigns; those of empty clusters stay."""
    parts = state.where("n IS NOT NULL").select("cluster", "n", F.posexplode("sums").alias("i", "x"))
    out = centres.copy()
    for r in parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
        out[r["cluster"], r["i"]] = int(r["x"]) // r["n"]
    return out


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector that takes part."""
    points = written(quantised(vectors, dims, scale), "elkan-vectors")
    centres = np.array(seeds(points, k, salt), np.int64).reshape(-1, dims)
    k = len(centres)
    state = points.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.array_repeat(F.lit(0.0), k).alias("lower"), F.lit(None).cast("long").alias("n"))
    used, moved = points, np.zeros(k)
    for i in range(rounds + 1):
        if not k:
            break
        state = written(_round(state, centres, moved, last=i == rounds), "elkan-state")
        drop_table(used)
        used = state
        if i < rounds:
            now = _means(state, centres)
            moved = _root(squared(now, centres)) * UP
            centres = now
    if not k:
        return points.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    digests = F.array(*(F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centres.tolist()))
    most = F.lit(_MOST).cast("decimal(38,0)")
    as_long = lambda c: F.least(c, most).cast("long")
    found = state.select("vec_id", "cluster", F.least("distance", most).alias("distance"))
    # a row for each of the k clusters
    by_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("c")).collect()
    inertia = {r["cluster"]: min(int(r["c"]), _MOST) for r in by_cluster}
    whole = min(sum(int(r["c"]) for r in by_cluster), _MOST)
    of = F.array(*(F.lit(inertia.get(j, 0)).cast("long") for j in range(k)))
    return found.select("vec_id", "cluster", as_long(F.col("distance")).alias("distance"), of[F.col("cluster")].alias("cluster_inertia"), F.lit(whole).cast("long").alias("inertia"), digests[F.col("cluster")].alias("centroid_sha256"))
