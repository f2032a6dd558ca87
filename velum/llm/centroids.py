"""Centroid clustering: Lloyd's rounds over whole numbers, screened in float32 with error intervals that hold.

A vector's components become floor(SCALE * x). A task computes |c|^2 - 2 x.c for its rows and all centroids with one float32
matrix product. For a sum of n products in any order the error is at most g * |x| * |c|, g = k*u / (1 - k*u), u = 2^-24,
k = n + 2 (two more for the rounding of x and c themselves); with the errors of the float64 steps it makes an interval a
centroid. Centroids whose interval begins above the end of another one's can't be nearest; where more than one is left, their
distances are computed anew with whole numbers, the smallest number first on ties. So float32 decides nothing that it could
decide wrongly, and what overflows it is left to whole numbers.

Each round is one pass over the vectors: tasks send sums by centroid (whole numbers in limbs of 40 bits, as sums may be
larger than a long), which Spark adds up; the driver holds the centroids only.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.common import narrow, prepare

SIZE, SCALE = 64, 1024
CENTROIDS, ROUNDS = 8, 10
_LIMB = 40
_COUNT, _DISTANCE = -1, -2


def small(size: int) -> int:
    """Below this, a squared distance of ``size`` components fits a long: 2^26 for 64 of them."""
    return 1 << ((60 - (size - 1).bit_length()) // 2 - 1)


class Centroids:
    """Whole-number centroids, and what the screening needs of them."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.bound = small(len(rows[0]) if rows else 1)
        self.small = np.array([all(abs(x) < self.bound for x in r) for r in rows], bool)
        self.exact = np.array([r if ok else [0] * len(r) for r, ok in zip(rows, self.small, strict=True)], np.int64)
        with np.errstate(over="ignore"):
            self.single = np.array([[float(x) for x in r] for r in rows], np.float64).astype(np.float32)
        self.square = np.array([float(sum(x * x for x in r)) if max(map(abs, r), default=0) < 1 << 500 else np.inf for r in rows])
        self.norm = np.sqrt(self.square) * (1 + 1e-12)

    def digest(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in self.rows]

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """For rows of whole numbers in float64: which centroids may be nearest."""
        k = x.shape[1] + 2
        g = k * 2.0**-24 / (1 - k * 2.0**-24)
        with np.errstate(over="ignore", invalid="ignore"):
            dot = (x.astype(np.float32) @ self.single.T).astype(np.float64)
            size = np.sqrt(np.square(x).sum(axis=1))[:, None] * (1 + 1e-12) * self.norm
            value = self.square - 2 * dot
            error = 2.000001 * g * size + 1e-14 * (self.square + 2 * size)
            known = np.isfinite(value) & np.isfinite(error)
            low, high = np.where(known, value - error, -np.inf), np.where(known, value + error, np.inf)
        return low <= high.min(axis=1, keepdims=True)

    def _distances(self, x: np.ndarray, j: int) -> np.ndarray:
        """Squared distances to centroid j: longs where everything is small, else Python's whole numbers."""
        if self.small[j] and (np.abs(x) < self.bound).all():
            return np.square(x.astype(np.int64) - self.exact[j]).sum(axis=1)
        return np.array([sum((int(a) - b) ** 2 for a, b in zip(row, self.rows[j], strict=True)) for row in x.tolist()], dtype=object)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row, and its squared distance (longs, or objects if any is too large for one)."""
        fine = (np.abs(x) < self.bound).all(axis=1)
        if not fine.all() and fine.any():
            cluster, distance = np.zeros(len(x), np.int64), np.zeros(len(x), dtype=object)
            for part in (fine, ~fine):
                cluster[part], distance[part] = self.assign(x[part])
            return cluster, distance
        possible = self.candidates(x)
        cluster = possible.argmax(axis=1)
        open_ = np.flatnonzero(possible.sum(axis=1) > 1)
        if len(open_):
            best = self._best(x[open_], possible[open_])
            cluster[open_] = best
        distance = np.zeros(len(x), dtype=np.int64 if fine.all() and self.small.all() else object)
        for j in np.unique(cluster).tolist():
            own = cluster == j
            distance[own] = self._distances(x[own], j)
        return cluster, distance

    def _best(self, x: np.ndarray, possible: np.ndarray) -> np.ndarray:
        best, least = np.full(len(x), -1), np.zeros(len(x), dtype=object)
        for j in range(len(self.rows)):
            own = np.flatnonzero(possible[:, j])
            if len(own):
                d = self._distances(x[own], j).astype(object)
                closer = (best[own] < 0) | (d < least[own])
                best[own[closer]], least[own[closer]] = j, d[closer]
        return best


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, x) of the vectors with exactly ``size`` components, all finite, also after scaling. x holds the
    scaled components rounded down, still as doubles, which are exact."""
    v = narrow(vectors, vec_id=id_col, x=vector_col).withColumn("x", F.col("x").cast("array<double>"))
    fine = F.forall("x", lambda c: c.isNotNull() & (F.abs(c * F.lit(float(scale))) < float("inf")))  # NaN is above it
    return v.where((F.size("x") == size) & fine).withColumn("x", F.transform("x", lambda c: _floor(c * F.lit(float(scale)))))


def _floor(c):  # noqa: ANN001, ANN202
    """floor() of a double as a double: Spark's own gives a long, which is too short for large ones."""
    return F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def seeds(v: DataFrame, count: int = CENTROIDS, seed: int = 3) -> list[list[int]]:
    """The vectors with the least SHA-256 of ``seed:vec_id``; of equal ids those that are least by components. Null ids
    come last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [[int(c) for c in r.x] for r in v.select("x", digest.alias("h")).orderBy(F.asc_nulls_last("h"), "x").limit(count).collect()]


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """value = the sum of part << (_LIMB * k) over the (k, part) with a part that isn't zero; parts have its sign."""
    sign, value, k = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if part := value & ((1 << _LIMB) - 1):
            yield k, sign * part
        value >>= _LIMB
        k += 1


def sums(v: DataFrame, centroids: Centroids, size: int = SIZE) -> dict[int, dict[int, int]]:
    """For each centroid that is nearest to any vector: the sum of each component, the number of vectors (at _COUNT) and
    the sum of their squared distances (at _DISTANCE). At most (size + 2) rows a centroid and limb come to the driver."""
    sent = v.sparkSession.sparkContext.broadcast(centroids)  # some CENTROIDS vectors

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, totals = sent.value, defaultdict(int)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), size)
            cluster, distance = c.assign(x)
            whole = x.astype(np.int64) if (np.abs(x) < c.bound).all() else np.array([[int(a) for a in row] for row in x.tolist()], dtype=object)
            for j in np.unique(cluster).tolist():
                own = cluster == j
                totals[j, _COUNT] += int(own.sum())
                totals[j, _DISTANCE] += sum(distance[own].tolist())
                for d, total in enumerate(whole[own].sum(axis=0).tolist()):
                    totals[j, d] += total
        rows = [(j, d, k, part) for (j, d), total in sorted(totals.items()) for k, part in _limbs(total)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["cluster", "component", "limb", "part"])

    parts = v.select("x").mapInArrow(add, "cluster long, component long, limb long, part long")
    out: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for r in parts.groupBy("cluster", "component", "limb").agg(F.sum("part").alias("part")).collect():
        out[r.cluster][r.component] += r.part << (_LIMB * r.limb)
    sent.unpersist()
    return out


def fit(v: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE) -> Centroids:
    """Centroids after ``rounds`` rounds over rows (vec_id, x) of ``kept``. One without vectors stays where it is."""
    centroids = Centroids(seeds(v, count))
    for _ in range(rounds if centroids.rows else 0):
        found = sums(v, centroids, size)
        moved = [[found[j][d] // found[j][_COUNT] for d in range(size)] if j in found else row for j, row in enumerate(centroids.rows)]
        if moved == centroids.rows:  # nothing moves in later rounds either
            break
        centroids = Centroids(moved)
    return centroids


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """One row for each vector that ``kept`` keeps: vec_id, cluster, distance (squared), cluster_inertia and inertia
    (distances summed over the cluster and over all), centroid_sha256 (of the components, comma-joined).

    Fewer vectors than ``count``: as many centroids. Null, shorter, longer and non-finite vectors are left out; repeated
    rows each count and each get a row; a null id is a vector like others, the last to be a seed. A distance or sum that
    is too large for a long is null. An empty table gives no rows.
    """
    prepare(vectors.sparkSession)
    v = kept(vectors, id_col, vector_col, size, scale)
    centroids = fit(v, count, rounds, size)
    found = sums(v, centroids, size) if centroids.rows else {}
    long_ = lambda x: F.lit(x if x < 1 << 63 else None).cast("long")
    of_cluster = [found[j][_DISTANCE] if j in found else 0 for j in range(len(centroids.rows))]
    sent = v.sparkSession.sparkContext.broadcast(centroids)

    @F.arrow_udf("struct<cluster:int,distance:long>")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            cluster, distance = sent.value.assign(_matrix(batch, size)) if sent.value.rows else (np.zeros(0), np.zeros(0))
            columns = [pa.array(cluster.astype(np.int32)), pa.array([d if d < 1 << 63 else None for d in distance.tolist()], pa.int64())]
            yield pa.StructArray.from_arrays(columns, names=["cluster", "distance"])

    of = lambda values: F.array(*values)[F.col("a.cluster")] if values else F.lit(None)
    return v.select("vec_id", nearest("x").alias("a")).select(
        "vec_id",
        "a.cluster",
        "a.distance",
        of([long_(x) for x in of_cluster]).cast("long").alias("cluster_inertia"),
        long_(sum(of_cluster)).alias("inertia"),
        of([F.lit(x) for x in centroids.digest()]).cast("string").alias("centroid_sha256"),
    )


__all__ = ["Centroids", "clusters", "fit", "kept", "seeds", "sums"]
