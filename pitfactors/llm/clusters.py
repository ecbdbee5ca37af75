"""Centroid clustering by a bisector tournament.

Vectors are integers, so every comparison is exact.  For each pair of centroids a < b the
integer normal 2(b - a) and the threshold |b|² - |a|² are computed once; b is nearer to a
vector exactly when normal · vector exceeds the threshold.  A vector meets the centroids in
ascending order: the winner so far against the next one, k - 1 sign tests in all, and a test
that comes out at zero keeps the winner, which has the smaller number.  Only the distance to
the last winner is computed.

A round reads the vectors once.  Each task adds up its vectors per centroid and sends one
number per centroid and component; those are summed by Spark, and k * dim of them, whatever
the size of the table, reach the driver as the next centroids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitfactors.functions.scale import stable

#: Whole numbers travel to Spark's sums in signed pieces of so many bits, so no sum is rounded.
PIECE_BITS = 48


@dataclass(frozen=True)
class Clustering:
    centroids: int = 16
    rounds: int = 3
    dim: int = 64
    scale: int = 64  # a component x becomes floor(scale * x)
    seed: int = 1  # first centroids: smallest SHA-256 of "seed:id"


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component: 64-bit where all squares stay in range, else Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors.astype(np.float64) * scale)
    if fits(vectors.shape[1], np.abs(scaled).max(initial=0)):
        return scaled.astype(np.int64)
    flat = [int(s) if abs(s) < 2.0**53 else int(x) * scale for s, x in zip(scaled.ravel().tolist(), vectors.astype(np.float64).ravel().tolist())]
    return np.array(flat + [None], dtype=object)[:-1].reshape(vectors.shape)


def fits(dim: int, largest: float) -> bool:
    """True when 4 * dim * largest², the bound of normals times vectors, is far from 64 bits."""
    return 4.0 * dim * float(min(largest, 1e100)) ** 2 < 2.0**61


class Bisectors:
    """Normals and thresholds of all pairs of centroids, and the tournament over them."""

    def __init__(self, centroids: list[list[int]], dim: int):
        points = np.array(centroids, dtype=object).reshape(len(centroids), dim)
        square = (points * points).sum(axis=1)
        self.exact = points, 2 * (points[None, :, :] - points[:, None, :]), square[None, :] - square[:, None]
        self.small = fits(dim, max((abs(x) for c in centroids for x in c), default=0))
        self.fast = tuple(x.astype(np.int64) for x in self.exact) if self.small else None

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each vector, and the squared distance to it."""
        fast = self.small and vectors.dtype != object
        points, normals, thresholds = self.fast if fast else self.exact
        vectors = vectors if fast else vectors.astype(object)
        winner = np.zeros(len(vectors), dtype=np.int64)
        for rival in range(1, len(points)):
            beaten = (normals[winner, rival] * vectors).sum(axis=1) > thresholds[winner, rival]
            winner[beaten.astype(bool)] = rival
        gap = vectors - points[winner]
        return winner, (gap * gap).sum(axis=1)


def _matrices(batches: Iterator[pa.RecordBatch], c: Clustering) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            yield batch, whole_numbers(flat.reshape(batch.num_rows, c.dim), c.scale)


def _pieces(value: int) -> list[int]:
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << PIECE_BITS) - 1)))
        value >>= PIECE_BITS
    return out


def _sums(centroids: list[list[int]], c: Clustering):
    """Per task: pieces of the sum of each centroid's vectors by component; component -1 is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors = Bisectors(centroids, c.dim)
        total = np.zeros((len(centroids), c.dim), dtype=object)
        count = np.zeros(len(centroids), dtype=np.int64)
        for _, vectors in _matrices(batches, c):
            winner, _ = bisectors.nearest(vectors)
            for k in np.unique(winner):
                mine = vectors[winner == k]
                total[k] += mine.sum(axis=0).astype(object)
                count[k] += len(mine)
        rows = [(k, -1, 0, int(n)) for k, n in enumerate(count) if n]
        rows += [(k, i, p, x) for k in range(len(centroids)) if count[k] for i in range(c.dim) for p, x in enumerate(_pieces(int(total[k, i])))]
        columns = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "component", "piece", "value"]
        )

    return run


def _assigned(centroids: list[list[int]], c: Clustering):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors = Bisectors(centroids, c.dim)
        for batch, vectors in _matrices(batches, c):
            winner, distance = bisectors.nearest(vectors)
            distance = [x if x < 1 << 63 else None for x in distance.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(winner, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def kept_vectors(vectors: DataFrame, c: Clustering, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, v) with ``dim`` components, none null or non-finite."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where((F.size("v") == c.dim) & ~odd)


def first_centroids(kept: DataFrame, c: Clustering) -> list[list[int]]:
    """Vectors with the smallest hashes of their ids, in ascending order; rows that share an id by their components."""
    mark = F.sha2(F.concat(F.lit(f"{c.seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.where(F.col("vec_id").isNotNull()).select(mark.alias("mark"), "v").orderBy("mark", "v").limit(c.centroids).collect()
    if not rows:
        return []
    return [[int(x) for x in v] for v in whole_numbers(np.array([r["v"] for r in rows], dtype=np.float64), c.scale).tolist()]


def next_centroids(kept: DataFrame, centroids: list[list[int]], c: Clustering) -> list[list[int]]:
    """Floor of the mean of each centroid's vectors by component; a centroid without vectors stays."""
    parts = kept.select("v").mapInArrow(_sums(centroids, c), "cluster int, component int, piece int, value long")
    rows = parts.groupBy("cluster", "component", "piece").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    total = {(k, i): 0 for k in range(len(centroids)) for i in range(-1, c.dim)}
    for r in rows:
        total[r["cluster"], r["component"]] += int(r["value"]) << (PIECE_BITS * r["piece"])
    return [[total[k, i] // total[k, -1] for i in range(c.dim)] if total[k, -1] else old for k, old in enumerate(centroids)]


def cluster(vectors: DataFrame, c: Clustering = Clustering(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    * Vectors that are null, have another number of components, or hold a null or non-finite
      one, are left out.  Zero vectors and repeated rows count like any other.
    * Ties in distance go to the smaller centroid number.  Rows that share an id start
      centroids in the order of their components; rows without id start none, but are assigned.
    * With fewer vectors than centroids there are as many centroids as vectors with an id.
      Without any (an empty table too) the result is empty.
    * Components of any finite size are exact.  A distance or inertia beyond 64 bits is null.
    * Other columns are ignored.
    """
    kept = kept_vectors(vectors, c, id_col, vector_col)
    centroids = first_centroids(kept, c)
    if not centroids:
        kept = kept.where("false")
    for _ in range(c.rounds if centroids else 0):
        centroids = next_centroids(kept, centroids, c)
    rows = stable(kept.mapInArrow(_assigned(centroids, c), "vec_id long, cluster int, distance long"))
    inertia = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    found = rows.groupBy("cluster").agg(inertia.alias("inertia")).collect()  # one row per centroid
    sums = {r["cluster"]: None if r["inertia"] is None else int(r["inertia"]) for r in found}
    every = None if None in sums.values() else sum(sums.values())
    long = lambda x: x if x is not None and x < 1 << 63 else None
    facts = [(k, long(sums[k]), long(every), sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for k in sums]
    facts = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
