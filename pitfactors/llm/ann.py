"""Nearest neighbours with randomly rotated one-bit codes.

A vector's direction is padded, rotated by a seeded random rotation and kept as its signs,
packed to bits, with two correction scalars: the vector's norm and the inner product of its
direction with its code.  From those the inner product with a query is estimated with an
error bound.  Blocks of queries meet blocks of vectors; in each meeting the bound decides
which vectors are scored on their components, and the best of all blocks win.

Codes are longer than vectors (``bits`` per component), which makes the bound narrow enough to
pass over nearly all of a block.  Every vector meets every query as a code: coarse cells would
leave out neighbours wherever vectors fill their space evenly.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitfactors.functions.scale import stable


@dataclass(frozen=True)
class Search:
    neighbours: int = 20
    block: int = 8192  # vectors of one block
    query_block: int = 4096
    width: float = 4.0  # standard errors that the bound spans; a vector outside is missed with probability below 1e-4
    bits: int = 8  # signs kept per component
    seed: int = 11


@lru_cache(maxsize=4)
def rotation(dim: int, size: int, seed: int) -> np.ndarray:
    """``dim`` orthonormal rows of a random rotation in ``size`` dimensions: what it does to padded vectors."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:, :dim].T.copy()


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms; components are divided by the largest first, so that no square over- or underflows."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    shape = vectors / largest
    size = np.sqrt((shape * shape).sum(axis=1, keepdims=True))
    with np.errstate(over="ignore"):
        return shape / size, (largest * size)[:, 0]


def encode(vectors: np.ndarray, s: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated directions, norms, and inner products of direction and code."""
    unit, norm = directions(vectors)
    turned = unit @ rotation(vectors.shape[1], vectors.shape[1] * s.bits, s.seed)
    return np.packbits(turned >= 0, axis=1), norm, np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


class Block:
    """Vectors of one meeting with their codes; estimates are per unit query and per largest norm of the block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bits: np.ndarray, norm: np.ndarray, corr: np.ndarray, s: Search):
        self.ids, self.vectors, self.s, self.dim = ids, vectors, s, vectors.shape[1]
        size = self.dim * s.bits
        self.signs = np.unpackbits(bits, axis=1, count=size).astype(np.float32) * 2 - 1
        self.norm, self.top = norm, norm[np.isfinite(norm)].max(initial=np.finfo(float).tiny)
        part = norm / self.top
        self.odd = ~((part >= 1e-30) & (part <= 1))  # beyond single precision: always scored
        part = np.where(self.odd, 1.0, part)
        self.factor = (part / corr / np.sqrt(size)).astype(np.float32)
        self.bound = (s.width * part * np.sqrt(np.maximum(0.0, 1 - corr**2)) / corr / np.sqrt(max(size - 1, 1)) + 1e-5 * part).astype(np.float32)

    def estimate(self, unit: np.ndarray) -> np.ndarray:
        turned = (unit @ rotation(self.dim, self.dim * self.s.bits, self.s.seed)).astype(np.float32)
        return (turned @ self.signs.T) * self.factor

    def best(self, q_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, vector ids, scores): the nearest vectors of each query in this block, ids of its own left out."""
        k, (unit, size) = self.s.neighbours, directions(queries)
        guess = self.estimate(unit)
        own = q_ids[:, None] == self.ids[None, :]
        chosen = ~own
        if len(self.ids) > k:
            ranked = np.where(own, -np.inf, np.where(self.odd, np.inf, guess))
            first = np.argpartition(-ranked, k - 1, axis=1)[:, :k]
            known = np.einsum("qkd,qd->qk", self.vectors[first], queries)
            known[np.take_along_axis(own, first, axis=1)] = -np.inf  # fewer than k others
            least = known.min(axis=1)
            with np.errstate(all="ignore"):
                least = np.where((np.abs(least) > 1e-280) & np.isfinite(least), least / size / self.top, -np.inf)
                least = np.where(np.isfinite(least), least - 1e-6 * np.abs(least), -np.inf)
                chosen &= self.odd | ~(guess + self.bound < least[:, None].astype(np.float32)) | (size[:, None] > 1e300 / self.norm)  # what may overflow is scored
        found = [self._finalists(q, norm, np.flatnonzero(c)) for q, norm, c in zip(queries, size, chosen)]
        at, to = np.repeat(np.arange(len(queries)), [len(f) for f in found]), np.concatenate(found)
        score = _inner(queries[at], self.vectors[to])
        lost = np.isnan(score)
        order = np.lexsort((self.ids[to], np.where(lost, -np.inf, -score), ~lost, at))
        at, to, score = at[order], to[order], score[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        held = place < k
        return q_ids[at[held]], self.ids[to[held]], score[held]


    def _finalists(self, query: np.ndarray, size: float, to: np.ndarray) -> np.ndarray:
        """Those of the chosen that can be among the nearest; products here may differ from ``_inner`` in the last digits."""
        with np.errstate(all="ignore"):
            rough = self.vectors[to] @ query
            slack = 1e-12 * size * self.norm[to] + 1e-300
            low, high = rough - slack, rough + slack
        if len(to) <= self.s.neighbours:
            return to
        lost = ~np.isfinite(rough) | ~np.isfinite(slack)
        low[lost], high[lost] = -np.inf, np.inf
        return to[~(high < np.partition(low, -self.s.neighbours)[-self.s.neighbours])]


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, added component by component: the same bits for the same vectors in any block."""
    total = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for x, y in zip(a.T, b.T):
            total += y * x
    return total


def _usable(v: str) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(v).isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _codes(dim: int, s: Search):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("v")
            bits, norm, corr = encode(_matrix(column, dim), s)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), column, pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(norm), pa.array(corr)], names=["vec_id", "v", "code", "norm", "corr"])

    return run


def _meet(dim: int, s: Search):
    def run(table: pa.Table) -> pa.Table:
        asks = np.asarray(table.column("ask"))
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if asks.any() and not asks.all():
            asking, held = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
            bits = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(held.num_rows, -1)
            vectors = _matrix(held.column("v").combine_chunks(), dim)
            block = Block(np.asarray(held.column("vec_id")), vectors, bits, np.asarray(held.column("norm")), np.asarray(held.column("corr")), s)
            ids, queries = np.asarray(asking.column("vec_id")), _matrix(asking.column("v").combine_chunks(), dim)
            out += [block.best(ids[i : i + 256], queries[i : i + 256]) for i in range(0, len(ids), 256)]
        q, c, score = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(c, pa.int64()), "score": pa.array(score, pa.float64())})

    return run


def search(vectors: DataFrame, asks: Column, s: Search = Search(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Nearest vectors of each query by inner product: query_id, rank (from 1), vec_id, score.

    ``asks`` tells the query rows; every row is a candidate except those with the query's id.
    Scores are exact inner products of the original vectors in double precision; ties go to
    the smaller id.  A query with fewer candidates gets all of them.

    * Vectors that are null or zero, or hold null or non-finite components, take no part, nor
      do rows without id or of another dimension than most rows have.  Components of any
      other size do; a score that overflows is infinite, one of opposite infinities is NaN
      and ranks first, as in Spark's order.
    * Repeated rows are candidates of their own; a repeated query is answered once.
    * Other columns are ignored; an empty table gives no rows.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # moved as stored, computed in doubles
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"), F.coalesce(asks, F.lit(False)).alias("ask"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable("v"))
    dims = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ask").cast("long")).alias("asks")).orderBy(F.desc("n"), "dim").first()
    dim, n, n_asks = (dims["dim"], dims["n"], dims["asks"]) if dims else (1, 0, 0)
    rows = rows.where(F.size("v") == dim)
    coded = stable(rows.select("vec_id", "v").mapInArrow(_codes(dim, s), f"vec_id long, v {kind}, code binary, norm double, corr double"))
    blocks, query_blocks = max(1, -(-n // s.block)), max(1, -(-n_asks // s.query_block))

    def each(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    place, row = F.xxhash64("vec_id"), F.xxhash64(F.monotonically_increasing_id())  # rows that repeat an id fall to all blocks
    base = coded.select("*", F.lit(False).alias("ask"), F.pmod(row, F.lit(blocks)).cast("int").alias("block")).withColumn("query_block", each(query_blocks))
    queries = rows.where("ask").select("vec_id", "v").dropDuplicates(["vec_id"])
    queries = queries.select("vec_id", "v", F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("norm"), F.lit(0.0).alias("corr"), F.lit(True).alias("ask"), F.pmod(place, F.lit(query_blocks)).cast("int").alias("query_block"))
    queries = queries.withColumn("block", each(blocks))
    met = base.unionByName(queries).groupBy("block", "query_block").applyInArrow(_meet(dim, s), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= s.neighbours).select("query_id", "rank", "vec_id", "score")
