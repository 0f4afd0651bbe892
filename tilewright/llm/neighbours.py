"""Nearest neighbours with randomly rotated one-bit codes.

A vector, less the centre of a bounded sample, is rotated at random, and the signs of its D
components are its code: a corner of the unit cube. With the corner's inner product with the
vector itself (a correction scalar) the code gives an unbiased estimate of the inner product with
any query, and a bound on its error. Per block of rows, rows whose lower bound on the distance
isn't above the distance of the k-th best found so far are measured exactly; the others are never
touched in full. Queries go against all rows in blocks of bounded size, so the candidates are
every row, and recall only depends on the error bound's width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Width of the error bound, in standard deviations of the estimate.
WIDTH = 4.0
#: Queries held by a task at once, and those compared with a block of rows at a time.
QUERIES, STRIPE = 8192, 256
#: Rows that the centre is fitted on, at most.
SAMPLE = 10_000


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def codes(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, norms, inner products of corner and unit vector) of rows x."""
    y = x - centre
    norm = np.sqrt((y * y).sum(1))
    y = y @ turn
    own = np.abs(y).sum(1) / np.sqrt(x.shape[1]) / np.where(norm > 0, norm, 1)
    return np.packbits(y > 0, axis=1), norm, own


def _index(centre: np.ndarray, turn: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), len(centre))
            bits, norm, own = codes(x, centre, turn)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in bits], pa.binary()), pa.array(norm), pa.array(own)], ["vec_id", "v", "code", "norm", "own"])

    return run


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def best(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest, nearest first, ties to the smaller id."""
    return np.lexsort((ids, dist))[:k]


class Search:
    """The k nearest so far of a set of queries; add() takes a block of coded rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors, k
        d = vectors - centre
        self.norm = np.sqrt((d * d).sum(1))
        self.turned = ((d @ turn) / np.where(self.norm > 0, self.norm, 1)[:, None]).astype(np.float32)
        self.dist, self.found = [np.zeros(0)] * len(ids), [np.zeros(0, np.int64)] * len(ids)
        self.far = np.full(len(ids), np.inf)

    def add(self, ids: np.ndarray, x: np.ndarray, bits: np.ndarray, norm: np.ndarray, own: np.ndarray) -> None:
        dim = x.shape[1]
        corner = (np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
        safe = np.where(own > 0, own, 1)
        slack = np.where(own > 0, WIDTH * np.sqrt(np.maximum(1 - safe * safe, 0)) / safe / np.sqrt(max(dim - 1, 1)), 2.0)
        for s in range(0, len(self.ids), STRIPE):
            e = min(s + STRIPE, len(self.ids))
            cos = (corner @ self.turned[s:e].T) / safe[:, None]
            near = norm[:, None] ** 2 + self.norm[None, s:e] ** 2 - 2 * norm[:, None] * self.norm[None, s:e] * np.minimum(cos + slack[:, None], 1)
            for i in range(s, e):
                low = near[:, i - s]
                other = ids != self.ids[i]
                if not np.isfinite(self.far[i]):  # a first threshold from the best estimates
                    first = np.flatnonzero(other)[np.argsort(low[other], kind="stable")[: self.k]]
                    self._measure(i, first, ids, x)
                    other[first] = False
                self._measure(i, np.flatnonzero(other & (low <= self.far[i] ** 2 * (1 + 1e-9) + 1e-9)), ids, x)

    def _measure(self, i: int, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        if len(rows):
            d = np.sqrt(((x[rows] - self.q[i]) ** 2).sum(1))
            dist, found = np.concatenate([self.dist[i], d]), np.concatenate([self.found[i], ids[rows]])
            top = best(dist, found, self.k)
            self.dist[i], self.found[i] = dist[top], found[top]
            if len(top) == self.k:
                self.far[i] = self.dist[i][-1]


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query and rank: query_id, rank (from 1), vec_id, score (Euclidean distance, in doubles).

    Queries are the rows whose id is divisible by ``every``, candidates all rows but those with
    the query's id. Rows take no part whose id or vector is null, whose vector is zero or holds null
    or non-finite components, or isn't of the commonest length (of these, the shortest). Rows that
    share an id are candidates each. Ties go to the smaller id; with fewer candidates than k, all
    are returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = usable.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    usable = usable.filter(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0))
    sizes = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, rows = sizes["d"], sizes["count"]
    usable = usable.filter(F.size("v") == dim)
    sample = usable.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < int(min(1.0, SAMPLE / rows) * 1_000_003)).select("v").collect()
    centre = np.array([r["v"] for r in sample]).mean(0) if sample else np.zeros(dim)
    turn = rotation(dim)
    index = materialise(usable.mapInArrow(_index(centre, turn), "vec_id long, v array<double>, code binary, norm double, own double"))

    asked = index.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v")
    blocks = -(-asked.count() // QUERIES)
    out = None
    for block in range(blocks):
        own = sorted((r["vec_id"], r["v"]) for r in asked.filter(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)) == block).distinct().collect())
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in own], np.int64), np.array([r[1] for r in own], np.float64).reshape(-1, dim)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = Search(*shared.value, centre, turn, k)
            for b in batches:
                for i in range(0, b.num_rows, 4096):
                    c = b.slice(i, 4096)
                    bits = np.frombuffer(b"".join(c.column(2).to_pylist()), np.uint8).reshape(c.num_rows, -1)
                    search.add(c.column(0).to_numpy(zero_copy_only=False), _matrix(c.column(1), dim), bits, c.column(3).to_numpy(zero_copy_only=False), c.column(4).to_numpy(zero_copy_only=False))
            n = [len(f) for f in search.found]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(n)), n)), pa.array(np.repeat(search.ids, n)), pa.array(np.concatenate(search.found)), pa.array(np.concatenate(search.dist))], ["q", "query_id", "vec_id", "score"])

        found = index.mapInArrow(run, "q long, query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id", "q").orderBy("score", "vec_id")
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out
