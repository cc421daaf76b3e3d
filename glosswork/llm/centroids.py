"""Centroid clustering with annulus search, in exact integers.

Lloyd's rounds over a table: each task assigns its vectors and sends one row a centroid with counts and sums, so a round shuffles tasks x centroids
rows whatever the table's size, and only the centroids reach the driver.

A vector x meets few centroids: these are sorted by norm, the one or two next to x's norm give an upper bound u on the distance to the nearest, and by the triangle
inequality only centroids whose norm lies in [|x| - u, |x| + u] can be as near. Two binary searches find that annulus; those in it, its border
included, are compared by exact squared distances, and of equally near ones the smallest number wins.

Distances are sums of products of integers: in double precision where no sum can pass 2**53 (BLAS), else in 64-bit integers. Norms and bounds are only used
to leave centroids out, with a margin beyond the rounding of square roots.

Defined cases: vectors null, of another length, or with null or non-finite components take no part; repeated rows count each; a null vec_id hashes as
an empty string; ties for the first centroids go by the vector; fewer vectors than centroids give fewer centroids; an empty table gives an empty result;
other columns are ignored. Components from 2**27 on (131072 before scaling) raise an error, as the squared distance may not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm._base import cut, trimmed

K, ROUNDS, SIZE, SCALE, SEED = 8, 10, 64, 1024, "3"
#: Components stay below this.
LARGEST = 1 << 27
#: Vectors whose annuli are looked at together: next to each other by norm, so that their annuli are much alike.
BLOCK = 512


def usable(vector: Column, size: int) -> Column:
    return (F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def whole_numbers(vector: Column, scale: int) -> Column:
    """array<int> of floor(scale * component), the component as a double."""

    def one(x: Column) -> Column:
        y = F.floor(x.cast("double") * scale)
        return F.when((y > -LARGEST) & (y < LARGEST), y.cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("int"))

    return F.transform(vector, one)


class Annulus:
    """Nearest centroids of vectors of integers."""

    def __init__(self, centroids: np.ndarray):
        self.squares = (centroids * centroids).sum(axis=1)
        self.number = np.lexsort((np.arange(len(centroids)), self.squares))
        self.centroids, self.squares = centroids[self.number], self.squares[self.number]
        self.norms = np.sqrt(self.squares.astype(np.float64))
        self.largest = int(np.abs(centroids).max(initial=0))
        self.compared = 0

    def _products(self, x: np.ndarray, low: int, high: int) -> np.ndarray:
        """Inner products with the centroids low to high."""
        c = self.centroids[low:high]
        if int(np.abs(x).max(initial=0)) * self.largest * x.shape[1] < 1 << 53:
            return (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
        return x @ c.T

    def _bounds(self, x: np.ndarray, square: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """The squared distance to the nearer of the centroids with the next norm below and above."""
        above = np.minimum(np.searchsorted(self.norms, norm), len(self.norms) - 1)
        tries = [square - 2 * (x * self.centroids[at]).sum(axis=1) + self.squares[at] for at in (above, np.maximum(above - 1, 0))]
        return np.minimum(*tries)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid, and its squared distance."""
        square = (x * x).sum(axis=1)
        norm = np.sqrt(square.astype(np.float64))
        reach = np.sqrt(self._bounds(x, square, norm).astype(np.float64))
        slack = 1e-9 * (norm + reach + self.norms[-1]) + 1e-6
        low = np.searchsorted(self.norms, norm - reach - slack, side="left")
        high = np.searchsorted(self.norms, norm + reach + slack, side="right")
        cluster, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        order = np.lexsort((low, norm))
        for i in range(0, len(order), BLOCK):
            at = order[i : i + BLOCK]
            a, z = int(low[at].min()), int(high[at].max())
            d = square[at, None] - 2 * self._products(x[at], a, z) + self.squares[a:z]
            place = np.arange(a, z)
            outside = (place < low[at, None]) | (place >= high[at, None])
            d[outside] = np.iinfo(np.int64).max
            self.compared += int((~outside).sum())
            best = d.min(axis=1)
            distance[at] = best
            cluster[at] = np.where(d == best[:, None], self.number[a:z], len(self.number)).min(axis=1)
        return cluster, distance


def _vectors(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().astype(np.int64).reshape(-1, size)


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors of the smallest hashes: an ordered limit, so each task sends k rows."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["x"] for r in vectors.select(digest.alias("h"), "x").orderBy("h", "x").limit(k).collect()], np.int64)


def sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Of each centroid that has vectors: their number, the sum of their distances, and their sum. A task sends one row a centroid."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids)
        n, far, total = np.zeros(k, np.int64), np.zeros(k, object), np.zeros((k, size), object)
        for batch in batches:
            x = _vectors(batch, size)
            cluster, distance = search.nearest(x)
            order = np.argsort(cluster, kind="stable")
            met, begin = np.unique(cluster[order], return_index=True)
            n[met] += np.diff(np.append(begin, len(order)))
            total[met] += np.add.reduceat(x[order], begin, axis=0).astype(object)
            high, low = (np.add.reduceat(part[order], begin).astype(object) for part in (distance >> 31, distance & (1 << 31) - 1))
            far[met] += high * (1 << 31) + low
        met = np.flatnonzero(n)
        each = [(int(c), j, int(n[c]) if j == 0 else 0, str(value)) for c in met for j, value in enumerate([far[c], *total[c]])]
        columns = list(zip(*each, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["c", "j", "n", "s"])

    rows = vectors.select("x").mapInArrow(trimmed(run), "c int, j int, n long, s string")
    found: dict[int, list] = {}
    for r in rows.groupBy("c", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("c", "j").collect():
        found.setdefault(r["c"], [r["n"]]).append(int(r["s"]))
    return {c: (n, far, total) for c, (n, far, *total) in found.items()}


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: str = SEED, vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array<long>) of each usable row of rows (vec_id, vector)."""
    kept = rows.where(usable(F.col(vector), size)).select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col(vector), scale).alias("x"))
    vectors = cut(kept)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        for c, (n, _, total) in sums(vectors, centroids).items():
            centroids[c] = [s // n for s in total]
    inertia = {c: far for c, (_, far, _) in sums(vectors, centroids).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, whole = Annulus(centroids), sum(inertia.values())
        own = pa.array(centroids.tolist(), pa.list_(pa.int64()))
        for batch in batches:
            c, d = search.nearest(_vectors(batch, size))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(c, pa.int32()), pa.array(d), pa.array([inertia[i] for i in c.tolist()], pa.int64()), pa.array([whole] * len(c), pa.int64()), own.take(pa.array(c))],
                names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"],
            )

    return vectors.mapInArrow(trimmed(run), schema)


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))
