"""Approximate nearest neighbours by learned partitions.

From a bounded sample of different vectors a nearest-neighbour graph is made and cut into balanced parts, so that neighbours mostly share
one. A small classifier (one hidden layer) learns the parts from the vectors. Every row goes to its most probable part, a query to its
several most probable parts, and all rows there are reranked by the true inner product. How many parts a query tries is measured on the
sample: enough for a recall of `aim` there. Small parts share a task, which sends on only the best of all of them.

A part that turns out to hold more than `DEEP` entries gets parts of its own: a task for each such part makes a graph, parts and a classifier from the part's own sample in the same
way. So with up to `MOST_PARTS` parts of up to `MOST_PARTS` parts each, work a query grows far slower than the table; both levels then aim at the root of `aim`.

Equal vectors are one entry with its `k + 1` smallest ids, which are all that can be among a query's k nearest, so a vector that a third of
all rows hold is neither sent nor searched more than once. A part with more than `BLOCK` entries is dealt out to several tasks.

Only the fitting is bounded by a sample (`SAMPLE` vectors); all rows are indexed and all queries searched. Defined cases: vectors
that are null, zero, of another length than most, or hold a null or non-finite component take no part; ties go to the smaller vec_id;
rows that share a vec_id are one entry each and never each other's neighbours; fewer candidates than k give fewer rows; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswork.llm._base import cut

K = 20
#: Different vectors that the graph and the classifier are made from.
SAMPLE = 6000
#: Rows for each part, parts at least and at most on each level: a sample can tell no more apart.
PART, LEAST_PARTS, MOST_PARTS = 2000, 8, 256
#: Entries of a part beyond which it has parts of its own.
DEEP = 4 * PART
NEIGHBOURS = 10
#: Recall on the sample that sets how many parts a query tries.
AIM = 0.95
#: Entries that one task holds.
BLOCK = 10_000


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of each row by inner product, itself left out."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for i in range(0, len(x), 1000):
        near = x[i : i + 1000] @ x.T
        near[np.arange(len(near)), np.arange(i, i + len(near))] = -np.inf
        out[i : i + 1000] = np.argpartition(-near, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] < len(x) - 1 else np.argsort(-near, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each node of the graph, of nearly equal sizes: halves along main axes to begin with, then moves that cut fewer edges."""
    part = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        at, first, n = todo.pop()
        if n == 1:
            part[at] = first
            continue
        y = x[at] - x[at].mean(0)
        axis = y[np.argmax((y * y).sum(1))] if len(y) else np.zeros(x.shape[1])
        for _ in range(8):
            axis = y.T @ (y @ axis)
            axis /= max(np.linalg.norm(axis), 1e-12)
        order = at[np.argsort(y @ axis, kind="stable")]
        half = n // 2
        k = len(at) * half // n
        todo += [(order[:k], first, half), (order[k:], first + half, n - half)]
    source, target = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
    a, b = np.concatenate([source, target]), np.concatenate([target, source])
    most = ceil(1.05 * len(x) / parts)
    least = len(x) // parts * 8 // 10
    for _ in range(rounds):
        links = np.zeros((len(x), parts), np.int32)
        np.add.at(links, (a, part[b]), 1)
        best = links.argmax(1)
        gain = links[np.arange(len(x)), best] - links[np.arange(len(x)), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < most and size[part[i]] > least:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A classifier with one hidden layer; scores of parts, higher is more probable."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    tries: int
    #: The share of neighbours found on the sample by 1, 2, ... tries.
    recall: tuple[float, ...] = (1.0,)

    def tries_for(self, aim: float) -> int:
        return next((t + 1 for t, r in enumerate(self.recall) if r >= aim), len(self.recall))

    def scores(self, x: np.ndarray) -> np.ndarray:
        size = np.sqrt((x * x).sum(1, keepdims=True))
        x = (x / np.where(size > 0, size, 1)).astype(np.float32)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train(x: np.ndarray, share: np.ndarray, hidden: int = 128, epochs: int = 40, seed: int = 7) -> Router:
    """Fit the parts' shares among each vector's neighbours by cross-entropy, with Adam."""
    rng = np.random.default_rng(seed)
    size = np.sqrt((x * x).sum(1, keepdims=True))
    x = (x / np.where(size > 0, size, 1)).astype(np.float32)
    d, parts = x.shape[1], share.shape[1]
    p = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
    p = [v.astype(np.float32) for v in p]
    m, s, step = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            at = order[i : i + 256]
            h = np.maximum(x[at] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(1, keepdims=True))
            g = (z / z.sum(1, keepdims=True) - share[at]) / len(at)
            back = (g @ p[2].T) * (h > 0)
            grads = [x[at].T @ back, back.sum(0), h.T @ g, g.sum(0)]
            step += 1
            for j, v in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * v
                s[j] = 0.999 * s[j] + 0.001 * v * v
                p[j] = p[j] - 0.004 * (m[j] / (1 - 0.9**step)) / (np.sqrt(s[j] / (1 - 0.999**step)) + 1e-8)
    return Router(*p, tries=1)


def fit(x: np.ndarray, rows: int, k: int = K, aim: float = AIM) -> Router:
    """A router from sample vectors x for so many rows in all."""
    parts = int(min(MOST_PARTS, max(LEAST_PARTS, 2 ** round(np.log2(max(rows, 1) / PART))), max(1, len(x) // 20)))
    if len(x) < 2 or parts < 2:
        d = x.shape[1]
        return Router(np.zeros((d, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32), 1)
    near = graph(x, max(NEIGHBOURS, k))
    part = balanced_parts(x, near[:, :NEIGHBOURS], parts)
    share = np.zeros((len(x), parts), np.float32)
    np.add.at(share, (np.repeat(np.arange(len(x)), NEIGHBOURS), part[near[:, :NEIGHBOURS].ravel()]), 0.5 / NEIGHBOURS)
    share[np.arange(len(x)), part] += 0.5
    router = train(x, share)
    ranked = np.argsort(-router.scores(x), axis=1)
    home = ranked[:, 0]
    place = np.empty_like(ranked)
    place[np.arange(len(x))[:, None], ranked] = np.arange(parts)
    tried = place[np.arange(len(x))[:, None], home[near]]  # how far down a query's list the part of each neighbour is
    router.recall = tuple((tried <= t).mean() for t in range(parts))
    router.tries = router.tries_for(aim)
    return router


@dataclass
class Tree:
    """A router, and the routers of its parts that have parts. Leaves are numbered part * MOST_PARTS + part of it."""

    top: Router
    below: dict[int, Router]
    tries: int

    def home(self, x: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The leaves of rows that are in parts."""
        leaf = part.astype(np.int64) * MOST_PARTS
        for p in np.unique(part).tolist():
            if p in self.below:
                at = np.flatnonzero(part == p)
                leaf[at] += self.below[p].scores(x[at]).argmax(axis=1)
        return leaf

    def ways(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the leaves that each tries."""
        best = np.argsort(-self.top.scores(x), axis=1, kind="stable")[:, : self.tries]
        row, part = np.repeat(np.arange(len(x)), best.shape[1]), best.ravel()
        rows, leaves = [], []
        for p in np.unique(part).tolist():
            at = row[part == p]
            if p in self.below:
                own = self.below[p]
                sub = np.argsort(-own.scores(x[at]), axis=1, kind="stable")[:, : own.tries]
                rows.append(np.repeat(at, sub.shape[1]))
                leaves.append(p * MOST_PARTS + sub.ravel())
            else:
                rows.append(at)
                leaves.append(np.full(len(at), p * MOST_PARTS))
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (row, part)


def below(index: DataFrame, sizes: dict[int, int], k: int, aim: float, sample: int) -> dict[int, Router]:
    """Routers of the parts with more than DEEP entries, each made in a task of its own from `sample` different vectors of the part; MOST_PARTS of them reach the driver at most."""
    deep = {p: n for p, n in sizes.items() if n > DEEP}
    if not deep:
        return {}

    def make(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        x = _matrix(rows.sort_by([("h1", "ascending"), ("h2", "ascending")]).column("embedding").combine_chunks())
        return pa.table({"part": pa.array([part], pa.int32()), "router": pa.array([pickle.dumps(fit(x, deep[part], k, aim))], pa.binary())})

    one = Window.partitionBy("part", "h1", "h2").orderBy("vec_id")
    first = Window.partitionBy("part").orderBy("h1", "h2")
    some = index.where(F.col("part").isin(list(deep))).select("part", "vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit("again"), F.reverse("embedding")).alias("h2"))
    some = some.withColumn("_n", F.row_number().over(one)).where("_n = 1").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= sample)
    return {r["part"]: pickle.loads(r["router"]) for r in some.select("part", "h1", "h2", "embedding").groupBy("part").applyInArrow(make, "part int, router binary").collect()}


def blocks_of(sizes: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """First block and number of blocks of each part: small neighbouring parts share one, a large part has several."""
    first, many, block, room = {}, {}, -1, 0
    for part in sorted(sizes):
        n = sizes[part]
        if n > room:
            block += 1
            room = BLOCK
        first[part] = max(block, 0)
        many[part] = max(1, ceil(n / BLOCK))
        block += many[part] - 1
        room = 0 if many[part] > 1 else room - n
    return first, many


def _matrix(column) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """h1, h2 (hashes that tell different vectors apart), vec_id, embedding: of each vector the k + 1 rows of the smallest ids."""
    one = Window.partitionBy("h1", "h2").orderBy("vec_id")
    return vectors.withColumn("_n", F.row_number().over(one)).where(F.col("_n") <= k + 1).drop("_n")


def valid(vectors: DataFrame, size: int | None = None) -> tuple[DataFrame, int]:
    """The rows that take part, with h1 and h2, and the length of their vectors: that of most if not given."""
    e = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull())
    whole = ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(whole & F.exists(e, lambda v: v != 0))
    if size is None:
        usual = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
        size = usual[0]["n"] if usual else 0
    rows = rows.where(F.size("embedding") == size)
    return rows.select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit("again"), F.reverse("embedding")).alias("h2")), size


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, sample: int = SAMPLE, aim: float = AIM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of vectors (vec_id, embedding) to each row of queries (vec_id, embedding)."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows, size = valid(vectors)
    rows = cut(entries(rows, k))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], schema)
    distinct = rows.groupBy("h1", "h2").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    x = np.array([r["embedding"] for r in distinct.orderBy("h1", "h2").limit(sample).collect()], np.float64)
    router = fit(x, n, k, aim)

    def to_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = router.scores(_matrix(batch.column("embedding"))).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(part.astype(np.int32))], names=["vec_id", "embedding", "part"])

    index = cut(rows.select("vec_id", "embedding").mapInArrow(to_parts, "vec_id long, embedding array<double>, part int"))
    sizes = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}  # a row a part: MOST_PARTS at most
    subs = below(index, sizes, k, aim**0.5, sample)
    tree = spark.sparkContext.broadcast(Tree(router, subs, router.tries_for(aim**0.5) if subs else router.tries))

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.value.home(_matrix(batch.column("embedding")), batch.column("part").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(leaf.astype(np.int32))], names=["vec_id", "embedding", "part"])

    def to_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, leaf = tree.value.ways(_matrix(batch.column("embedding")))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("h1", "h2", "embedding")), pa.array(leaf.astype(np.int32))], names=["h1", "h2", "embedding", "part"])

    if subs:
        index = cut(index.mapInArrow(to_leaves, "vec_id long, embedding array<double>, part int"))
        sizes = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}  # a row a leaf: MOST_PARTS * MOST_PARTS at most
    else:
        index = index.withColumn("part", F.col("part") * MOST_PARTS)
        sizes = {p * MOST_PARTS: n for p, n in sizes.items()}
    first, many = blocks_of(sizes)
    blocks = F.broadcast(spark.createDataFrame([(p, first[p], many[p]) for p in sizes], "part int, first int, many int"))
    index = index.join(blocks, "part").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("many"))).cast("int")).select("vec_id", "embedding", "part", "block")

    asked = cut(valid(queries, size)[0].select("vec_id", "h1", "h2", "embedding"))
    different = asked.groupBy("h1", "h2").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    routed = different.mapInArrow(to_ways, "h1 long, h2 long, embedding array<double>, part int").join(blocks, "part")
    routed = routed.withColumn("block", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("many") - 1))).select("h1", "h2", "embedding", "part", "block")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        for part in np.unique(right.column("part").to_numpy()).tolist():
            l, r = (t.filter(pa.compute.equal(t.column("part"), part)).combine_chunks() for t in (left, right))
            if not l.num_rows or not r.num_rows:
                continue
            q, c = (_matrix(t.column("embedding").combine_chunks()) for t in (l, r))
            ids, h1, h2 = r.column("vec_id").to_numpy(), l.column("h1").to_numpy(), l.column("h2").to_numpy()
            for i in range(0, len(q), 512):
                near = q[i : i + 512] @ c.T
                edge = -np.partition(-near, min(k + 1, len(c)) - 1, axis=1)[:, min(k + 1, len(c)) - 1, None]
                a, b = np.nonzero(near >= edge - 1e-9 * np.maximum(1, np.abs(edge)))
                # such sums are the same for equal vectors, wherever they stand
                out.append((h1[i + a], h2[i + a], ids[b], (q[i + a] * c[b]).sum(1)))
        x = [np.concatenate(y) for y in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        order = np.lexsort((x[2], -x[3], x[1], x[0]))
        x = [y[order] for y in x]
        first = np.flatnonzero(np.append(True, (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1]))) if len(order) else np.zeros(0, np.int64)
        keep = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < k + 1
        return pa.table([pa.array(y[keep]) for y in x], names=["h1", "h2", "vec_id", "score"])

    found = routed.groupBy("block").cogroup(index.groupBy("block")).applyInArrow(search, "h1 long, h2 long, vec_id long, score double")
    best = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n")
    lists = found.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("found"))
    others = F.filter("found", lambda s: s["vec_id"] != F.col("query_id"))
    answers = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").join(lists, ["h1", "h2"]).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("pos", "s"))
    return answers.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("s.vec_id").alias("vec_id"), (-F.col("s.far")).alias("score"))


def op6_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
