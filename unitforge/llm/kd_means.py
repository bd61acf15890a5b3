"""Centroid clustering by kd-tree filtering, in whole numbers throughout.

Each partition builds kd-trees over its vectors, once; a node holds the count and componentwise sum of its vectors and their bounding
box. A round sends the centroids down every tree: at a node, the centroid nearest to the box's middle rules out each other one that is
farther from all of the box; a node with one centroid left is assigned whole, by count and sum, and a leaf with several compares its
vectors with these. Only a count and a sum for each centroid leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: Vectors of a tree and of a leaf.
TREE, LEAF = 4096, 32
#: Components from here on would carry squared distances out of 64 bits.
LIMIT = 1 << 26
#: Below this all products and their sums are whole numbers that a double holds.
EXACT = 1 << 22


def build_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes): the vectors' order by leaves, and a row (start, end, left, right) for each node, parents first; a leaf has left 0.

    A node is split at the middle of the component with the widest range; vectors that are all equal stay one leaf.
    """
    order, nodes, todo = np.arange(len(points)), [[0, len(points), 0, 0]], [0]
    while todo:
        at = todo.pop()
        a, b = nodes[at][:2]
        if b - a <= leaf:
            continue
        own = points[order[a:b]]
        low, high = own.min(axis=0), own.max(axis=0)
        axis = int(np.argmax(high - low))
        if high[axis] == low[axis]:
            continue
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, axis], half)]
        nodes[at][2:] = [len(nodes), len(nodes) + 1]
        todo += nodes[at][2:]
        nodes += [[a, a + half, 0, 0], [a + half, b, 0, 0]]
    return order, np.array(nodes, np.int32)


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller one of equals, and squared distance, exactly."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        x, c = points.astype(np.float64), centroids.astype(np.float64)
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
        best = np.argmin(d, axis=1)
        return best, d[np.arange(len(d)), best].astype(np.int64)
    best, low = np.zeros(len(points), np.int64), np.full(len(points), np.iinfo(np.int64).max)
    for k, c in enumerate(centroids):
        d = ((points - c) ** 2).sum(axis=1)
        best, low = np.where(d < low, k, best), np.minimum(low, d)
    return best, low


class Tree:
    """A kd-tree over vectors that are already in its order."""

    def __init__(self, points: np.ndarray, nodes: np.ndarray):
        self.points, self.nodes = points, nodes
        starts, ends = nodes[:, 0], nodes[:, 1]
        total = np.concatenate((np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)))
        self.sums = total[ends] - total[starts]
        self.low, self.high = np.empty_like(self.sums), np.empty_like(self.sums)
        for i in range(len(nodes) - 1, -1, -1):  # children stand behind their parents
            a, b, left, right = nodes[i]
            if left:
                np.minimum(self.low[left], self.low[right], out=self.low[i])
                np.maximum(self.high[left], self.high[right], out=self.high[i])
            else:
                self.low[i], self.high[i] = points[a:b].min(axis=0), points[a:b].max(axis=0)

    def filter(self, centroids: np.ndarray) -> Iterator[tuple[int, int, int | np.ndarray]]:
        """(start, end, centroid) of nodes that one centroid takes whole, (start, end, candidates) of leaves that several are left for."""
        at, keep = np.array([0]), np.ones((1, len(centroids)), bool)
        while len(at):
            low, high = self.low[at], self.high[at]
            middle = low + high  # twice the middle, to stay whole
            gap = np.where(keep, np.stack([((middle - 2 * c) ** 2).sum(axis=1) for c in centroids], axis=1), np.iinfo(np.int64).max)
            chief = np.argmin(gap, axis=1)
            z = centroids[chief]
            for k, c in enumerate(centroids):
                corner = np.where(c > z, high, low)  # the box's corner that lies farthest towards c
                keep[:, k] &= ((c - z) * (c + z - 2 * corner)).sum(axis=1) <= 0
            one, left = keep.sum(axis=1) == 1, self.nodes[at, 2] > 0
            for i in np.flatnonzero(one):
                yield int(self.nodes[at[i], 0]), int(self.nodes[at[i], 1]), int(chief[i])
            for i in np.flatnonzero(~one & ~left):
                yield int(self.nodes[at[i], 0]), int(self.nodes[at[i], 1]), np.flatnonzero(keep[i])
            down = ~one & left
            at, keep = self.nodes[at[down], 2:].ravel(), np.repeat(keep[down], 2, axis=0)

    def gather(self, centroids: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        """Add the vectors' counts and sums to those of their centroids."""
        starts = {(int(a), int(b)): i for i, (a, b) in enumerate(self.nodes[:, :2])}
        for a, b, who in self.filter(centroids):
            if isinstance(who, int):
                counts[who] += b - a
                sums[who] += self.sums[starts[a, b]]
            else:
                own = who[nearest(self.points[a:b], centroids[who])[0]]
                np.add.at(counts, own, 1)
                np.add.at(sums, own, self.points[a:b])

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and squared distance of every vector."""
        cluster, distance = np.empty(len(self.points), np.int64), np.empty(len(self.points), np.int64)
        for a, b, who in self.filter(centroids):
            who = np.array([who]) if isinstance(who, int) else who
            best, distance[a:b] = nearest(self.points[a:b], centroids[who])
            cluster[a:b] = who[best]
        return cluster, distance


def _trees(dims: int, scale: int, tree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            flat = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in table.column("vector").chunks])
            whole = np.floor(flat.astype(np.float64).reshape(-1, dims) * scale)
            if np.abs(whole).max() >= LIMIT:
                raise ArithmeticError(f"vectors have components of {LIMIT // scale} and more, whose squared distances 64 bits can't hold")
            points = whole.astype(np.int64)
            order, nodes = build_tree(points)
            ids = pa.concat_arrays(table.column("id").chunks).take(pa.array(order))
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            blobs = [pa.array([x], pa.binary()) for x in (points[order].astype("<i4").tobytes(), nodes.astype("<i4").tobytes())]
            return pa.RecordBatch.from_arrays([lists, *blobs], ["ids", "points", "nodes"])

        n = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, tree - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == tree:
                    yield out(held)
                    held, n = [], 0
        if held:
            yield out(held)

    return run


def _read(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, Tree]]:
    for i in range(batch.num_rows):
        points = np.frombuffer(batch.column("points")[i].as_buffer(), "<i4").reshape(-1, dims).astype(np.int64)
        nodes = np.frombuffer(batch.column("nodes")[i].as_buffer(), "<i4").reshape(-1, 4)
        yield batch.column("ids")[i].values, Tree(points, nodes)


def _round(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, tree in _read(batch, centroids.shape[1]):
                tree.gather(centroids, counts, sums)
        full = np.flatnonzero(counts)
        rows = {"cluster": pa.array(full, pa.int32()), "n": pa.array(counts[full]), "sums": pa.array(list(sums[full]), pa.list_(pa.int64()))}
        yield pa.RecordBatch.from_pydict(rows)

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _read(batch, centroids.shape[1]):
                cluster, distance = tree.assign(centroids)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, tree: int = TREE) -> DataFrame:
    """One row per vector that takes part: key, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors with exactly `dims` components, none null or non-finite, take part; each component x counts as floor(scale * x). A component of
    2 ** 26 / scale and more in magnitude raises an error. The k vectors with the smallest SHA-256 of "seed:key" are the first centroids
    (equal keys: by components; null keys come last); fewer vectors give fewer centroids. A round assigns every vector to the nearest
    centroid, the smaller number of equals, and replaces every non-empty centroid by floor(sum / count). Repeated rows all count. Other columns are not
    read. A table without such vectors gives an empty one. The driver holds k centroids and their sums, whatever the table's size.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "means")
    own = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("vector"))
    fit = (F.size("vector") == dims) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    own = own.where(F.coalesce(fit, F.lit(False)))
    kind = own.schema["id"].dataType
    first = own.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("hash"), "vector").orderBy(F.col("hash").asc_nulls_last(), "vector").limit(k).collect()
    first = np.floor(np.array([x.vector for x in first], np.float64).reshape(len(first), dims) * scale)
    if np.abs(first).max(initial=0) >= LIMIT:
        raise ArithmeticError(f"vectors have components of {LIMIT // scale} and more, whose squared distances 64 bits can't hold")
    centroids = first.astype(np.int64)
    result = T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if len(centroids):
        forms = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("points", T.BinaryType()), T.StructField("nodes", T.BinaryType())])
        trees = scratch.keep(own.mapInArrow(_trees(dims, scale, tree), forms), "trees")
        for _ in range(rounds):
            parts = trees.mapInArrow(_round(centroids), "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("i", "s"))
            for row in parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
                centroids[row.cluster, row.i] = int(row.s) // row.n
        rows = scratch.keep(trees.mapInArrow(_assigned(centroids), result), "assigned")
        scratch.drop(trees)
    else:
        rows = spark.createDataFrame([], result)
    inertia = {x.cluster: int(x.d) for x in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    ends = [(k, inertia.get(k, 0), sum(inertia.values()), x) for k, x in enumerate(digests)]
    of = spark.createDataFrame(ends, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
