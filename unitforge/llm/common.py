"""Helpers that the training-data operators share: scratch tables and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_dir, written


class Scratch:
    """Tables written to the shared folder to cut lineage; drop() removes those that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, tag: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{tag}"

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        """Write df and read it back, so that lost executors cost one scan and not the whole history.

        The shuffle files of that job go when it ends: what comes after reads the table.
        """
        path = self.path(tag)
        out = written(df, path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find within one partition: the partition's edges become stars, at most one edge a vertex."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    pairs = [(v, r) for v in parent if (r := find(v)) != v]
    yield pd.DataFrame(pairs, columns=["a", "b"]).astype("int64")


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 40, thin: bool = True) -> DataFrame:
    """Connected components of an undirected graph: (a, b) longs -> (node, component), the component being its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each written to the shared folder, after
    a union-find inside every partition has thinned the edges (thin=False: by DataFrame operations only, without it). Nodes without an edge to another node are absent.
    """
    spark = scratch.spark
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    e = scratch.keep((e.mapInPandas(_contract, "a long, b long") if thin else e).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        new = scratch.keep(small, "star")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(e)
        e = new
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = now
    raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
