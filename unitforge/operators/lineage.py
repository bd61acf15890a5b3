"""Cutting the lineage of tables that iterations build on: columnar tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one on a local master, and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='unitforge-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """df written to a path and read back. The shuffle files of that job go when it ends: what comes after reads the table."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(name, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: a lost executor costs a scan, and what follows reads only the columns that it needs."""
    return written(df, f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}")


class Kept:
    """Tables in the shared folder that go when the block ends, but for the one that last() gives."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Kept:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.root)

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return written(df, f"{self.root}/{self.n:03d}")

    def last(self, df: DataFrame) -> DataFrame:
        """The result, kept outside of what the block removes."""
        return written(df, f"{self.root}-result")
