"""Sinks: tables by year, JSON lines, unit reports, append-only logs. Spark's commit protocol makes each write atomic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A parquet table, partitioned by year where there is one. Static overwrite clears stale outputs."""
    writer = df.write.mode(mode)
    (writer.partitionBy("year") if "year" in df.columns else writer).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; null fields are left out."""
    df.write.mode(mode).json(path)


def append_results(df: DataFrame, path: str, columns: list[str]) -> None:
    """Result rows as CSV with a header, appended: another run adds rows."""
    df.select(*columns).write.mode("append").option("header", True).csv(path)


def result_columns() -> list[str]:
    return ["apk_id", "verdict", "confidence", "family", "note"]


def unit_markdown(unit_id: Column, phi: Column, internal: Column, external: Column, edges: Column) -> Column:
    """A unit's report. internal and external: arrays of struct(sig, score), best first; edges: arrays of struct(src_sig, dst_sig)."""
    nodes = lambda xs, n: F.array_join(F.transform(F.slice(xs, 1, n), lambda x: F.concat(F.lit("- `"), x["sig"], F.lit("` score="), F.format_string("%.4f", x["score"]))), "\n")
    links = F.array_join(F.transform(F.slice(edges, 1, 300), lambda e: F.concat(F.lit("- `"), e["src_sig"], F.lit("` -> `"), e["dst_sig"], F.lit("`"))), "\n")
    return F.concat(F.lit("# Unit "), unit_id, F.lit("\n\nphi="), F.format_string("%.6f", phi), F.lit("\n\n## Internal\n"), nodes(internal, 60), F.lit("\n\n## External\n"), nodes(external, 40), F.lit("\n\n## Edges\n"), links, F.lit("\n"))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_new(df: DataFrame, path: str) -> bool:
    """K6: write a table unless it is there already; was it written?"""
    if exists(df.sparkSession, f"{path}/_SUCCESS"):
        return False
    write_table(df, path)
    return True


def run_tallies(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How many items a run had, how many failed (a row with an error) and how many were skipped."""
    one = rows.groupBy(*keys).agg(F.max(F.col("error").isNotNull().cast("int")).alias("failed"), F.max(F.col("skipped").cast("int")).alias("skipped"))
    return one.agg(F.count("*").alias("total"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"))


def under_out(path: str, out: str = "out") -> str:
    """a relative path below the output folder, which is not put in front twice; absolute paths stay."""
    if path.startswith("/"):
        return path
    rest = path.replace("\\", "/").lstrip("./")
    return rest if rest == out or rest.startswith(f"{out}/") else f"{out}/{path}"


#: Tables of a prototype store.
STORE = ("clusters", "inverted_index", "build_summary")


def write_prototypes(store: dict[str, DataFrame], path: str) -> None:
    """K9: the tables of a prototype store, each a folder below path."""
    for name in STORE:
        write_table(store[name], f"{path}/{name}")


def read_prototypes(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a prototype store; a missing index is an error, as its folder is not found."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in STORE}
