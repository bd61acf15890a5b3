"""The driver's tables in the roles of the pipeline's: call graphs of nations, units of documents, replies of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["g"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One graph a nation: its customers call the parts they ordered, a call for every line."""
    return _named(_ordered(spark, sf_dir))


def distinct_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """calls without repeats, told apart by their numbers before these become names: rows stay where the join with customers left them."""
    return _named(_ordered(spark, sf_dir).distinct())


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("c_nationkey", "c_custkey", "l_partkey")


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("c_nationkey").alias("g"), F.concat(F.lit("C"), "c_custkey").alias("caller"), F.concat(F.lit("P"), "l_partkey").alias("callee"))


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), F.concat(F.lit("C"), "c_custkey").alias("sig"), F.col("c_custkey").alias("ord"))


def api_perms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of size one are sensitive; their type is the permission."""
    return table(spark, sf_dir, "part").where("p_size = 1").select(F.concat(F.lit("P"), "p_partkey").alias("api_sig"), F.array("p_type").alias("perms"))


def document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as units: distinct lower-case words as tokens."""
    docs = table(spark, sf_dir, "documents")
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda w: F.length(w) >= 3))
    return docs.select(F.col("doc_id").alias("unit_id"), F.col("source").alias("cluster_id"), words.alias("psi"))


#: The same in SQL.
CALLS_SQL = "SELECT c_nationkey AS g, 'C' || c_custkey AS caller, 'P' || l_partkey AS callee FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
NODES_SQL = f"""calls AS ({CALLS_SQL}),
 inner_ AS (SELECT c_nationkey AS g, 'C' || c_custkey AS sig, 0 AS is_external, c_custkey AS ord FROM customer),
 outer_ AS (SELECT DISTINCT g, callee AS sig, 1 AS is_external, CAST(NULL AS BIGINT) AS ord FROM calls),
 both_ AS (SELECT * FROM inner_ UNION ALL SELECT * FROM outer_),
 nodes AS (SELECT b.g, b.sig, b.is_external, row_number() OVER (PARTITION BY b.g ORDER BY is_external, ord NULLS FIRST, sig) - 1 AS node_id,
   CASE WHEN p_size = 1 AND is_external = 1 THEN 1 ELSE 0 END AS is_sensitive, p_type FROM both_ b LEFT JOIN part ON b.is_external = 1 AND b.sig = 'P' || p_partkey),
 fwd AS (SELECT DISTINCT c.g, a.node_id AS src, b.node_id AS dst FROM calls c JOIN nodes a ON a.g = c.g AND a.sig = c.caller JOIN nodes b ON b.g = c.g AND b.sig = c.callee),
 edges AS (SELECT g, src, dst, TRUE AS is_fwd FROM fwd UNION ALL SELECT g, dst, src, FALSE FROM fwd),
 adj AS (SELECT g, src, dst, 2 AS mult FROM edges)"""
UNITS_SQL = "units AS (SELECT doc_id AS unit_id, source AS cluster_id, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda w: length(w) >= 3)) AS psi FROM documents)"
