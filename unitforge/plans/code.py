"""A code base out of suppliers: each one is a class with three methods that hold one literal and call one method each.

The Spark side builds the text of the class and lets the readers parse it; the SQL side states what must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers
from . import bindings as B

NAMES = ("onCreate", "onReceive", "send")
#: Literals by supplier number modulo their count; {n} is the number.
LITERALS = (
    "http://h{n}.example.com/p", "10.1.2.7", "android.intent.ACTION_A{n}", "content://sms/{n}", "/sdcard/d{n}", "me{n}@mail.org", "Cookie",
    "QUJDREVGR0hJSktMTU5PUFFS+/==", "0123456789abcdef0123",
)
#: Callees by supplier number and method modulo their count.
CALLEES = (
    "Ljava/net/URL;->openConnection()V", "Ljavax/crypto/Cipher;->doFinal()V", "Landroid/telephony/SmsManager;->sendTextMessage()V",
    "Lcom/x/S{n};->send()V", "Ljava/lang/reflect/Method;->invoke()V",
)
PERMS = {CALLEES[0]: ["INTERNET"], CALLEES[2]: ["READ_SMS", "SEND_SMS"]}


def _case(number: str, texts: tuple[str, ...], n: str) -> str:
    """SQL that both engines read: the text for a number, {n} filled in."""
    whens = " ".join(f"WHEN {i} THEN concat('" + t.replace("{n}", f"', {n}, '") + "')" for i, t in enumerate(texts))
    return f"CASE {number} {whens} END"


LITERAL = _case(f"s_suppkey % {len(LITERALS)}", LITERALS, "CAST(s_suppkey AS VARCHAR(20))")
CALLEE = [_case(f"(s_suppkey + {k}) % {len(CALLEES)}", CALLEES, "CAST(s_suppkey AS VARCHAR(20))") for k in range(3)]
#: (n, g, k, name, class_name, sig, lit, callee): the methods, a row each.
METHODS_SQL = "code AS (" + " UNION ALL ".join(
    f"SELECT s_suppkey AS n, s_nationkey AS g, {k} AS k, '{name}' AS name, 'com/x/S' || s_suppkey AS class_name, 'Lcom/x/S' || s_suppkey || ';->{name}()V' AS sig, {LITERAL} AS lit, {CALLEE[k]} AS callee FROM supplier"
    for k, name in enumerate(NAMES)
) + ")"
PERMS_SQL = "api AS (SELECT unnest(" + str(list(PERMS)) + ") AS api_sig, unnest([" + ", ".join(f"'{','.join(p)}'" for p in PERMS.values()) + "]) AS perms)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, file, body): the text of each class."""
    parts = [F.concat(F.lit(".class public Lcom/x/S"), "n", F.lit(";\n.super Ljava/lang/Object;\n"))]
    for k, name in enumerate(NAMES):
        parts += [F.lit(f"\n.method public {name}()V\n    .locals 1\n\n    const-string v0, \""), F.col("lit"), F.lit("\"\n    invoke-static {v0}, "), F.col(f"c{k}"), F.lit("\n    return-void\n.end method\n")]
    rows = B.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").cast("string").alias("n"), F.expr(LITERAL).alias("lit"), *[F.expr(c).alias(f"c{k}") for k, c in enumerate(CALLEE)])
    return rows.select("g", F.concat(F.lit("S"), "n", F.lit(".smali")).alias("file"), F.concat(*parts).alias("body"))


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.parse_smali(files(spark, sf_dir), ["g"])


def api_perms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PERMS.items()), "api_sig string, perms array<string>")


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, ...): one manifest a nation: every third supplier's class is an activity, a receiver, or both."""
    s = B.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), "s_suppkey", F.concat(F.lit("com.x.S"), "s_suppkey").alias("c"))
    picked = lambda *r: F.collect_list(F.when((F.col("s_suppkey") % 3).isin(*r), F.col("c")))
    none = F.lit(None).cast("array<string>")
    return readers.manifests(s.groupBy("g").agg(F.lit("com.x").alias("package"), F.collect_list(F.lit("INTERNET")).alias("permissions"), picked(0, 2).alias("activities"), none.alias("services"), picked(1, 2).alias("receivers"), none.alias("providers")))
