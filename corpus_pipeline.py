"""A training corpus out of raw documents: five stages, each written and read again before the next one.

Language identification, MinHash near-dedup, suffix-array dedup, mixing to target weights, BPE encoding. Every stage works on
all rows that the one before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitforge.llm import bpe, langid, lsh_forest, mixing, suffix_dedup
from unitforge.llm.common import Scratch
from unitforge.llm.queries import DOMAIN_TARGETS, label_domains, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and such without any letter.

    Repeated rows and rows without a doc_id are judged by their texts like all others; an empty table gives an empty one.
    """
    model = langid.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    rows = langid.predict(docs.select(*COLUMNS), model)
    return rows.where((F.col("lang_pred") != langid.UNKNOWN) if model else F.col("text").rlike(r"\p{L}")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest doc_id; of rows with equal doc_id and text one.

    Texts that share a doc_id are told apart by their digests and numbered in its order. Rows without a doc_id are all kept, as are
    null texts and such without words, once for each doc_id. An empty table gives an empty one.
    """
    docs, scratch = docs.select(*COLUMNS), Scratch(spark, "near")
    rows = docs.where("doc_id is not null").withColumn("digest", F.coalesce(F.sha2("text", 256), F.lit("")))
    texts = scratch.keep(rows.select("doc_id", "digest").distinct(), "texts")
    if texts.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = rows.withColumn("node", F.col("doc_id").cast("long"))
    else:
        order = texts.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest")
        nodes = scratch.keep(order.withColumn("node", F.monotonically_increasing_id()), "nodes")
        rows = scratch.keep(rows.join(nodes, ["doc_id", "digest"]), "numbered")
    kept = lsh_forest.near_duplicates(rows.select("node", "text"), key="node").where("kept").select("node").distinct()
    one = rows.join(kept, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "lang", "source", "n_chars", "text")).alias("x"))
    return one.select("x.*").select(*COLUMNS).union(docs.where("doc_id is null"))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller doc_id has; a document of which nothing but white space is left goes.

    Null texts stay as they are, and so do rows without a doc_id; rows that repeat a doc_id take nothing from each other. An empty table
    gives an empty one.
    """
    cut = suffix_dedup.remove_repeats(docs.select(*COLUMNS), kept_text=True)
    cut = cut.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"\S"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thins out domains that are over their target weight, as their fitted rates say; no domain is repeated.

    The budget is what the scarcest domain allows, but the good domain is kept whole: its rate is brought to one, so toxic and
    poor texts are thinned relative to it and clean documents stay. Rows without a doc_id can't be drawn by it and stay. Rows that
    repeat a doc_id stay if any of them is drawn. An empty table gives an empty one.
    """
    mixed = mixing.mix(docs.select("doc_id", "text"), label_domains(spark, sf_dir), DOMAIN_TARGETS)
    mixed = Scratch(spark, "pipeline").keep(mixed.select("doc_id", "domain", "rate"), "rates")
    clean = mixed.where("domain = 'good'").agg(F.avg("rate")).first()[0] or mixed.agg(F.max("rate")).first()[0] or 1.0
    chance = F.pmod(F.xxhash64("doc_id", F.lit(0)), F.lit(1 << 30)) / float(1 << 30)
    drawn = mixed.where((F.col("domain") == "good") | (F.col("rate") / F.lit(float(clean)) > chance)).select("doc_id").distinct()
    docs = docs.select(*COLUMNS)
    return docs.join(drawn, "doc_id", "left_semi").select(*COLUMNS).union(docs.where("doc_id is null"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of every text, with counts and digests; a null text has none."""
    out = bpe.encode_column(docs.select(*COLUMNS), tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", remove_repeated_passages),
    ("mixing", mix_to_targets),
    ("bpe_encoding", encode),
]

#: SQL can't express the learned and hashed stages; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written to the shared folder before the next."""
    scratch = Scratch(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
