"""Queries of the training-data operators over their whole tables, with production parameters; SQL where it can express them."""

from __future__ import annotations

import re
import string
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Fixed values of the contract.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page: rules first, else link-graph propagation. Null addresses have an empty host and are allowed; an empty table gives none."""
    from .url_filter import judge

    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), URL_RULES)


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, its edited form and the next document's, and its near-duplicate class by fingerprints (component_id, kept).

    Null texts count as empty; equal doc_ids are ordered by a hash of their texts, and each row is classed by its own text. A class is
    named by its smallest doc_id; rows without a doc_id are named by others of their class, or null. An empty table gives an empty one.
    """
    from . import spotsigs as S

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = S.add_signatures(docs, "text", "sigs")
    classes = S.near_classes(signed, "doc_id", "sigs")
    classes = signed.select("doc_id", F.xxhash64("text").alias("tie"), S.set_digest(F.col("sigs")).alias("digest")).join(classes, "digest").select("doc_id", "tie", "component_id")
    docs = S.with_next(docs, "doc_id", ["text", "sigs"], F.xxhash64("text"), derive=lambda df: S.add_signatures(df, "text", "sigs"), beside=classes)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    docs = docs.select("doc_id", "component_id", n.cast("long").alias("n_chars"), "sigs", "next_sigs", edited.alias("edited"))
    docs = S.add_signatures(docs, "edited", "edited_sigs")
    docs = docs.select(
        "doc_id", "component_id", "n_chars", "sigs", "edited_sigs", F.sha2("edited", 256).alias("edited_sha256"),
        S.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), S.likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
    component = F.coalesce("component_id", "doc_id")
    return docs.select(
        "doc_id", "n_chars", "edited_sha256", S.as_text(F.col("sigs")).alias("fingerprint"), S.as_text(F.col("edited_sigs")).alias("edited_fingerprint"), "near_edited", "near_next",
        component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document; see lsh_forest.near_duplicates for null and repeated keys and texts without words."""
    from .lsh_forest import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of every text's ids and of what they decode to. Null texts count as empty; repeated rows stay."""
    from .bpe import encode_column

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_column(docs, tokenizer_path("word_bpe_49k.json"), ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and words of every text. Null texts have none of either; repeated rows stay."""
    from .token_counts import count_column

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_column(docs, tokenizer_path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "n_words")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned without the rows whose crc32(doc_id) mod 4 is 2. Null texts and such without a letter give und."""
    from . import langid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


#: What the mixing query trains on and aims at: tokens by domain; little toxic text is wanted.
DOMAIN_TARGETS = {"good": 0.92, "low": 0.07, "toxic": 0.01}


def label_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain) of the labelled documents: toxic, low (quality 0) or good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors and fitted rates of every document. Null texts have no tokens; documents without a label weigh like others."""
    from .mixing import mix

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mix(docs, label_domains(spark, sf_dir), DOMAIN_TARGETS)


def op2_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and class of every vector; see rp_forest.near_duplicates for null, zero and non-finite vectors and repeated keys."""
    from .rp_forest import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page into seekable bundles and reads all records back. Null markup is an empty payload."""
    from . import warc
    from .common import Scratch

    scratch = Scratch(spark, "op3")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    index = warc.write_bundles(warc.mark_revisits(pages, "html", "page_id"), "html", "page_id", "url", scratch.path("bundles"), scratch=scratch)
    records = warc.read_records(index, payloads=False)
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that every document loses to ones with a smaller doc_id. Null texts count as empty, rows with a null key lose nothing."""
    from .suffix_dedup import remove_repeats

    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op11_kd_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector of 64 finite components after five rounds from 40 hashed centroids; other vectors give no row. See kd_means.cluster."""
    from .kd_means import cluster

    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op12_quotient_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document. Null texts count as empty; see quotient_filter.exact_duplicates for null and repeated keys."""
    from .quotient_filter import exact_duplicates

    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def tiled_tail(text: str, g: int) -> str:
    """Words of a text, joined by spaces, with those from number g % n on repeating with the period that the contract of op13 sets."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return ""
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(words[:a] + [words[a + i % p] for i in range(n - a)])


def op13_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every text, after one in ten was given a repeating tail. Null texts have none; a null doc_id gets no tail; repeated rows stay."""
    from .periodic_runs import periodic_runs

    @F.pandas_udf("string")
    def tiled(text: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else tiled_tail(t, int(k)) for t, k in zip(text, g, strict=True)], dtype=object)

    h = F.crc32(F.col("doc_id").cast("string"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tail = tiled(F.when(h % 10 == 0, F.col("text")), F.coalesce(F.floor(h / 10), F.lit(0).cast("long")))
    out = periodic_runs(docs.select("doc_id", F.coalesce(tail, "text").alias("text")))
    best = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda a, x: F.when(a.isNull() | (x.length * a.period > a.length * x.period), x).otherwise(a))
    lines = F.transform("runs", lambda x: F.concat(x.start.cast("string"), F.lit(","), x.length.cast("string"), F.lit(","), x.period.cast("string"), F.lit("\n")))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_rp_forest": op2_rp_forest,
    "op3_warc_bundles": op3_warc_bundles,
    "op4_url_filter": op4_url_filter,
    "op5_spotsigs": op5_spotsigs,
    "op6_lsh_forest": op6_lsh_forest,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_unigram_counts": op8_unigram_counts,
    "op9_language_id": op9_language_id,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_kd_means": op11_kd_means,
    "op12_quotient_filter": op12_quotient_filter,
    "op13_harmonic_runs": op13_harmonic_runs,
}



def _means_sql(k: int = 40, rounds: int = 5) -> str:
    """The clustering in SQL, one pair of tables a round."""
    nearest = """SELECT vec_id, v, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM (
          SELECT p.vec_id, p.v, m.c, CAST(list_sum(list_transform(range(1, 65), lambda i: (p.v[i] - m.v[i]) * (p.v[i] - m.v[i]))) AS BIGINT) AS d FROM p CROSS JOIN m{n} m
        ) GROUP BY vec_id, v"""
    steps = [f"""p AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
        ), m0 AS (
          SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS c, v FROM p
          ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)) LIMIT {k}
        )"""]  # fmt: skip
    for n in range(rounds):
        steps.append(f"""a{n} AS MATERIALIZED (
        {nearest.format(n=n)}
        ), s{n} AS (
          SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{n}) GROUP BY c, i
        ), m{n + 1} AS MATERIALIZED (
          SELECT m.c, coalesce(u.v, m.v) AS v FROM m{n} m LEFT JOIN (
            SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{n} GROUP BY c
          ) u ON m.c = u.c
        )""")
    steps.append(f"r AS (\n        {nearest.format(n=rounds)}\n        )")
    return "WITH " + ", ".join(steps) + f"""
        SELECT r.vec_id, CAST(r.c AS INTEGER) AS cluster, r.d AS distance, CAST(sum(r.d) OVER (PARTITION BY r.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(r.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
        FROM r JOIN m{rounds} m ON r.c = m.c"""


ORACLE_SQL: dict[str, str] = {
    "op11_kd_means": _means_sql(),
    "op12_quotient_filter": f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(normal) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS normal FROM documents)
        WINDOW w AS (PARTITION BY normal)""",
    "op3_warc_bundles": """
        WITH p AS (
          SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
          FROM pages
        ), m AS (
          SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first_id = page_id THEN NULL ELSE first_id END AS refers_to
        FROM m""",
}
