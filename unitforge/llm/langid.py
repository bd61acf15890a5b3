"""Language identification with a string kernel.

Blended-spectrum presence kernel: k(x, y) = |G(x) n G(y)| / sqrt(|G(x)| |G(y)|), G being the set of (hashed) byte n-grams of
one to three bytes of a whole text. Nystroem landmarks out of a bounded labelled sample span the feature space, one-versus-rest
kernel ridge regression gives a score a language, and texts are scored in batches by a matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets that n-grams are hashed to.
DIM = 1 << 14
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: ASCII other than letters counts as one blank; letters are lower-cased.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [ord(chr(i).lower()) if chr(i).isalpha() else 32 for i in range(128)]


def buckets(text: str) -> np.ndarray:
    """Distinct buckets of the n-grams of a whole text."""
    b = _FOLD[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    if len(b):
        keep = np.ones(len(b), dtype=bool)
        keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
        b = b[keep]
    seen = np.zeros(DIM, dtype=bool)
    b = b.astype(np.uint32)
    code, n = np.zeros(len(b), dtype=np.uint32), len(b)
    for k in range(3):
        if n <= k:
            break
        code = (code[: n - k] << np.uint32(8)) | b[k:]
        seen[((code + np.uint32(k << 26)) * np.uint32(0x9E3779B1)) >> np.uint32(18)] = True
    return np.flatnonzero(seen)


def _presence(column: str):
    """Rows of the training sample: language and the packed presence bits of the whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bits = []
            for text in pdf[column]:
                row = np.zeros(DIM, dtype=bool)
                row[buckets(text)] = True
                bits.append(np.packbits(row).tobytes())
            yield pd.DataFrame({"lang": pdf["lang"], "order": pdf["order"], "bits": bits})

    return run


def _normed(bits: pd.Series) -> np.ndarray:
    """Rows of presence bits, unpacked and brought to length one: 128 KB each, so only some at a time."""
    x = np.unpackbits(np.stack([np.frombuffer(b, dtype=np.uint8) for b in bits]), axis=1).astype(np.float64)
    x /= np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))
    return x


class Model:
    """weights: DIM x languages; a text's scores are the sum of its buckets' rows over the root of their number."""

    def __init__(self, langs: list[str], weights: np.ndarray):
        self.langs, self.weights = langs, weights

    def scores(self, texts: list[str]) -> np.ndarray:
        rows = np.zeros((len(texts), DIM), dtype=np.float32)
        for i, text in enumerate(texts):
            at = buckets(text)
            rows[i, at] = 1 / np.sqrt(max(1, len(at)))
        return rows @ self.weights


def fit(train: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 600, landmarks: int = 256, sample_rows: int = 20_000, ridge: float = 1e-3) -> Model | None:
    """Fit on a bounded sample of the labelled rows: per_lang texts of each language at most, fewer where that would pass sample_rows.

    The bound is in rows, of which the driver gets 2 KB each; every language is learned, and more languages than sample_rows are
    refused. Texts are drawn by a hash of key and text, so one key that many rows repeat crowds nothing out; rows that repeat both count
    once. Rows without text, letter or language teach nothing, those with a null key are drawn by their texts; None if no row is left,
    as of an empty table. Further columns are ignored.
    """
    rows = train.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string"), text).alias("hash"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n"), F.min("hash").alias("first")).limit(sample_rows + 1).collect()
    if not sizes:
        return None
    if len(sizes) > sample_rows:
        raise ValueError(f"more than {sample_rows} languages: raise sample_rows")
    per_lang = max(1, min(per_lang, sample_rows // len(sizes)))
    at = F.pmod("hash", F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, 1.2 * per_lang / r.n))])
    first = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, r.first)])
    drawn = rows.where((at < share[F.col("lang")]) | (F.col("hash") == first[F.col("lang")]))
    once = drawn.groupBy("lang", "hash").agg(F.min("text").alias("text")).withColumn("order", at)
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "hash")))
    sample = ranked.where(F.col("rank") <= per_lang).select("lang", "text", "order")
    got = sample.mapInPandas(_presence("text"), "lang string, order double, bits binary").orderBy("order", "bits").toPandas()
    if got.empty:
        return None
    langs = sorted(got["lang"].unique())
    y = np.where(got["lang"].to_numpy()[:, None] == np.array(langs, dtype=object)[None, :], 1.0, -1.0)
    chosen = np.unique(np.linspace(0, len(got) - 1, min(landmarks, len(got))).astype(int))
    marks = _normed(got["bits"].iloc[chosen])
    values, vectors = np.linalg.eigh(marks @ marks.T)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # inverse root of the landmarks' kernel
    phi = np.concatenate([_normed(got["bits"].iloc[a : a + 256]) @ marks.T for a in range(0, len(got), 256)]) @ root
    classes = (y > 0).sum(0)
    weight = ((y > 0) / classes).sum(1)[:, None] * len(got) / len(langs)  # each language counts alike
    w = np.linalg.solve(phi.T @ (weight * phi) + ridge * len(got) * np.eye(phi.shape[1]), phi.T @ (weight * y))
    return Model(langs, (marks.T @ (root @ w)).astype(np.float32))


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Append lang_pred and score (0 to 1) to df; columns of these names are replaced, others stay.

    A null text, an empty one and one without any letter (Unicode's category L) give und with score 0, as does every text where the
    model is None. Of languages with equal scores the first by name stands. Whole texts are read whatever their length; rows are
    independent, so repeated rows get equal results. An empty table gives an empty one.
    """
    new = ("lang_pred", "score")
    df = df.select([F.col(f"`{c}`") for c in df.columns if c == text or c.lower() not in new])
    schema = T.StructType([*(f for f in df.schema.fields if f.name.lower() not in new), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 128):
                batch = big.slice(at, 128)
                texts = batch.column(text).to_pylist()
                langs, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                ok = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if model else []
                if ok:
                    s = model.scores([texts[i] for i in ok])
                    best = s.argmax(1)
                    for i, k, v in zip(ok, best.tolist(), s.max(1).tolist(), strict=True):
                        langs[i], score[i] = model.langs[k], min(1.0, max(0.0, (v + 1) / 2))
                kept = [(n, batch.column(j)) for j, n in enumerate(batch.schema.names) if n.lower() not in new]
                yield pa.RecordBatch.from_arrays([*[c for _, c in kept], pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*[n for n, _ in kept], *new])

    return df.mapInArrow(run, schema)
