"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last characters cuts every text into chunks whose borders depend on the content alone, so a
passage that several documents share gives the same chunks in each of them and is encoded once by a worker. A chunk's
inner words are encoded apart from its neighbours; at a chunk join the broken word is put together again and re-encoded,
growing to the left and right until it ends at white space on both sides. There the tokenizer's own splitting makes the
parts independent, so that the repaired ids agree exactly with those of the whole text (tests compare them).
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 8
#: str.split() also cuts at these four, the tokenizer's \s does not; texts that hold them are encoded as a whole.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Words beyond so many characters, and chunks beyond so many mean lengths, are encoded each time: caches are bounded in bytes too.
LONG_WORD, LONG_CHUNK = 512, 4
#: A run of Latin-1 letters and the punctuation after it.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&|)]*)")
_MULTIPLIERS = np.array([pow(0x9E3779B1, i + 1, 1 << 32) for i in range(WINDOW)], dtype=np.uint32)


def chunk_bounds(text: str, mean_chars: int) -> list[int]:
    """Content-defined cut positions of a text, 0 and its length included; mean_chars is a power of two."""
    n = len(text)
    if n <= WINDOW:
        return [0, n]
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h = np.zeros(n - WINDOW + 1, dtype=np.uint32)
    for j in range(WINDOW):
        h += c[j : n - WINDOW + 1 + j] * _MULTIPLIERS[j]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    cuts = np.flatnonzero((h >> np.uint32(8)) & np.uint32(mean_chars - 1) == 0) + WINDOW
    return [0, *cuts[cuts < n].tolist(), n]


class _Cache:
    """Two generations of a dictionary: at most 2 * limit entries, the younger ones kept."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


class ChunkEncoder:
    """Encodes texts through word and chunk caches of bounded size."""

    def __init__(self, path: str, mean_chars: int = 1024, words: int = 150_000, chunks: int = 4_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mean_chars = mean_chars
        self.max_words, self.chunks = words, _Cache(chunks)
        self.ids, self.old_ids, self.marks = {}, {}, {}
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
        self.token = [""] * len(self.ends_word)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_word[i], self.token[i] = token.endswith("</w>"), token
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_chars = {i: byte_level.pre_tokenize_str(chr(i))[0][0] for i in range(128, 256)}
        #: Whether words can be encoded apart from each other, as with a vocabulary that marks word ends.
        self.by_word = bool(self.ends_word.any()) and self.tokenizer.decoder is None

    def forget(self) -> None:
        """Empty the caches: a worker that goes on to other work keeps the tokenizer alone."""
        self.chunks, self.ids, self.old_ids = _Cache(self.chunks.limit), {}, {}

    def whole(self, text: str) -> bytes:
        """The plain way: the whole text at once."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode words not seen before.

        A run of Latin-1 letters with or without punctuation after it is the commonest word; the tokenizer lower-cases it and
        splits it into the run and the punctuation, each of which goes to the BPE model. Any other word takes the tokenizer's
        whole way.
        """
        known, model, table = self.ids, self.tokenizer.model, self.byte_chars
        for w in words:
            if (m := SIMPLE.fullmatch(w)) is None:
                known[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
                continue
            base, punctuation = m[1].lower(), m[2]
            raw = known.get(base)
            if raw is None:
                raw = array("I", [t.id for t in model.tokenize(base.translate(table))]).tobytes()
            if punctuation:
                if (end := self.marks.get(punctuation)) is None:
                    end = array("I", [t.id for t in model.tokenize(punctuation)]).tobytes()
                    if len(self.marks) < 10_000:
                        self.marks[punctuation] = end
                raw += end
            known[w] = raw

    def _encode_words(self, words: list[str]) -> bytes:
        if len(max(words, key=len, default="")) > LONG_WORD:
            return b"".join([self.whole(w) if len(w) > LONG_WORD else self._encode_words([w]) for w in words])
        try:
            return b"".join(map(self.ids.__getitem__, words))
        except KeyError:
            pass
        if len(self.ids) >= self.max_words:  # the elder generation goes; words still in use come back from it
            self.old_ids, self.ids = self.ids, {}
        fresh = []
        for w in set(words).difference(self.ids):
            if (value := self.old_ids.get(w)) is not None:
                self.ids[w] = value
            else:
                fresh.append(w)
        self._learn(fresh)
        return b"".join(map(self.ids.__getitem__, words))

    def _chunk(self, text: str) -> tuple[str, bytes, str]:
        """Partial word at the start, ids of the inner words, partial word at the end."""
        if (value := self.chunks.get(text)) is None:
            words = text.split()
            head = "" if text[:1].isspace() else words.pop(0)
            tail = "" if text[-1:].isspace() else words.pop()
            value = (head, self._encode_words(words), tail)
            if len(text) <= LONG_CHUNK * self.mean_chars:
                self.chunks.put(text, value)
        return value

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.by_word or ODD_SPACE.search(text):
            return self.whole(text)
        if "<|" not in text:  # no special token can come from it
            try:
                text.encode("latin-1")
                text = text.lower()  # here Python and the tokenizer agree, and caches hold fewer words
            except UnicodeEncodeError:
                pass
        bounds = chunk_bounds(text, self.mean_chars)
        ids, carry = [], ""
        for a, b in zip(bounds, bounds[1:], strict=False):
            chunk = text[a:b]
            if len(chunk.split(None, 1)) < 2 and not (chunk[:1].isspace() or chunk[-1:].isspace()):
                carry += chunk  # the join has no white space yet: it grows by the whole chunk
                continue
            head, inner, tail = self._chunk(chunk)
            if join := carry + head:
                ids.append(self._encode_words([join]))
            ids.append(inner)
            carry = tail
        if carry:
            ids.append(self._encode_words([carry]))
        return b"".join(ids)

    def decode(self, raw: bytes) -> str:
        ids = np.frombuffer(raw, dtype="<u4").tolist()
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return " ".join(map(self.token.__getitem__, ids))  # without a decoder the library joins tokens with blanks


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, mean_chars: int) -> ChunkEncoder:
    """One encoder a Python worker; its caches serve a task and are emptied at its end."""
    if (path, mean_chars) not in _ENCODERS:
        _ENCODERS[path, mean_chars] = ChunkEncoder(path, mean_chars)
    return _ENCODERS[path, mean_chars]


def encode_column(df: DataFrame, path: str, column: str = "text", mean_chars: int = 1024, ids: bool = True) -> DataFrame:
    """Append n_tokens, token_ids (little-endian unsigned 32-bit, binary), ids_sha256, decoded and decoded_sha256 to df.

    df: any rows. A null text counts as empty: no ids, empty decoded text. Repeated rows, further columns and ties need no
    order and stay as they are; columns named like the new ones are replaced. An empty table gives an empty table. Very
    long texts are chunked, and a text without white space is one join. With ids=False the ids and the decoded text
    themselves stay out, and only counts and digests are made.
    """
    from pyspark.sql import types as T

    new = [T.StructField("n_tokens", T.LongType()), *([T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.StringType())] if ids else []), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    names = {f.name.lower() for f in new} - {column.lower()}
    df = df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    if not ids:
        df = df.select([F.col(f"`{c}`") for c in df.columns])
    schema = T.StructType([*df.schema.fields, *new])
    return df.mapInArrow(_task(path, column, mean_chars, ids), schema)


def _task(path: str, column: str, mean_chars: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, mean_chars)
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                counts, all_ids, decoded, sha_ids, sha_decoded = [], [], [], [], []
                for text in batch.column(column).to_pylist():
                    raw = enc.encode(text or "")
                    back = enc.decode(raw)
                    counts.append(len(raw) // 4)
                    sha_ids.append(hashlib.sha256(raw).hexdigest())
                    sha_decoded.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                    if with_ids:
                        all_ids.append(raw)
                        decoded.append(back)
                extra = [pa.array(counts, pa.int64()), *([pa.array(all_ids, pa.binary()), pa.array(decoded, pa.string())] if with_ids else []), pa.array(sha_ids, pa.string()), pa.array(sha_decoded, pa.string())]
                names = ["n_tokens", *(["token_ids", "decoded"] if with_ids else []), "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *names])
        enc.forget()

    return run
