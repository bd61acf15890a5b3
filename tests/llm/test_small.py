"""Parts of the operators without Spark, against libraries and brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from unitforge.llm import bpe, langid, lsh_forest, suffix_dedup, token_counts
from unitforge.llm.queries import tokenizer_path

PIECES = [("<unk>", -5.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("▁a", -2.0), ("aba", -2.5), ("bb", -1.5), ("cd", -2.0), ("c", -30.0)]
ODD = ["", "  ", "a", " a", "a  b ", "▁x", "日本語 テキスト", "\n\n", "<|endoftext|>x <|STARTOFTEXT|>", "😀😀 a", "x" * 3000, "a\x1cb", "İ ΣΑΣ ß ÿ é é ́x", "I'LL don't 12ab!?x", "\xa0z\u3000q"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.ChunkEncoder(tokenizer_path("word_bpe_49k.json"), mean_chars=16, words=50, chunks=5)


def agrees(encoder, text):
    ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    raw = encoder.encode(text)
    assert raw == np.array(ids, dtype="<u4").tobytes()
    assert encoder.decode(raw) == encoder.tokenizer.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_bpe_odd(encoder, text):
    agrees(encoder, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdeABC \n\t.,!'é́Ñß0日<|>endoftx\xa0\x1d")), max_size=120))
def test_bpe_any(encoder, text):
    agrees(encoder, text)


def test_chunks_are_shared():
    rng = random.Random(1)
    a, b = ("".join(rng.choice("abcdef ") for _ in range(4000)) for _ in range(2))

    def cut(t):
        bounds = bpe.chunk_bounds(t, 64)
        return {t[x:y] for x, y in zip(bounds, bounds[1:], strict=False)}

    assert len(cut(a + "x") & cut(b[:777] + a)) > 0.9 * len(cut(a))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcde ▁\n")), max_size=20))
def test_unigram_ties(text):
    from tokenizers import Tokenizer, models, pre_tokenizers

    library = Tokenizer(models.Unigram(PIECES, unk_id=0, byte_fallback=False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    assert token_counts.Counter(PIECES, False).count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_unigram_production():
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.load_pieces(tokenizer_path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    counter = token_counts.Counter(pieces)
    for text in [*ODD, "The quick brown fox, jumped.", "<s>x</s><0x41>"]:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=0, max_size=120) | st.lists(st.integers(1, 40), max_size=150), st.sampled_from([(300, 16), (0, 1), (0, 2), (0, 5)]))
def test_suffix_array(values, blocks):
    s = np.array([*values, 0])
    old = suffix_dedup.FEW, suffix_dedup.BLOCKS
    suffix_dedup.FEW, suffix_dedup.BLOCKS = blocks
    try:
        order = suffix_dedup.suffix_array(s, int(s.max()) + 1)
    finally:
        suffix_dedup.FEW, suffix_dedup.BLOCKS = old
    assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("kinds", [700, 20_000])
def test_suffix_array_of_a_large_alphabet(kinds):
    """Names of reduced strings are many here, and long passages repeat: every level sorts by induction."""
    rng = np.random.default_rng(3)
    part = rng.integers(1, kinds, 2000)
    s = np.concatenate([part, part, np.full(300, 5), part[500:900], np.tile([7, 9], 200), part[::-1], [0]])
    assert suffix_dedup.suffix_array(s, kinds).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=10, max_size=40), min_size=1, max_size=8))
def test_smallest_holders(texts):
    parts = [t.encode() for t in texts]
    low = np.arange(len(parts))[::-1].copy()
    got = suffix_dedup.smallest_holders(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts]), low, 10)
    for part, own in zip(parts, got, strict=True):
        for p, h in enumerate(own.tolist()):
            assert h == min(low[i] for i, other in enumerate(parts) if part[p : p + 10] in other)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=60, max_size=140), min_size=2, max_size=6), st.randoms())
def test_fragments_that_may_share(texts, rng):
    """A fragment that shares a window with another one of its minimizer is never left out."""
    texts = [*texts, texts[0][10:100] + texts[-1], texts[0]]
    raws = [t.encode() for t in texts]
    raw = np.frombuffer(b"".join(raws), dtype=np.uint8)
    code, _, first, last = suffix_dedup.minimizers(raw, np.cumsum([len(r) for r in raws]), 50)
    parts = list(dict.fromkeys((int(c), raw[a : b + 49].tobytes()) for c, a, b in zip(code, first, last, strict=True)))
    rng.shuffle(parts)
    may = suffix_dedup.may_share(np.frombuffer(b"".join(f for _, f in parts), np.uint8), np.array([len(f) for _, f in parts]), np.array([c for c, _ in parts]), 50)
    for i, (c, f) in enumerate(parts):
        windows = {f[p : p + 50] for p in range(len(f) - 49)}
        if any(d == c and j != i and any(w in g for w in windows) for j, (d, g) in enumerate(parts)):
            assert may[i]


def test_shingles():
    assert len(lsh_forest.shingles(None)) == len(lsh_forest.shingles("")) == len(lsh_forest.shingles(" \n\t")) == 0
    assert len(lsh_forest.shingles("a b")) == 1
    assert len(lsh_forest.shingles("a b c d e f")) == 2
    assert lsh_forest.shingles("A b\x0bC  d E").tolist() == lsh_forest.shingles("a b c d e ").tolist()
    assert lsh_forest.shingles("É b c d e").tolist() != lsh_forest.shingles("é b c d e").tolist()
    assert len(lsh_forest.shingles("x" * 20_000 + " a b c d e")) == 2


def test_buckets():
    assert len(langid.buckets("")) == 0
    assert langid.buckets("AB").tolist() == langid.buckets("ab").tolist()
    assert hashlib.sha256(langid.buckets("hello, world").tobytes()).hexdigest() == hashlib.sha256(langid.buckets("HELLO  world").tobytes()).hexdigest()
