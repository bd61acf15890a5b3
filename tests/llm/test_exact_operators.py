"""Counting quotient filters, kd-tree clustering and periodic runs against brute force."""

import hashlib
import random
import re
import string
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from unitforge.llm import kd_means, langid, lsh_forest, periodic_runs, quotient_filter, suffix_dedup, token_counts
from unitforge.llm.queries import op11_kd_means, op12_quotient_filter, op13_harmonic_runs, tiled_tail

# --- counting quotient filters ---------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 2**20) | st.integers(2**56, 2**58 - 1), st.integers(1, 10**12), max_size=40), max_size=5))
def test_filters_merge_without_loss(filters):
    want, parts = defaultdict(int), []
    for f in filters:
        prints = np.array(sorted(f), dtype=np.uint64)
        parts.append(quotient_filter.unpack(quotient_filter.pack(prints, np.array([f[int(x)] for x in prints], np.int64), 58)))
        for x, n in f.items():
            want[x] += n
    if parts:
        prints, counts = quotient_filter.merge(parts)
        assert dict(zip(prints.tolist(), counts.tolist(), strict=True)) == want
        assert (np.diff(prints.astype(object)) > 0).all()


def lower(t):
    return (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def equal_groups(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[lower(t)].append(k)
    return groups


def check_copies(out, rows):
    groups, got = equal_groups(rows), defaultdict(list)
    for r in out:
        got[r.text_sha256].append(r)
    assert len(out) == len(rows) and set(got) == {hashlib.sha256(t.encode()).hexdigest() for t in groups}
    for t, keys in groups.items():
        best, own = max((k for k in keys if k is not None), default=None), got[hashlib.sha256(t.encode()).hexdigest()]
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in own) == sorted((k is None, k or 0) for k in keys)
        assert {(r.keep_id, r.group_size) for r in own} == {(best, len(keys))}
        assert [r.doc_id for r in own if r.kept] == [best]


COPIES = [(1, "Same"), (2, "same"), (3, "SAME "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 300_000), (9, "X" * 300_000), (9, "one"), (9, "One"), (9, "One"), (None, "only"), (None, "none"), (None, "None"), (10, "none"), (11, "İ"), (12, "K")]


@pytest.mark.parametrize(("bits", "broadcast", "frequent"), [(64, 1 << 20, 10_000), (3, 1 << 20, 5), (64, 0, 5), (3, 0, 5)])
def test_exact_duplicates(spark, bits, broadcast, frequent):
    rng = random.Random(3)
    rows = COPIES + [(rng.randrange(100, 900), rng.choice(["Hot"] * 60 + [f"t{i % 70}" for i in range(110)])) for _ in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, t, "e", 1, "s") for k, t in rows], "doc_id long, text string, normal string, print int, sha string").repartition(5)
    out = quotient_filter.exact_duplicates(df, bits=bits, broadcast=broadcast, frequent=frequent)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    check_copies(out.collect(), rows)


def test_exact_duplicates_shares_of_frequent_texts(spark, monkeypatch):
    monkeypatch.setattr(quotient_filter, "SHARED", 3)
    rows = [(i, "hot" if i % 3 else f"t{i % 7}") for i in range(300)]
    check_copies(quotient_filter.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect(), rows)


def test_repeated_prints_of_many_filters(spark):
    rng = random.Random(5)
    prints = [rng.choice([-(2**63), -1, 0, 2**63 - 1, rng.randrange(-(2**63), 2**63)]) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in prints], "print long").repartition(3)
    got = {r.print: r.n for r in quotient_filter.repeated_prints(df, 2000, flush=50).collect()}
    assert got == {x: prints.count(x) for x in set(prints) if prints.count(x) > 1}


def test_exact_duplicates_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op12_quotient_filter(spark, str(tmp_path)).collect() == []
    assert op13_harmonic_runs(spark, str(tmp_path)).collect() == []


# --- kd-tree clustering ----------------------------------------------------------------------------------------------


def plain_means(rows, k, rounds, dims, scale, seed):
    kept = [(i, tuple(int(np.floor(scale * float(x))) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    hashed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in hashed[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for i, own in groups.items():
            centroids[i] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    out = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = defaultdict(int)
    for _, c, d in out:
        inertia[c] += d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in out), key=str)


@pytest.mark.parametrize("spread", [0.01, 1.0, 20_000.0])
def test_means(spark, spread):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(6, 8))
    rows = [(int(i), [float(x) for x in middles[i % 6] * spread + rng.normal(size=8) * spread / (20 if i % 2 else 3)]) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(500, 600)] + [(7, rows[0][1]), (7, rows[1][1]), (None, rows[2][1])]
    odd = [(900, None), (901, [1.0] * 7), (902, [1.0] * 7 + [None]), (903, [float("nan")] * 8), (904, [float("inf")] + [0.0] * 7), (905, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], "vec_id long, embedding array<double>, cluster string, id int").repartition(3)
    scale = 256
    out = kd_means.cluster(df, k=9, rounds=3, dims=8, scale=scale, tree=64)
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain_means(rows, 9, 3, 8, scale, 2)


def test_means_of_few_and_none(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [1.0] * 64)], "vec_id long, embedding array<float>")
    assert sorted(r.cluster for r in kd_means.cluster(df).collect()) == [0, 0]
    df.limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op11_kd_means(spark, str(tmp_path)).collect() == []
    with pytest.raises(ArithmeticError, match="squared distances"):
        kd_means.cluster(df.selectExpr("vec_id", "transform(embedding, x -> 1e30D * x) embedding"))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 200), st.integers(1, 12), st.sampled_from([2, 5, 1 << 24]))
def test_tree_filter(seed, n, k, span):
    """Ties and equal centroids included."""
    rng = np.random.default_rng(seed)
    points, centroids = rng.integers(-span, span, (n, 3)), rng.integers(-span, span, (k, 3))
    order, nodes = kd_means.build_tree(points, leaf=4)
    tree = kd_means.Tree(points[order], nodes)
    cluster, distance = tree.assign(centroids)
    every = ((points[order][:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    counts, sums = np.zeros(k, np.int64), np.zeros((k, 3), np.int64)
    tree.gather(centroids, counts, sums)
    assert (counts == np.bincount(cluster, minlength=k)).all()
    assert all((sums[c] == points[order][cluster == c].sum(axis=0)).all() for c in range(k))


def test_tree_assigns_nodes_whole():
    points = np.concatenate([np.random.default_rng(1).integers(0, 50, (500, 4)) + 1000 * c for c in range(4)])
    order, nodes = kd_means.build_tree(points)
    whole = [b - a for a, b, who in kd_means.Tree(points[order], nodes).filter(np.array([[1000 * c + 25] * 4 for c in range(4)])) if isinstance(who, int)]
    assert max(whole) > 10 * kd_means.LEAF and sum(whole) == len(points)


# --- periodic runs ---------------------------------------------------------------------------------------------------


def plain_runs(words, least=6, times=4):
    found, n = set(), len(words)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j + p - i
            if length >= max(least, times * p):
                own = words[i : j + p]
                if not any(all(own[x] == own[x + q] for x in range(length - q)) for q in range(1, p)):
                    found.add((i, length, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60) | st.builds(lambda a, b, k, c: a + b * k + c, *[st.lists(st.integers(0, 3), max_size=7)] * 2, st.integers(0, 9), st.lists(st.integers(0, 3), max_size=7)), max_size=4), st.sampled_from([3, 1 << 17]))
def test_runs(texts, words):
    old, periodic_runs.WORDS = periodic_runs.WORDS, words
    try:
        got = periodic_runs.find_runs([np.array(t, np.int64) for t in texts])
    finally:
        periodic_runs.WORDS = old
    assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=2, max_size=150), st.randoms())
def test_extensions(codes, rng):
    e = periodic_runs.Extensions(np.array(codes))
    pairs = [rng.sample(range(len(codes)), 2) for _ in range(50)]

    def plain(i, j):
        k = 0
        while max(i, j) + k < len(codes) and codes[i + k] == codes[j + k]:
            k += 1
        return k

    assert e(*np.array(pairs).T).tolist() == [plain(i, j) for i, j in pairs]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(alphabet=st.sampled_from(list("aé日\xa0 \t\n\x0b\x1c\x85")), max_size=20), max_size=6))
def test_split_words(texts):
    codes, bounds, words = periodic_runs.split_words(pa.array([*["odd"], *texts], pa.string()).slice(1))
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert [[words[int(c)].as_py().decode() for c in codes[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)] == want


def digest_row(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = None if key is None else zlib.crc32(str(key).encode())
    if words and h is not None and h % 10 == 0:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{p}\n" for s, n, p in runs), " ".join(w for i, w in enumerate(words) if i not in gone))]
    return (key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *sha)


def test_runs_query(spark, tmp_path):
    """Nulls, empty texts, repeated keys, extra columns, one long text and one text under many keys."""
    rng = random.Random(9)
    words = [rng.choice(["a", "b", "c", "日本"]) for _ in range(400)]
    texts = [None, "", " \t", "a", "a a a a a a", "x y " * 9, "a b a b a c " * 5, "\x0ba\x0cb\r\n" * 8, "a\x1cb \x85 " * 6, " ".join(words), "q " * 3000, "a b c d " * 700, " ".join(str(i) for i in range(2000))]
    rows = [(i, rng.choice(texts)) for i in range(150)] + [(None, "z " * 8), (None, None), (10, "k " * 7), (10, "k " * 7)]
    pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows], "runs": 1, "_text": "e"}).to_parquet(f"{tmp_path}/documents.parquet")
    out = op13_harmonic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    known = {t: digest_row(None, t)[1:] for t in {r[1] for r in rows}}
    want = [(k, *known[t]) if k is None or zlib.crc32(str(k).encode()) % 10 else digest_row(k, t) for k, t in rows]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_runs_operator_columns(spark):
    df = spark.createDataFrame([(1, "x", "a " * 6)], "text long, runs string, body string")
    out = periodic_runs.periodic_runs(df, keep=("text", "runs"), text="body")
    assert [tuple(r) for r in out.collect()] == [(1, [(0, 6, 1)], "a")]


def test_tiled_tail():
    assert tiled_tail(" ", 5) == ""
    assert tiled_tail("a b\tc d e f g h", 8) == "a b c d e f g h".replace("d e f g h", "a b c a b")  # from word 0, period 1 + 8 // 3


# --- repeated keys of earlier operators --------------------------------------------------------------------------------


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def key_classes(rows):
    """Brute force: a key's texts and all that link with one of them are one class, named by its smallest key."""
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        if w and k is not None:
            sets.setdefault(k, set()).add(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))))
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in sets}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_lsh_forest_texts_of_one_key(spark, seed):
    rng = random.Random(11)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(2, None), (2, a), (2, " "), (1, a + " x"), (3, b), (5, b), (5, c), (7, c + " y"), (9, d), (9, d), (8, None), (4, d + " z"), (None, b), (6, b + " end"), (10, c), (10, a)]
    for some in (rows[:4], rows[4:8], rows):
        some = random.Random(seed).sample(some, len(some))
        out = lsh_forest.near_duplicates(spark.createDataFrame(some, "doc_id long, text string").coalesce(1)).collect()
        want = key_classes(some)
        assert len(out) == len(some)
        for r in out:
            alone = r.doc_id is None or not r.n_shingles
            assert r.component_id == (r.doc_id if alone else want[r.doc_id]), r
            assert r.kept == (r.doc_id == r.component_id)


def test_language_sample_with_one_frequent_key(spark):
    rng = random.Random(12)
    parts = {"aa": "the ing and er on", "bb": "der und ich ein sch", "cc": "que los ción as el"}

    def text(k):
        return " ".join("".join(rng.choice(parts[k].split()) for _ in range(3)) for _ in range(20))

    rows = [(i, text(k), k) for k in parts for i in range({"aa": 300, "bb": 40, "cc": 3}[k])]
    for key, other in ((40777, None), (None, None), (40777, "same und ich"), (1, None)):
        many = rows + [(key, other or text("bb"), "bb") for _ in range(4 * len(rows))]
        rng.shuffle(many)
        model = langid.fit(spark.createDataFrame(many, "doc_id long, text string, lang string"), per_lang=50)
        assert model.langs == ["aa", "bb", "cc"]
        got = langid.predict(spark.createDataFrame([(k, text(k)) for k in parts for _ in range(5)], "doc_id string, text string"), model).collect()
        assert sum(r.lang_pred == r.doc_id for r in got) >= 14


# --- clashing columns and bounded caches -------------------------------------------------------------------------------


def test_suffix_dedup_columns_of_any_name(spark):
    text = " ".join(str(i * 7919) for i in range(60))
    rows = [(1, text, "a", 1, True, "x", [1]), (2, "new " + text, "b", 2, False, "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string, _id int, _copy boolean, c0 string, _spans array<int>")
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(df).collect()}
    assert out[1].n_removed == 0 and out[2].n_removed == len(text)
    assert [(out[k]._text, out[k]._id, out[k]._copy, out[k].c0, out[k]._spans) for k in (1, 2)] == [r[2:] for r in rows]


def test_long_words_stay_out_of_the_counter_cache():
    counter = token_counts.Counter([("<unk>", -5.0), ("\u2581", -1.0), ("a", -1.0)], False)
    n = counter.count("a" * 5000 + " aa")
    assert n == counter.count("a" * 5000 + " aa") and all(len(w) <= token_counts.LONG_WORD for w in counter.young)
