"""Operators on small tables, against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitforge.llm import bpe, langid, lsh_forest, mixing, rp_forest, spotsigs, suffix_dedup, token_counts, url_filter, warc
from unitforge.llm.common import Scratch, connected_components
from unitforge.llm.queries import QUERIES, URL_RULES, tokenizer_path

DOCS = "doc_id long, text string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    passage = words(rng, 30)
    texts = [words(rng, rng.choice([3, 20, 80])) for _ in range(n)]
    for _ in range(25):
        base = rng.choice(texts).split()
        if len(base) > 10:
            base[rng.randrange(len(base))] = "edited"
        texts.append(" ".join(base))
    texts += [f"{words(rng, 15)} {passage} {words(rng, 15)}" for _ in range(12)]
    texts += [None, "", "   ", "one two", "one two", "x" * 9000, "é" * 60 + " ñ", texts[0], texts[0]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


def union(pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5), Scratch(spark, "t")).collect()}
    want = union(edges, {x for e in edges for x in e})
    assert all(got.get(k, k) == v for k, v in want.items())


def test_lsh_forest(spark):
    rows = corpus()
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = union(pairs, sets)
    df = spark.createDataFrame(rows, DOCS).withColumns({"id": F.lit("x"), "n_shingles": F.lit(-1)})
    got = lsh_forest.near_duplicates(df).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert lsh_forest.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_lsh_forest_repeated_and_null_keys(spark):
    """Texts under one key are one document: it joins what any of them links with."""
    rng = random.Random(4)
    x, z, u = (words(rng, 200, 5000) for _ in range(3))
    rows = [(0, x), (5, x + " end"), (5, z + " end"), (3, z), (None, x), (5, None), (8, u), (8, u)]
    got = Counter((r["doc_id"], r["component_id"], r["kept"], r["n_shingles"] > 0) for r in lsh_forest.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == Counter([(0, 0, True, True), (5, 0, False, True), (5, 0, False, True), (3, 0, False, True), (None, None, True, True), (5, 5, True, False), (8, 8, True, True), (8, 8, True, True)])


@pytest.mark.parametrize("hubs", [1, 12])
def test_lsh_forest_star(spark, hubs):
    """Copies that link with their original and seldom with each other; twelve originals have one half in common."""
    rng = random.Random(9)
    shared, rows = [f"s{i}" for i in range(60)] if hubs > 1 else [], []
    for h in range(hubs):
        base = shared + [f"b{h}-{i}" for i in range(104 - len(shared))]
        rows.append((len(rows) + 5000, " ".join(base)))
        for _ in range(1000 // hubs):
            own = list(base)
            for at in (rng.randrange(4, 50), rng.randrange(55, 99), 103):
                own[at] = f"e{rng.random()}"
            rows.append((len(rows), " ".join(own)))
    sets = {i: set(lsh_forest.shingles(t).tolist()) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = union(pairs, sets)
    got = {r["doc_id"]: r["component_id"] for r in lsh_forest.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want, f"{sum(got[i] != want[i] for i in want)} of {len(want)} wrong"


def removed(rows, least=50):
    rows = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in sorted(rows):
        for p in range(len(b) - least + 1):
            first.setdefault(b[p : p + least], i)
    out = {}
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - least + 1):
            if first[b[p : p + least]] < i:
                gone[p : p + least] = b"\1" * least
        runs = sum(1 for j, c in enumerate(gone) if c and (not j or not gone[j - 1]))
        out[i] = len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, c in zip(b, gone, strict=True) if not c)).hexdigest()
    return out


@pytest.mark.parametrize(("sample", "crowd"), [(4096, 50_000), (4096, 1), (1, 50_000)])
def test_suffix_dedup(spark, sample, crowd):
    rows = corpus(seed=8)
    df = spark.createDataFrame(rows, DOCS).withColumns({"n_spans": F.lit("clash"), "id": F.lit(7)})
    got = suffix_dedup.remove_repeats(df, sample=sample, crowd=crowd, kept_text=True).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == removed(rows)
    assert {r["id"] for r in got} == {7}
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_suffix_dedup_common_passages(spark):
    rng = random.Random(2)
    passage = words(rng, 40)
    rows = [(i, f"{words(rng, 6)} {passage} {words(rng, 6)}") for i in range(40)] + [(100 + i, passage) for i in range(4)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == removed(rows)


def test_suffix_dedup_repeated_and_null_keys(spark):
    long = "abcdefghij " * 12
    rows = [(1, long), (1, long), (1, "other " * 20), (2, long), (None, long), (3, None)]
    got = Counter((r["doc_id"], r["n_removed"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect())
    assert got == Counter([(1, 0), (1, 0), (1, 0), (2, len(long)), (None, 0), (3, 0)])


def test_rp_forest(spark):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((40, 16))
    rows = [(i, (centers[i % 40] + 0.12 * rng.standard_normal(16)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [1.0, 2.0]), (2006, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"unit": F.lit(1), "id": F.lit(2)})
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(good)
    links = [(a, b) for a in ids for b in ids if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9]
    degree = Counter(x for p in links for x in p)
    want = union(links, [i for i, _ in rows])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rp_forest.near_duplicates(df, leaf_size=32).collect()}
    assert len(got) == len(rows)
    assert sum(got[i][0] for i in got) >= 0.99 * sum(degree.values())
    assert all(got[i][0] <= degree[i] for i in got)
    assert sum(got[i][1] != want[i] for i in got) == 0
    assert rp_forest.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_rp_forest_repeated_and_null_keys(spark):
    rng = np.random.default_rng(6)
    a, b = rng.standard_normal((2, 8)).tolist()
    rows = [(0, a), (5, [1.01 * x + 0.001 for x in a]), (5, b), (3, [0.99 * x - 0.001 for x in b]), (None, a), (7, a)]
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rp_forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == Counter([(0, 2, 0, True), (7, 2, 0, False), (5, 2, 0, False), (5, 1, 3, False), (3, 1, 3, True), (None, 0, None, True)])


def test_rp_forest_recall_with_production_parameters(spark):
    """Pairs at cosine 0.9005, spread ones and a group of 2,500 near a common centre, among 9,000 vectors; brute force counts the links."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((5000, 64)))
    other = rng.standard_normal((1500, 64))
    other = unit(other - (other * x[:1500]).sum(1, keepdims=True) * x[:1500])
    pairs = 0.9005 * x[:1500] + math.sqrt(1 - 0.9005**2) * other
    center = unit(rng.standard_normal(64))
    group = unit(center + math.sqrt(1 / 0.905 - 1) * unit(rng.standard_normal((2500, 64))))
    every = np.concatenate([x, pairs, group]).astype(np.float32)
    u = every.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in rp_forest.near_duplicates(df).collect()}
    want = link.sum(1)
    assert all(got[i] <= want[i] for i in got)
    assert sum(got[i] for i in range(5000)) >= 0.99 * want[:5000].sum() and sum(got.values()) >= 0.99 * want.sum()
    assert sum(got[i] for i in range(6500, 9000)) >= 0.99 * want[6500:].sum()


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/\r\nx", "<p>" + "é" * 100), (2, None, "<p>" + "é" * 100), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", "y" * 700_000), (7, "u", "y" * 700_000), (0, "u", "<p>" + "é" * 100)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    index = warc.write_bundles(warc.mark_revisits(df, "html", "page_id"), "html", "page_id", "url", f"file://{tmp_path}/b", frame_bytes=1000)
    got = {r["key"]: r for r in warc.read_records(index).collect()}
    first = {1: 0, 2: 0, 7: 6}
    for i, u, t in pages:
        raw = (t or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["refers_to"]) == (len(raw), hashlib.sha256(raw).hexdigest(), first.get(i))
        assert (r["record_type"], bytes(r["payload"]) if r["payload"] is not None else None) == (("revisit", None) if i in first else ("response", raw))
    one = warc.read_records(index.where("key = 6")).collect()
    assert len(one) == 1 and one[0]["payload_bytes"] == 700_000
    bundle = index.first()["bundle"]
    assert sum(n for _, _, n in warc.seek_table(bundle)) == index.where(F.col("bundle") == bundle).agg(F.sum("length")).first()[0]
    empty = df.where("page_id < 0")
    assert warc.read_records(warc.write_bundles(warc.mark_revisits(empty, "html", "page_id"), "html", "page_id", "url", f"file://{tmp_path}/e")).count() == 0


def test_url_filter(spark):
    link = '<a href="https://{}/x">'
    pages = [
        (1, "http://A.Example.NET/en/1?q#f", link.format("hub.com")), (2, "https://b.net", ""), (3, "https://b.net/de", None), (4, "x://sub.example.com/de/1", link.format("friend.com")),
        (5, "http://example.com/fr/", ""), (6, None, None), (7, "no scheme", ""), (8, "http://x.org/fr/1", link.format("friend.com")), (9, "http://bad.net/1", ""), (10, "http://linker.com/a", link.format("bad.net") * 3),
        (11, "http://friend.com/", ""), (12, "http://notexample.net/en/1", ""), (13, "http://u://v/w", ""),
    ]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()}
    rule = {i: (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in got}
    assert rule[1] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert rule[2] == ("b.net", "", None, "allow") or rule[2][:3] == ("b.net", "", None)
    assert rule[3][2:] == ("net/", "block") and rule[4][2:] == ("example.com/de/", "block") and rule[8][2:] == ("org/fr/", "allow") and rule[12][2:] == ("net/", "block")
    assert rule[6] == rule[7] == ("", "", None, "allow")
    assert rule[13][:2] == ("u:", "//v/w")
    assert rule[10][3] == "block" and got[10]["distrust"] > got[11]["distrust"]  # links to a blocked host; linked by an allowed one
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string"), URL_RULES).count() == 0


def test_url_verdicts_of_a_link_graph(spark):
    """A farm that links to blocked hosts, clean hosts with one bad link among many, and random hosts: verdicts against a dense solution."""
    rng = random.Random(21)
    names = [f"h{i}.com" for i in range(20)] + [f"bad{i}.net" for i in range(3)] + ["sub.example.org"]
    links = [(f"farm{i}.com", f"bad{i % 3}.net") for i in range(6)] + [("news.com", f"h{i}.com") for i in range(20)] + [("news.com", "bad0.net"), ("sub.example.org", "news.com")]
    links += [(rng.choice(names), rng.choice(names[:20])) for _ in range(60)]
    pages = [(i, f"http://{a}/fr/{i}", f'<a href="http://{b}/x">') for i, (a, b) in enumerate(links)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()}
    weight = Counter((a, b) for a, b in links if a != b)
    hosts = sorted({x for p in links for x in p})
    at, n = {h: i for i, h in enumerate(hosts)}, len(hosts)
    m = np.zeros((n, n))
    for (a, b), k in weight.items():
        m[at[a], at[b]] = k
    own = {a for a, _ in links}

    def rank(w, seed):
        w = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
        return np.linalg.solve(np.eye(n) - 0.85 * w.T, 0.15 * seed)

    trusted = np.array([float(h in own and h.endswith("org")) for h in hosts])
    blocked = np.array([float(h in own and h.endswith("net")) for h in hosts])
    t, d = rank(m, trusted), rank(m.T, blocked)
    total = m.sum(1)
    clean = np.where(total > 0, (m * (d <= 0)[None, :]).sum(1) / np.maximum(total, 1), 1.0)
    mass = t + d + 0.15 * (1 - trusted - blocked) * clean
    distrust = np.where(mass > 0, d / np.where(mass > 0, mass, 1), 0)
    for i, (a, _) in enumerate(links):
        assert got[i]["distrust"] == pytest.approx(distrust[at[a]], abs=1e-3)
        assert got[i]["verdict"] == ("block" if a.endswith("net") or (not a.endswith("org") and distrust[at[a]] > 0.5) else "allow")
    assert all(got[i]["verdict"] == "block" for i in range(6)) and got[6]["verdict"] == "allow"
    assert sum(r["rule"] is None and r["verdict"] == "block" for r in got.values()) >= 6


def test_page_rank(spark):
    rng = random.Random(1)
    links = sorted({(f"h{rng.randrange(8)}", f"h{rng.randrange(8)}") for _ in range(30)})
    links = [(a, b, rng.randrange(1, 4)) for a, b in links if a != b]
    seeds = {"h0": 0.5, "h3": 1.0}
    score = {h: 0.15 * m for h, m in seeds.items()}
    total = Counter()
    for a, _, n in links:
        total[a] += n
    for _ in range(7):
        new = defaultdict(float, {h: 0.15 * m for h, m in seeds.items()})
        for a, b, n in links:
            new[b] += 0.85 * score.get(a, 0) * n / total[a]
        score = new
    got = url_filter.propagate(spark.createDataFrame(links, "src string, dst string, n long"), spark.createDataFrame(list(seeds.items()), "host string, m double"), "m", 0.85, 7, Scratch(spark, "t")).collect()
    assert {r[0]: round(r[1], 9) for r in got} == {h: round(v, 9) for h, v in score.items() if v}


def test_spotsigs(spark, tmp_path):
    rows = [(i, t) for i, t in corpus(seed=4)] + [(500, "the cat of dogs and the bird is red"), (501, "The cat, of DOGS and the bird is red!")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op5_spotsigs"](spark, str(tmp_path)).collect()}
    texts = {i: t or "" for i, t in rows}
    order = sorted(texts, reverse=True)
    assert len(got) == len(rows)
    for i, nxt in zip(order, [*order[1:], order[0]], strict=True):
        t, half = texts[i], len(texts[i]) // 2
        edited = t[: len(t) - half] + texts[nxt][:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, e, b = (set(x.split()) for x in (r["fingerprint"], r["edited_fingerprint"], got[nxt]["fingerprint"]))
        assert r["near_edited"] == pytest.approx(len(a & e) / len(a | e)) and r["near_next"] == pytest.approx(len(a & b) / len(a | b))
    by = defaultdict(set)
    for i in order:
        by[texts[i]].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
    assert got[500]["fingerprint"] == got[501]["fingerprint"]
    sigs = spotsigs.add_signatures(spark.createDataFrame([(1, "the cat of dogs and the bird")], DOCS), "text", "s").first()["s"]
    assert len(sigs) == 3


def test_spotsigs_near_duplicates(spark):
    rng = random.Random(9)
    rows = [(i, sorted(rng.sample(range(200), rng.choice([3, 10, 30])))) for i in range(60)]
    rows += [(100 + i, sorted({*rows[i][1][1:], 500 + i})) for i in range(40)] + [(200, rows[0][1]), (201, None), (202, [])]
    sets = {i: set(s or []) for i, s in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])]
    want = union(pairs, sets)
    got = spotsigs.near_duplicates(spark.createDataFrame(rows, "k long, s array<long>"), "k", "s").collect()
    assert {r["k"]: r["component_id"] for r in got} == want


def test_spotsigs_classes_of_the_query(spark, tmp_path):
    """Classes against all pairs of fingerprints, by DataFrame operations alone: groups of copies and near copies, equal and null ids."""
    rng = random.Random(12)
    base = ["the " + " the ".join(f"{rng.choice('abcdefgh')}{rng.randrange(40)} w{rng.randrange(9)}" for _ in range(rng.choice([4, 30, 60]))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, base[i % 5] + f" the new{i} x") for i in range(60)] + [(300, base[0])] * 3
    rows += [(7, f"the u{i} of v{i}") for i in range(30)] + [(None, base[1]), (None, "the lone of none"), (None, None), (400, None), (401, "")]
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["op5_spotsigs"](spark, str(tmp_path))
    got = df.collect()
    assert len(got) == len(rows)
    plan = df._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "Python" not in plan
    sets = {r["fingerprint"]: frozenset(r["fingerprint"].split()) for r in got}
    names = {f: n for n, f in enumerate(sets)}
    pairs = [(names[f], names[g]) for f, a in sets.items() for g, b in sets.items() if names[f] < names[g] and len(a & b) >= 0.75 * len(a | b)]
    group = union(pairs, names.values())
    low = {}
    for r in got:
        c = group[names[r["fingerprint"]]]
        low[c] = min((x for x in (low.get(c), r["doc_id"]) if x is not None), default=None)
    assert len(pairs) > 50
    for r in got:
        assert r["component_id"] == low[group[names[r["fingerprint"]]]] and r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.mark.parametrize(("hot", "rare", "share"), [(1, 0, 1), (100, 2, 3), (50_000, 50, 1024)])
def test_spotsigs_classes_under_any_parameters(spark, hot, rare, share):
    rng = random.Random(hot)
    rows = [(i, sorted(rng.sample(range(60), rng.choice([1, 4, 12, 20])))) for i in range(150)]
    rows += [(200 + i, sorted({*rows[i % 7][1], 1000 + i})) for i in range(80)]
    sets = {i: set(s) for i, s in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])]
    df = spark.createDataFrame(rows, "k long, s array<long>")
    classes = {r["digest"]: r["component_id"] for r in spotsigs.near_classes(df, "k", "s", hot=hot, rare=rare, share=share).collect()}
    digests = {r["k"]: r["d"] for r in df.select("k", spotsigs.set_digest(F.col("s")).alias("d")).collect()}
    assert {k: classes.get(d, k) for k, d in digests.items()} == union(pairs, sets)


def test_spotsigs_short_hashes_refuse_no_linked_pair(spark):
    """Pairs at and around the threshold, also of sets so large that hashes of 16 bits collide."""
    rng = random.Random(4)
    rows = []
    for n, change in [(4, 0), (40, 5), (400, 57), (400, 90), (400, 300), (20_000, 2857), (20_000, 2858)]:
        a = [rng.getrandbits(63) for _ in range(n)]
        rows.append((a, a[change:] + [rng.getrandbits(63) for _ in range(change)]))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    may = spotsigs.may_reach(F.size("a"), F.size("b"), spotsigs.short_hashes(F.col("a")), spotsigs.short_hashes(F.col("b")), 0.75)
    got = df.select((spotsigs.likeness(F.col("a"), F.col("b")) >= 0.75).alias("linked"), may.alias("may"), F.size("a").alias("n")).collect()
    assert all(r["may"] for r in got if r["linked"]) and sum(r["linked"] for r in got) == 4
    assert [r["may"] for r in got if r["n"] == 400] == [True, False, False]


def test_spotsigs_next_splits_a_hot_key(spark):
    """A third of the rows under one key, and null keys, are dealt over several ranges in the order of key and tie."""
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"t{i}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, t string, b int").repartition(7)
    out = spotsigs.with_next(df, "k", ["t"], F.xxhash64("t"), rows_per_bucket=20)
    tie = {r["t"]: r["h"] for r in df.select("t", F.xxhash64("t").alias("h")).collect()}
    order = [t for _, t, _ in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]]))]
    assert {r["t"]: r["next_t"] for r in out.collect()} == dict(zip(order, [*order[1:], order[0]], strict=True))
    assert out.columns == ["k", "t", "b", "next_t"]


def test_spotsigs_next_with_columns_beside(spark):
    """Columns for some keys and ties arrive as by a left join, with a hot key, null keys and repeated rows; next rows stay the same."""
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"t{i}") for i in range(600)] + [(7, "t0")] * 2
    df = spark.createDataFrame(rows, "k long, t string").repartition(7)
    some = df.where("substring(t, -1) < '5'").select("k", F.xxhash64("t").alias("tie"), F.substring("t", 2, 9).alias("more"))
    out = spotsigs.with_next(df, "k", ["t"], F.xxhash64("t"), rows_per_bucket=20, beside=some)
    plain = spotsigs.with_next(df, "k", ["t"], F.xxhash64("t"), rows_per_bucket=20)
    assert out.columns == ["k", "t", "more", "next_t"]
    got = [tuple(r) for r in out.collect()]
    want = [(r["k"], r["t"], r["t"][1:] if r["t"][-1] < "5" else None, r["next_t"]) for r in plain.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == len(rows)


def test_spotsigs_rows_with_fingerprints_are_not_shuffled(spark, tmp_path):
    """Whatever the number of classes, they reach the rows in the dealing that next documents need."""
    spark.createDataFrame(corpus(), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = QUERIES["op5_spotsigs"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert 0 < plan.index("Window") < plan.index("Exchange")


@pytest.mark.parametrize("n", [240, 260, 1030])
def test_spotsigs_next_in_ranges_of_any_number(spark, n):
    """The last group of bounds may be shorter than the others; keys below all bounds still belong to the last range."""
    df = spark.createDataFrame([(i, f"t{i}") for i in range(n)], "k long, t string")
    out = spotsigs.with_next(df, "k", ["t"], F.xxhash64("t"), rows_per_bucket=20)
    assert {r["k"]: r["next_t"] for r in out.collect()} == {i: f"t{(i - 1) % n}" for i in range(n)}


def test_mixing(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        kind = rng.choice(["good", "good", "low", "toxic"])
        rows.append((i, words(rng, 60) + {"good": " nice", "low": " !!!! ####" * 20, "toxic": " scum idiot"}[kind]))
        if i % 2:
            labels.append((i, kind))
    rows += [(900, None), (901, ""), (902, "nice"), (902, "nice")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("posterior", F.lit("clash"))
    want = {"good": 0.8, "low": 0.15, "toxic": 0.05}
    out = mixing.mix(docs, spark.createDataFrame(labels, "doc_id long, domain string"), want)
    got = out.collect()
    assert len(got) == len(rows) and all(r["rate"] >= 0 and abs(sum(r["posterior"]) - 1) < 1e-9 for r in got)
    total = sum(r["n_tokens"] for r in got)
    for k, share in enumerate(want.values()):
        assert sum(r["n_tokens"] * r["posterior"][k] * r["rate"] for r in got) / total == pytest.approx(share, abs=1e-3)
    known = {i: k for i, k in labels}
    assert sum(r["domain"] == known[r["doc_id"]] for r in got if r["doc_id"] in known) > 0.95 * len(known)
    none = mixing.mix(docs, spark.createDataFrame([], "doc_id long, domain string"), want).collect()
    assert {r["rate"] for r in none} == {1.0}
    assert mixing.mix(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, "doc_id long, domain string"), want).count() == 0


def test_mixing_against_brute_force(spark):
    """Posteriors by a plain naive Bayes over the same rule of choosing words, and rates by projected gradient to the end."""
    rng = random.Random(16)
    rows, labels = [], []
    for i in range(300):
        kind = rng.choice(["aa", "bb", "bb", "cc"])
        rows.append((i, words(rng, rng.choice([20, 60]), 60) + "".join(f" {kind}{rng.randrange(3)}" for _ in range(rng.randrange(4)))))
        if i % 3:
            labels.append((i, kind))
    want = {"aa": 0.5, "bb": 0.3, "cc": 0.1, "unlabelled": 0.1}
    got = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, domain string"), want).collect()}
    marks = {r["doc_id"]: (set(r["tokens"]), r["n_tokens"]) for r in mixing.add_tokens(spark.createDataFrame(rows, DOCS), "text").collect()}
    known, domains = dict(labels), ["aa", "bb", "cc"]
    n_of, n = Counter(known.values()), len(known)
    held = {d: Counter(w for i, k in known.items() if k == d for w in marks[i][0]) for d in domains}
    every = {w: c for w, c in sum(held.values(), Counter()).items() if c >= 5}
    chosen = set()
    for d in domains:
        scored = []
        for w, c in every.items():
            a, na = held[d][w], n_of[d]
            b, nb, p = c - a, n - na, c / n
            cells = ((a, na * p), (b, nb * p), (na - a, na * (1 - p)), (nb - b, nb * (1 - p)))
            g = 2 * sum(o * math.log(o / e) for o, e in cells if o > 0)
            if g > 25 and a * nb > 3 * b * na:
                scored.append((-g, w))
        chosen |= {w for _, w in sorted(scored)[:100]}
    assert 3 <= len(chosen) <= 40
    share = {d: {w: (held[d][w] + (every[w] + 1) / (n + 2)) / (n_of[d] + 1) for w in chosen} for d in domains}
    for i, (own, n_tokens) in marks.items():
        logs = [math.log((n_of[d] + 1) / (n + 3)) + sum(math.log(share[d][w] if w in own else 1 - share[d][w]) for w in chosen) for d in domains]
        weights = [math.exp(x - max(logs)) for x in logs]
        assert got[i]["posterior"] == pytest.approx([x / sum(weights) for x in weights], abs=1e-9) and got[i]["n_tokens"] == n_tokens
    p = np.array([got[i]["posterior"] for i in got]) * np.array([got[i]["n_tokens"] for i in got])[:, None]
    aim = np.array([want[d] for d in domains]) / 0.9 * sum(r["n_tokens"] for r in got.values())
    rates = np.array([got[i]["rate"] for i in got])
    best, step = np.ones(len(p)), 1 / np.linalg.norm(p, 2) ** 2
    for _ in range(20_000):
        best = np.maximum(best - step * p @ (p.T @ best - aim), 0)
    assert rates.min() >= 0 and np.abs(p.T @ rates - aim).max() <= np.abs(p.T @ best - aim).max() + 0.01 * aim.sum()
    assert {round(r["residual"], 2) for r in got.values()} == {0.1}  # the unlabelled domain's share can't be met


def test_whole_tables_against_the_tokenizers_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    sf_dir = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pieces = token_counts.load_pieces(tokenizer_path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op8_unigram_counts"](spark, sf_dir).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    bpe_file = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    bpe_file.no_truncation()
    bpe_file.no_padding()
    for r in QUERIES["op7_bpe_codec"](spark, sf_dir).collect():
        ids = bpe_file.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        back = bpe_file.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_language(spark):
    rng = random.Random(7)
    parts = {"aa": "the ing and er on", "bb": "der und ich ein sch", "cc": "que los ción as el"}
    rows = [(i, " ".join("".join(rng.choice(parts[k].split()) for _ in range(3)) for _ in range(30)), k) for i, k in enumerate(rng.choice(list(parts)) for _ in range(300))]
    model = langid.fit(spark.createDataFrame(rows[:200], f"{DOCS}, lang string"))
    rest = [*rows[200:], (900, None, None), (901, "", "aa"), (902, "123 !!", "aa"), (903, "THE ING" * 4000, "aa")]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(rest, f"{DOCS}, lang string").withColumn("score", F.lit("clash")), model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert got[903]["lang_pred"] == "aa" and sum(got[i]["lang_pred"] == k for i, _, k in rows[200:]) >= 95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = langid.predict(spark.createDataFrame([(1, "½ ²"), (2, "①"), (3, "Ⅷ 12"), (4, "ª")], DOCS), model).collect()
    assert [r["lang_pred"] == "und" for r in odd] == [True, True, True, False]
    assert {r["lang_pred"] for r in langid.predict(spark.createDataFrame([(1, "the ing"), (1, "the ing")], DOCS), model).collect()} == {"aa"}
    many = langid.fit(spark.createDataFrame([(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} ab", f"l{i}") for i in range(90)], f"{DOCS}, lang string"))
    assert len(many.langs) == 90
    assert langid.fit(spark.createDataFrame([(1, "a", None)], f"{DOCS}, lang string")) is None
    assert langid.predict(spark.createDataFrame([(1, "abc")], DOCS), None).first()["lang_pred"] == "und"


def test_columns(spark):
    rows = [(1, "Hello wörld."), (2, None), (3, ""), (3, ""), (4, "x " * 5000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("n_tokens", F.lit("clash"))
    out = bpe.encode_column(df, tokenizer_path("word_bpe_49k.json")).collect()
    assert [r["n_tokens"] for r in out if r["doc_id"] in (2, 3)] == [0, 0, 0] and len(out) == 5
    assert all(len(r["token_ids"]) == 4 * r["n_tokens"] and hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"] for r in out)
    counts = token_counts.count_column(df, tokenizer_path("piece_bpe_32k.model")).collect()
    assert {r["doc_id"]: r["n_words"] for r in counts} == {1: 2, 2: 0, 3: 0, 4: 5000}
    empty = spark.createDataFrame([], DOCS)
    assert bpe.encode_column(empty, tokenizer_path("word_bpe_49k.json")).count() == token_counts.count_column(empty, tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(3)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in corpus(seed=12)]
    rows += [(800, "1234 5678", "en", "s", 9), (801, words(rng, 40), None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in P.identify_language(spark, docs, str(tmp_path)).collect()}
    assert set(kept) == {r[0] for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])}
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "mixing", "bpe_encoding"]
    out = P.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in out]
    assert out and len(ids) == len(set(ids)) and set(ids) <= set(kept) and all(r["n_tokens"] > 0 for r in out)


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    rng = random.Random(14)
    rows, labels = [], []
    for i, t in [*corpus(seed=15), *[(1000 + i, f"{words(rng, 30, 3000)} {rng.choice(['nice kind', '!!!! ####', 'scum idiot'])}") for i in range(200)]]:
        rows.append((i, t, "en", "s", len(t or "")))
        if i >= 1000 and i % 2:
            kind = "good" if "nice" in t else "low" if "!!" in t else "toxic"
            labels.append((i, int(kind == "good"), int(kind == "toxic")))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, schema)
    texts = {r[0]: r[1] for r in rows}
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    group = union(pairs, sets)
    near = {r["doc_id"]: r["text"] for r in P.drop_near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert near == {i: texts[i] for i in texts if group[i] == i}
    cut = {r["doc_id"]: (r["text"], r["n_chars"]) for r in P.remove_repeated_passages(spark, docs, str(tmp_path)).collect()}
    lost = removed([(i, t) for i, t in texts.items()])
    for i, t in texts.items():
        if i in cut:
            assert hashlib.sha256((cut[i][0] or "").encode()).hexdigest() == lost[i][3] and cut[i][1] in (len(cut[i][0]), None)
        else:
            assert lost[i][1] > 0
    rates = {r["doc_id"]: r for r in P.mixing.mix(docs.select("doc_id", "text"), P.label_domains(spark, str(tmp_path)), P.DOMAIN_TARGETS).withColumn("chance", F.pmod(F.xxhash64("doc_id", F.lit(0)), F.lit(1 << 30)) / float(1 << 30)).collect()}
    good = [r["rate"] for r in rates.values() if r["domain"] == "good"]
    clean = sum(good) / len(good)
    mixed = {r["doc_id"] for r in P.mix_to_targets(spark, docs, str(tmp_path)).collect()}
    assert mixed == {i for i, r in rates.items() if r["domain"] == "good" or r["rate"] / clean > r["chance"]} and len(mixed) < len(texts)
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for r in P.encode(spark, docs, str(tmp_path)).collect():
        assert bytes(r["token_ids"]) == np.array(library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_pipeline_null_and_repeated_keys(spark):
    """Rows without a doc_id stay; different texts under one doc_id are decided each; equal rows and near texts go."""
    import corpus_pipeline as P

    rng = random.Random(12)
    a, b, c, d = (words(rng, 60, 5000) for _ in range(4))
    rows = [(None, a), (None, a), (None, b), (1, a), (1, b), (1, c), (1, c), (2, f"{c} end"), (3, d), (3, None), (4, d)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in P.drop_near_duplicates(spark, docs, "").collect())
    assert got == Counter([(None, a), (None, a), (None, b), (1, a), (1, b), (1, c), (3, d), (3, None)])
    unique = docs.where("doc_id is null or doc_id > 3")
    assert Counter((r["doc_id"], r["text"]) for r in P.drop_near_duplicates(spark, unique, "").collect()) == Counter([(None, a), (None, a), (None, b), (4, d)])


def test_pipeline_mixing_null_keys(spark, monkeypatch):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(None, "x", "en", "web", 1), (1, "y", "en", "web", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(P, "label_domains", lambda *_: None)
    monkeypatch.setattr(P.mixing, "mix", lambda rows, *_: rows.select("doc_id", F.lit("good").alias("domain"), F.lit(1.0).alias("rate")))
    assert {r["doc_id"] for r in P.mix_to_targets(spark, docs, "").collect()} == {None, 1}
