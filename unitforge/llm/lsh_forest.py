"""MinHash near-deduplication with an LSH forest.

Each document's five-word shingles give a MinHash signature. The forest is several orders of the signatures, each beginning at
another component; documents sorted by one are compared with the next ones that share a prefix with them, so that the prefix needed is
short where texts are few and long where they are many. Candidates are settled on the full shingle sets, in rounds that skip
what earlier links have already joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

WIDTH = 5
TREES, STEP, DEPTH = 16, 4, 8
#: Least number of components that neighbours share from an order's start.
LEAST = 2
#: Lists of documents with candidates up to so many ids (8 bytes each) are broadcast, so that texts stay where they are; longer ones
#: are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Documents on either side of a block in which a long run is compared.
BLOCK_ROWS = 256
COMPONENTS = TREES * STEP
_random = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15
_PLACE = _random.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _random.integers(0, 1 << 63, COMPONENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 1 << 63, COMPONENTS, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLOCK = 1 << 12
_POWERS = np.array([pow(_BASE, i, 1 << 64) for i in range(_BLOCK)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 bytes: a polynomial over the word's bytes, read backwards, then mixed."""
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    length = ends - starts
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw)))) if starts[0] == 0 else None
    if place is None:
        place = np.zeros(len(raw), dtype=np.int64)
        place[starts[0] :] = np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    long = int(length.max())
    powers = _POWERS if long <= _BLOCK else np.concatenate([_POWERS, *[_POWERS * np.uint64(pow(_BASE, _BLOCK * k, 1 << 64)) for k in range(1, -(-long // _BLOCK))]])
    value = _BYTE[raw] * powers[np.minimum(place, len(powers) - 1)]
    value[space] = 0
    return _mixed(np.add.reduceat(value, starts) + length.astype(np.uint64))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's five-word shingles; of all its words where there are fewer."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    h = _word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8))
    n = len(h)
    if n == 0:
        return h
    wide = min(n, WIDTH)
    out = np.full(n - wide + 1, np.uint64(wide))
    for j in range(wide):
        out += h[j : n - wide + 1 + j] * _PLACE[j]
    return np.unique(_mixed(out))


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash of a non-empty set: 32 bits of the smallest value under each function, big-endian."""
    low = np.full(COMPONENTS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(s), 1024):
        low = np.minimum(low, (s[None, at : at + 1024] * _MUL[:, None] + _ADD[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(">u4")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for at in range(0, big.num_rows, 512):
            batch = big.slice(at, 512)
            sizes, digests, signs = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())], names=["id", "n_shingles", "same", "sign"])


def _orders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each document and order: the order's number and the key that it is sorted by."""
    for pdf in batches:
        signs = np.frombuffer(b"".join(pdf["sign"]), dtype=">u4").reshape(len(pdf), COMPONENTS)
        for t in range(TREES):
            own = np.ascontiguousarray(signs[:, (np.arange(DEPTH) + t * STEP) % COMPONENTS])
            yield pd.DataFrame({"tree": np.int32(t), "key": [row.tobytes() for row in own], "id": pdf["id"], "n": pdf["n_shingles"]})


def _neighbours(reach: int, ratio: float):
    """Candidates among the sorted rows of a partition; its first and last rows also go out, to be met across partitions."""

    def pairs(tree: np.ndarray, key: np.ndarray, ids: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        a, b = [], []
        for k in range(1, min(reach, len(ids) - 1) + 1):
            same = (tree[k:] == tree[:-k]) & (key[k:, :LEAST] == key[:-k, :LEAST]).all(axis=1)
            small, large = np.minimum(n[k:], n[:-k]), np.maximum(n[k:], n[:-k])
            at = np.flatnonzero(same & (small >= ratio * large))
            a.append(np.minimum(ids[k:][at], ids[:-k][at]))
            b.append(np.maximum(ids[k:][at], ids[:-k][at]))
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)} if a else {"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, tail = None, None
        for pdf in batches:
            rows = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
            key = np.frombuffer(b"".join(rows["key"]), dtype=">u4").reshape(len(rows), DEPTH)
            out = pairs(rows["tree"].to_numpy(), key, rows["id"].to_numpy(), rows["n"].to_numpy())
            yield out.drop_duplicates().assign(tree=None, key=None, id=None, n=None)
            if head is None or len(head) < reach:
                head = rows.iloc[:reach]
            tail = rows.iloc[-reach:]
        if tail is not None:
            edge = pd.concat([head, tail]).drop_duplicates(["tree", "id"])
            yield edge.assign(a=None, b=None)[["a", "b", "tree", "key", "id", "n"]]

    return run


PAIRS = "a long, b long, tree int, key binary, id long, n long"


def candidates(sets: DataFrame, scratch: Scratch, partitions: int, reach: int, threshold: float) -> DataFrame:
    """(a, b, votes): documents within reach of each other in some order, and in how many orders."""
    rows = sets.select("id", "n_shingles", "sign").mapInPandas(_orders, "tree int, key binary, id long, n long")
    found = scratch.keep(rows.repartitionByRange(partitions, "tree", "key", "id").sortWithinPartitions("tree", "key", "id").mapInPandas(_neighbours(reach, threshold), PAIRS), "neighbours")
    edges = found.where("a is null").select("tree", "key", "id", "n")  # a few rows a partition; neighbours across borders are met here
    met = edges.repartition(1).sortWithinPartitions("tree", "key", "id").mapInPandas(_neighbours(reach, threshold), PAIRS)
    both = found.where("a is not null").select("a", "b").union(met.where("a is not null").select("a", "b"))
    out = scratch.keep(both.groupBy("a", "b").agg(F.count("*").alias("votes")), "candidates")
    scratch.drop(found)
    return out


def _links(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for x, y in zip(pdf["sa"], pdf["sb"], strict=True):
                s, t = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(both * 1_000_000 >= round(threshold * 1_000_000) * (len(s) + len(t) - both))
            yield pdf.loc[np.array(ok, dtype=bool), ["a", "b"]]

    return run


def _full_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets = [shingles(t).tobytes() for t in pdf["text"]]
        yield pd.DataFrame({"id": pdf["id"], "same": [hashlib.blake2b(s, digest_size=16).digest() for s in sets], "s": sets})


def _runs(sets: DataFrame, member: DataFrame, reach: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Runs of documents that share LEAST components from an order's start, if neighbours don't cover them and they are in several components.

    Gives (tree, run, size, minors, main), minors being the documents outside the run's largest component `main`, and all rows
    (tree, run, id, n, c, sign).
    """
    rows = sets.join(member.withColumnRenamed("node", "id"), "id", "left").select("id", F.col("n_shingles").alias("n"), F.coalesce("component", "id").alias("c"), "sign", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.withColumn("run", F.expr(f"substring(sign, {4 * STEP} * tree + 1, {4 * LEAST})"))
    parts = rows.groupBy("tree", "run", "c").agg(F.count("*").alias("k"))
    runs = parts.groupBy("tree", "run").agg(F.sum("k").alias("size"), F.max(F.struct("k", "c")).alias("top")).where(F.col("size") > F.greatest("top.k", F.lit(reach + 1)))
    return scratch.keep(runs.select("tree", "run", "size", (F.col("size") - F.col("top.k")).alias("minors"), F.col("top.c").alias("main")), "runs"), rows


def _blocks(threshold: float):
    """Links between a block of a run's minor documents (side 0) and a block of all its documents (side 1), without those inside a component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, ids, n, minor = int(pdf["tree"].iloc[0]), pdf["id"].to_numpy(), pdf["n"].to_numpy(), (pdf["c"] != pdf["main"]).to_numpy()
        label = np.unique(pdf["c"].to_numpy(), return_inverse=True)[1]
        own, others = (np.flatnonzero(pdf["side"].to_numpy() == k) for k in (0, 1))
        if not len(own) or not len(others):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        sign = np.frombuffer(b"".join(pdf["sign"]), dtype=">u4").astype(np.uint32).reshape(len(pdf), TREES, STEP)[:, :, :LEAST]
        code = np.unique(np.frombuffer(b"".join(pdf["s"]), dtype=np.uint64), return_inverse=True)[1]
        at = np.concatenate(([0], np.cumsum(n)))
        theirs = np.concatenate([code[at[x] : at[x + 1]] for x in others])
        starts = np.concatenate(([0], np.cumsum(n[others])[:-1]))
        mark, a, b = np.zeros(int(code.max()) + 1, dtype=bool), [], []
        for m in own.tolist():
            small, large = np.minimum(n[others], n[m]), np.maximum(n[others], n[m])
            hope = (label[others] != label[m]) & (small >= threshold * large) & (~minor[others] | (ids[others] > ids[m]))
            if not hope.any():
                continue
            hope[hope] = (sign[others[hope]] == sign[m]).all(axis=2).argmax(axis=1) == tree  # a pair counts in the first order that it shares
            if not hope.any():
                continue
            mark[code[at[m] : at[m + 1]]] = True
            both = np.add.reduceat(mark[theirs], starts, dtype=np.int64)
            mark[code[at[m] : at[m + 1]]] = False
            for x in others[hope & (both * 1_000_000 >= round(threshold * 1_000_000) * (n[others] + n[m] - both))].tolist():
                if label[x] != label[m]:
                    a.append(min(ids[m], ids[x]))
                    b.append(max(ids[m], ids[x]))
                    label[label == label[x]] = label[m]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def _block_links(runs: DataFrame, rows: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that join all components of the runs: their minor documents are compared with every other one, block by block."""
    last = lambda c: F.ceil(F.col(c) / BLOCK_ROWS).cast("int") - 1
    of = lambda c, seed: F.pmod(F.xxhash64("id", F.lit(seed)), last(c) + 1).cast("int")
    rows = rows.join(runs, ["tree", "run"])
    columns = ["tree", "run", "id", "n", "c", "main", "sign"]
    every = rows.select(*columns, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), last("minors"))).alias("i"), of("size", 1).alias("j"))
    minor = rows.where("c <> main").select(*columns, F.lit(0).alias("side"), of("minors", 0).alias("i"), F.explode(F.sequence(F.lit(0), last("size"))).alias("j"))
    return every.union(minor).join(full, "id").groupBy("tree", "run", "i", "j").applyInPandas(_blocks(threshold), "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.75, reach: int = 3, first_picks: int = 3) -> DataFrame:
    """(key, n_shingles, component_id, kept): documents joined by links of at least `threshold` Jaccard similarity.

    A null text, an empty one and one without words has no shingle and links with nothing. Rows with equal sets collapse to the one
    with the smallest key before the search, whatever their number. Rows that repeat a key are one document: all their texts, and what any of
    them links with or equals, belong to the key's class, in whatever order the rows come; those without words stay alone. Rows with a null key take part in nothing: their component is null and they are kept. Very
    long texts are read whole. An empty table gives an empty result; further columns are ignored.

    The first round settles each document's first_picks candidates with most votes, the second all other pairs that the first left in
    different components; a pair within a component can join nothing. Neighbours leave out pairs of runs longer than reach + 1: there
    each document meets the run's best linked one, and then all that are outside the run's largest component meet every other one.
    """
    scratch = Scratch(df.sparkSession, "forest")
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = scratch.keep(docs.mapInArrow(_signatures, "id long, n_shingles long, same binary, sign binary"), "signatures")
    own = rows.where("same is not null and id is not null")
    sets = scratch.keep(own.groupBy("same").agg(F.min(F.struct("id", "n_shingles", "sign")).alias("x")).select("same", "x.*"), "sets")
    holds = own.select(F.col("id").alias("key"), "same").distinct()
    several = not holds.groupBy("key").count().where("count > 1").isEmpty()
    if several:  # different sets under one key: nodes are numbered in the order of keys, and all sets of a key are joined
        order = sets.repartitionByRange("id", "same").sortWithinPartitions("id", "same")
        named = scratch.keep(order.select(F.col("id").alias("key"), "same", F.monotonically_increasing_id().alias("id"), "n_shingles", "sign"), "numbered")
        held = scratch.keep(holds.join(named.select("same", "id"), "same").select("key", "id"), "held")
        least = held.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("k")).where("k > 1")
        joins = held.join(least, "key").where("id > a").select("a", F.col("id").alias("b")).distinct()
    else:
        named = sets.select(F.col("id").alias("key"), "same", "id", "n_shingles", "sign")
    sets = named.drop("key")
    found = candidates(sets, scratch, partitions, reach, threshold)
    docs = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))  # a key's rows without a word stand for none of its sets

    def read_sets(ids: DataFrame, tag: str) -> DataFrame:
        ends = scratch.keep(ids.distinct(), "ends")
        if ends.count() <= BROADCAST_ROWS:
            ends = F.broadcast(ends)
        if not several:
            texts = docs.join(ends, "id", "left_semi").dropDuplicates(["id"])
            return scratch.keep(texts.mapInPandas(_full_sets, "id long, same binary, s binary").drop("same"), tag)
        wanted = named.join(ends, "id", "left_semi").select("key", "same", "id")
        texts = docs.join(wanted.select(F.col("key").alias("id")).distinct(), "id", "left_semi").mapInPandas(_full_sets, "id long, same binary, s binary")
        return scratch.keep(texts.withColumnRenamed("id", "key").join(wanted, ["key", "same"]).select("id", "s").dropDuplicates(["id"]), tag)

    full = read_sets(found.select(F.explode(F.array("a", "b")).alias("id")), "full")

    def settle(pairs: DataFrame, full: DataFrame, tag: str) -> DataFrame:
        both = pairs.join(full.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(full.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        return scratch.keep(both.select("a", "b", "sa", "sb").mapInPandas(_links(threshold), "a long, b long"), tag)

    sided = found.select("a", "b", "votes", F.explode(F.array("a", "b")).alias("own"))
    best = sided.groupBy("own").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "a", "b"))), 1, first_picks).alias("p"))
    first = settle(best.select(F.explode("p").alias("p")).select("p.a", "p.b").distinct(), full, "links")
    if several:
        first = first.union(joins)
    joined = scratch.keep(connected_components(first, scratch), "first")
    side = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    rest = found.join(first, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    links = first.union(settle(rest, full, "more"))
    for done in (full, found, joined):
        scratch.drop(done)
    member = connected_components(links, scratch)
    runs, members = _runs(sets, member, reach, scratch)
    if runs.count():
        full = read_sets(members.join(runs, ["tree", "run"]).select("id"), "run_sets")
        degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
        inside = members.join(runs, ["tree", "run"]).select("tree", "run", "id", "n", "c")
        hubs = inside.join(degree, "id", "left").groupBy("tree", "run").agg(F.max(F.struct(F.coalesce("links", F.lit(0)).alias("links"), (-F.col("id")).alias("h"), "n", "c")).alias("hub"))
        met = inside.join(hubs, ["tree", "run"]).where((F.col("c") != F.col("hub.c")) & (F.least("n", "hub.n") >= threshold * F.greatest("n", "hub.n")))
        links = links.union(settle(met.select(F.least(F.col("id"), -F.col("hub.h")).alias("a"), F.greatest(F.col("id"), -F.col("hub.h")).alias("b")).distinct(), full, "hubs"))
        member = connected_components(links, scratch)
        runs, members = _runs(sets, member, reach, scratch)
        if runs.count():
            links = links.union(scratch.keep(_block_links(runs, members, full, threshold), "blocks"))
            member = connected_components(links, scratch)
        scratch.drop(full)
    nodes = named.select("same", "key", F.col("id").alias("node")).join(member, "node", "left").select("same", "key", F.coalesce("component", "node").alias("component"))
    if several:
        nodes = nodes.drop("key").join(named.select(F.col("id").alias("component"), "key"), "component").select("same", F.col("key").alias("component"))
    out = rows.join(nodes, "same", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
