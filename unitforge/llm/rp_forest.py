"""Embedding near-deduplication with a forest of random-projection trees.

A tree splits the vectors again and again on random projections; a band around each threshold goes to both sides (spill), so that close
vectors seldom part. Within the leaves of many trees, vectors are first compared as bytes with a proven error bound, which leaves the
few that can have a link at all; these are compared again in double precision, and a pair counts in the first leaf that both share,
so nothing is emitted pair by pair. The trees are worked off a few at a time, which bounds the disk they need.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

#: Vectors that the trees' upper part is grown on, and the fewest of a sample in a leaf: both bound the forest sent to all tasks.
SAMPLE, LEAF_SAMPLE = 16_384, 64
#: Half width of the band around a threshold, in lengths of a link's largest chord.
SPILL = 1 / 3
#: Random directions that a split chooses from, and the shares of the vectors under a threshold that it tries.
WAYS, SHARES = 4, (0.3, 0.4, 0.5, 0.6, 0.7)
#: A node is not split where even the best split sends more than this to both sides (log of the growth for each nat of the split): it
#: is so dense that splitting would part its links.
DENSE = 0.42
#: A linked pair stays together at a split at least so often, a split leaves about this share on a side, and all trees
#: together may miss it so often: this gives the number of trees.
STAYS, SIDE, MISS = 0.92, 0.56, 3e-4
TREES_AT_ONCE = 2
#: Vectors on either side of a block of a dense leaf, and of an oversize leaf that one task moves on.
BLOCK, SLICE = 2048, 32_768
#: Flagged rows that are compared in one go, and bytes of repeated vectors that are broadcast.
AT_ONCE, BROADCAST_BYTES = 2_000_000, 32 << 20

Arrow = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


class Tree:
    """Split nodes in arrays; children under zero are leaves (-1 - leaf number)."""

    def __init__(self, x: np.ndarray, smallest: int, band: float, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        ways, self.low, self.high, self.children, self.leaves = [], [], [], [], 0
        self.root, todo = 0, [(x, None, 0)]
        while todo:
            own, parent, side = todo.pop()
            split = _split(own, band, rng) if len(own) >= 2 * smallest else None
            if split is None:
                self.leaves += 1
                here = -self.leaves
            else:
                way, low, high = split
                here, at = len(ways), own @ way
                ways.append(way)
                self.low.append(low)
                self.high.append(high)
                self.children.append([0, 0])
                todo += [(own[at <= high], here, 0), (own[at >= low], here, 1)]
            if parent is None:
                self.root = here
            else:
                self.children[parent][side] = here
        self.ways = np.array(ways, dtype=np.float32).reshape(len(ways), x.shape[1])
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.children = np.array(self.children, dtype=np.int64).reshape(len(ways), 2)

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each row falls into."""
        rows, nodes, out = np.arange(len(x)), np.full(len(x), self.root), []
        at = x.astype(np.float32) @ self.ways.T
        while len(rows):
            done = nodes < 0
            out.append((rows[done], -1 - nodes[done]))
            rows, nodes = rows[~done], nodes[~done]
            p = at[rows, nodes]
            left, right = p <= self.high[nodes], p >= self.low[nodes]
            rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([self.children[nodes[left], 0], self.children[nodes[right], 1]])
        return np.concatenate([r for r, _ in out]), np.concatenate([n for _, n in out])


def _split(x: np.ndarray, band: float, rng: np.random.Generator) -> tuple[np.ndarray, float, float] | None:
    """The random direction and threshold with the least spill for what the split tells; None where all are too dense."""
    n, ways = len(x), rng.standard_normal((x.shape[1], WAYS))
    at, best, found = np.sort(x @ ways, axis=0), DENSE, None
    for k in range(WAYS):
        for share in SHARES:
            cut = at[int(share * n), k]
            left, right = np.searchsorted(at[:, k], cut + band, side="right"), n - np.searchsorted(at[:, k], cut - band, side="left")
            below = np.searchsorted(at[:, k], cut) / n
            if left == n or right == n or not 0 < below < 1:
                continue
            cost = math.log((left + right) / n) / -(below * math.log(below) + (1 - below) * math.log1p(-below))
            if cost < best:
                best, found = cost, (ways[:, k], cut - band, cut + band)
    return found


# --- rows ------------------------------------------------------------------------------------------------------------


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of a two-dimensional array as binary values."""
    x = np.ascontiguousarray(x)
    wide = x.shape[1] * x.itemsize
    if len(x) * wide >= 1 << 31:
        raise ValueError("a batch of vectors is beyond 2 GB: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(wide)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Binary values of equal length as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows brought to length one, in double precision; huge and tiny components don't overflow."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _bytes(kind: str) -> Arrow:
    """(id, dim, vec) of each row: the vector's own bytes, null where it can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            flat = lists.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(kind) + np.array(0, dtype=kind)  # -0.0 becomes 0.0; a null is NaN
            starts = np.cumsum(size) - size
            some = np.flatnonzero(size)
            good = np.zeros(len(size), dtype=bool)
            if len(some):
                finite = np.add.reduceat(~np.isfinite(values), starts[some]) == 0
                good[some] = finite & (np.maximum.reduceat(np.abs(np.nan_to_num(values)), starts[some]) > 0)
            raw = values.tobytes()
            wide = values.itemsize
            vec = [raw[a * wide : (a + n) * wide] if ok else None for a, n, ok in zip(starts.tolist(), size.tolist(), good.tolist(), strict=True)]
            yield _batch(id=batch.column(0), dim=pa.array(np.where(good, size, 0), pa.int32()), vec=pa.array(vec, pa.binary()))

    return run


def _encode(u: np.ndarray) -> np.ndarray:
    """Unit vectors as bytes, with their scale and the length of what that leaves out (rounded up)."""
    scale = (np.abs(u).max(axis=1) / 127).astype(np.float32)
    q = np.rint(u / scale[:, None]).astype(np.int8)
    lost = u - q * scale[:, None].astype(np.float64)
    error = (np.sqrt(np.einsum("ij,ij->i", lost, lost)) * 1.00001 + 1e-7).astype(np.float32)
    return np.concatenate([q.view(np.uint8), scale.view(np.uint8).reshape(-1, 4), error.view(np.uint8).reshape(-1, 4)], axis=1)


def _decode(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale, error = np.ascontiguousarray(code[:, -8:-4]).view(np.float32), np.ascontiguousarray(code[:, -4:]).view(np.float32)
    return code[:, :-8].view(np.int8).astype(np.float32) * scale, error[:, 0]


def _leaves(forest: bytes, kind: str, base: int, counts: bool) -> Arrow:
    """(leaf, id, code) of every leaf of the trees that each vector falls into, or (leaf, n) of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown: list[tuple[int, Tree]] = pickle.loads(forest)
        for big in batches:
            for at in range(0, big.num_rows, 4096):
                batch = big.slice(at, 4096)
                u = _units(_matrix(batch.column(1), kind))
                code = None if counts else _encode(u)
                ids = batch.column(0).to_numpy()
                for t, tree in grown:
                    rows, leaf = tree.route(u)
                    leaf = base + (t << 32) + leaf + 1
                    if counts:
                        own, n = np.unique(leaf, return_counts=True)
                        yield _batch(leaf=pa.array(own, pa.int64()), n=pa.array(n, pa.int64()))
                    else:
                        yield _batch(leaf=pa.array(leaf, pa.int64()), id=pa.array(ids[rows], pa.int64()), code=_packed(code[rows]))

    return run


def _encoded(kind: str) -> Arrow:
    """(leaf, id, code) for the sizes of which there are few vectors: one leaf a size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [_encode(_units(np.frombuffer(v, dtype=kind)[None, :]))[0].tobytes() for v in batch.column(1).to_pylist()]
            yield _batch(leaf=pa.array(-batch.column(2).to_numpy().astype(np.int64)), id=batch.column(0), code=pa.array(codes, pa.binary()))

    return run


# --- oversize leaves -------------------------------------------------------------------------------------------------


def _grow(band: float):
    def run(table: pa.Table) -> pa.Table:
        leaf = table.column("leaf")[0].as_py()
        tree = Tree(_decode(_matrix(table.column("code"), "u1"))[0].astype(np.float64), LEAF_SAMPLE, band, leaf % (1 << 31))
        return pa.table({"leaf": pa.array([leaf], pa.int64()), "tree": pa.array([pickle.dumps(tree) if tree.leaves > 1 else None], pa.binary())})

    return run


def _move(members: pa.Table, trees: pa.Table) -> pa.Table:
    """A slice of a leaf's members goes on through the tree grown for it."""
    if not (members.num_rows and trees.num_rows):
        return pa.table({"leaf": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "code": pa.array([], pa.binary())})
    code, leaf = _matrix(members.column("code"), "u1"), np.int64(members.column("leaf")[0].as_py())
    rows, low = pickle.loads(trees.column("tree")[0].as_py()).route(_decode(code)[0])
    with np.errstate(over="ignore"):
        new = (leaf * np.int64(1_000_003) + low.astype(np.int64) + 1) & np.int64((1 << 62) - 1)
    return pa.table({"leaf": pa.array(new), "id": pa.array(members.column("id").to_numpy()[rows]), "code": _packed(code[rows])})


def _refined(members: DataFrame, limit: int, band: float, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """Members of oversize leaves, dealt further until the leaves are small: (leaf, id, code), and (leaf, id) of those too dense to split.

    Each leaf's tree is grown on about 4,096 of its members.
    """
    fine, dense = [], []
    schema = "leaf long, id long, code binary"
    for _ in range(40):
        big = scratch.keep(members.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > limit), "big")
        if big.isEmpty():
            return [*fine, members], dense
        inside = members.join(big, "leaf")
        hashed = F.pmod(F.xxhash64("id", "leaf"), F.lit(1 << 30))
        sample = inside.where(hashed < F.least(F.lit(1.0), 4096 / F.col("n")) * float(1 << 30)).select("leaf", "code")
        trees = scratch.keep(sample.groupBy("leaf").applyInArrow(_grow(band), "leaf long, tree binary"), "trees")
        fine.append(members.join(big, "leaf", "left_anti").select("leaf", "id", "code"))
        dense.append(members.join(trees.where("tree is null"), "leaf", "left_semi").select("leaf", "id"))
        slices = F.ceil(F.col("n") / SLICE).cast("int")
        grown = trees.where("tree is not null").join(big, "leaf").select("leaf", "tree", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
        going = inside.join(trees.where("tree is not null").select("leaf"), "leaf").withColumn("slice", F.pmod(F.xxhash64("id"), slices).cast("int"))
        going = going.select("leaf", "slice", "id", "code").groupBy("leaf", "slice").cogroup(grown.groupBy("leaf", "slice"))
        members = scratch.keep(going.applyInArrow(_move, schema), "moved")
    return fine, [*dense, members.select("leaf", "id")]


# --- comparison ------------------------------------------------------------------------------------------------------


def _possible(threshold: float):
    """(leaf, id) of a leaf's vectors that can have a link in it, by the bytes and their error bound."""

    def run(table: pa.Table) -> pa.Table:
        code, ids = _matrix(table.column("code"), "u1"), table.column("id")
        x, e = _decode(code)
        some = np.zeros(len(x), dtype=bool)
        for a in range(0, len(x), 1024):
            part = x[a : a + 1024] @ x.T
            part += e[None, :] * (1 + e[a : a + 1024, None]) + e[a : a + 1024, None]
            part[np.arange(len(part)), a + np.arange(len(part))] = -2
            some[a : a + 1024] = part.max(axis=1) >= threshold - 1e-5
        at = pa.array(np.flatnonzero(some))
        return pa.table({"leaf": table.column("leaf").take(at), "id": ids.take(at)})

    return run


def _links(threshold: float, kind: str):
    """Links of one leaf, or of two of its blocks: how many each member has that no earlier leaf counts, and its local class."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, weight, block = (table.column(c).to_numpy() for c in ("id", "weight", "block"))
        leaf, left, right = (table.column(c)[0].as_py() for c in ("leaf", "left", "right"))
        u = _units(_matrix(table.column("vec"), kind))
        a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
        link = u[a] @ u[b].T >= threshold
        if left == right:
            np.fill_diagonal(link, False)
        some_a, some_b = link.any(axis=1), link.any(axis=0)
        link, a, b = link[np.ix_(some_a, some_b)], a[some_a], b[some_b]
        earlier = {i: [v for v in own if v < leaf] for i, own in zip(np.union1d(a, b).tolist(), table.column("leaves").take(pa.array(np.union1d(a, b))).to_pylist(), strict=True)}
        number = {v: k for k, v in enumerate({v for own in earlier.values() for v in own})}
        counted = link
        if number:
            held = np.zeros((len(ids), len(number)), dtype=np.float32)
            for i, own in earlier.items():
                held[i, [number[v] for v in own]] = 1
            counted = link & (held[a] @ held[b].T == 0)
        total = np.zeros(len(ids), dtype=np.int64)
        np.add.at(total, a, counted @ weight[b])
        if left != right:
            np.add.at(total, b, weight[a] @ counted)
        label = np.arange(len(ids))  # rows are in the order of ids, so the smallest row is the smallest id
        while len(a):
            new = label.copy()
            new[a] = np.minimum(new[a], np.where(link, label[b][None, :], len(ids)).min(axis=1))
            new[b] = np.minimum(new[b], np.where(link, new[a][:, None], len(ids)).min(axis=0))
            if (new == label).all():
                break
            label = new
        out = np.union1d(a, b)
        return pa.table({"id": pa.array(ids[out], pa.int64()), "links": pa.array(total[out], pa.int64()), "low": pa.array(ids[label[out]], pa.int64())})

    return run


def _compared(flagged: DataFrame, sets: DataFrame, threshold: float, kind: str, scratch: Scratch) -> DataFrame:
    """(id, links, low) of the flagged vectors, leaf by leaf; leaves beyond BLOCK in pairs of blocks."""
    lists = scratch.keep(flagged.groupBy("id").agg(F.array_sort(F.collect_set("leaf")).alias("leaves")), "lists")
    known = scratch.keep(lists.join(sets.select("id", "weight", "vec"), "id"), "known")
    scratch.drop(lists)
    sizes = scratch.keep(flagged.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    parts, out = max(1, math.ceil(flagged.count() / AT_ONCE)), []
    for part in range(parts):
        leaves = sizes.where(F.pmod("leaf", F.lit(parts)) == part).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        rows = flagged.join(leaves, "leaf").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        rows = rows.select("leaf", "id", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        rows = rows.select("leaf", "id", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
        own = rows.join(known, "id").groupBy("leaf", "left", "right")
        out.append(scratch.keep(own.applyInArrow(_links(threshold, kind), "id long, links long, low long"), "links"))
    scratch.drop(known)
    links = out[0]
    for more in out[1:]:
        links = links.union(more)
    return links


def trees_for(n: int, leaf_size: int) -> int:
    """Trees that together miss a linked pair at most MISS of the time, as the trees get deeper with n."""
    levels = max(0.0, math.log(max(n, 1) / leaf_size) / math.log(1 / SIDE))
    together = STAYS**levels
    return 1 if levels == 0 else max(2, math.ceil(math.log(MISS) / math.log1p(-together)))


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, leaf_size: int = 1024, trees: int | None = None) -> DataFrame:
    """(key, n_links, component_id, kept): vectors joined by links of cosine >= threshold (double precision).

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing, nor do vectors of different
    length. Equal vectors collapse to the smallest key before the search and count as links of each other. Rows with a null key
    take part in nothing: their component is null and they are kept. Rows that repeat a key with different vectors are nodes of
    that key each. An empty table gives an empty result; further columns are ignored.

    Sizes with up to 4 * leaf_size vectors are one leaf. For others the trees' upper part is grown on SAMPLE vectors at most, and
    leaves that get more than 4 * leaf_size of all vectors are split further by trees grown on samples of their own. What is too
    dense to split is compared by pairs of blocks. trees None: trees_for, more the deeper they are.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "rpforest")
    kind = "<f4" if df.select(vector).schema[0].dataType.simpleString() == "array<float>" else "<f8"
    values = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    rows = values.mapInArrow(_bytes(kind), "id long, dim int, vec binary")
    sets = scratch.keep(rows.where("dim > 0 and id is not null").groupBy("dim", "vec").agg(F.min("id").alias("first"), F.count("*").alias("weight")), "distinct")
    again = sets.groupBy("first").count().where("count > 1").select("first", F.lit(True).alias("again"))
    several = not again.isEmpty()
    if several:  # different vectors under one key: nodes are numbered in the order of keys
        order = sets.join(again, "first", "left").repartitionByRange("first", "vec").sortWithinPartitions("first", "vec")
        sets = scratch.keep(order.select("*", F.monotonically_increasing_id().alias("id")), "numbered")
    else:
        sets = sets.select("*", F.lit(None).cast("boolean").alias("again"), F.col("first").alias("id"))
    limit, band = 4 * leaf_size, SPILL * math.sqrt(2 - 2 * threshold)
    sizes = sets.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > limit).collect()  # at most rows / limit of them
    flagged, schema, possible = [], "leaf long, id long, code binary", "leaf long, id long"
    few = sets.where(~F.col("dim").isin([r["dim"] for r in sizes])) if sizes else sets
    small = few.select("id", "vec", "dim").mapInArrow(_encoded(kind), schema)
    flagged.append(scratch.keep(small.groupBy("leaf").applyInArrow(_possible(threshold), possible), "possible"))
    for dim, n in sizes:
        own, base = sets.where(F.col("dim") == dim).select("id", "vec"), int(dim) << 44
        order = F.xxhash64("id")
        picked = own.where(F.pmod(order, F.lit(1 << 30)) < float(1 << 30) * min(1.0, 1.1 * SAMPLE / n)).orderBy(order).limit(SAMPLE).toArrow()
        sample = _units(_matrix(picked.column("vec"), kind))
        smallest = max(LEAF_SAMPLE if n > len(sample) else 1, leaf_size * len(sample) // (2 * n), 1)
        forest = [(t, Tree(sample, smallest, band, t)) for t in range(trees or trees_for(n, leaf_size))]
        counts = own.mapInArrow(_leaves(pickle.dumps(forest), kind, base, True), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
        big = [r["leaf"] for r in counts.where(F.col("n") > limit).collect()]  # leaves of the sample's trees: bounded
        for at in range(0, len(forest), TREES_AT_ONCE):
            members = own.mapInArrow(_leaves(pickle.dumps(forest[at : at + TREES_AT_ONCE]), kind, base, False), schema)
            over = [x for x in big if (x - base) >> 32 in range(at, at + TREES_AT_ONCE)]
            fine = [members.where(~F.col("leaf").isin(over)) if over else members]
            if over:
                moved, dense = _refined(scratch.keep(members.where(F.col("leaf").isin(over)), "oversize"), limit, band, scratch)
                fine += moved
                flagged += [scratch.keep(x, "dense") for x in dense]
            every = fine[0]
            for x in fine[1:]:
                every = every.union(x)
            flagged.append(scratch.keep(every.groupBy("leaf").applyInArrow(_possible(threshold), possible), "possible"))
    every = flagged[0]
    for x in flagged[1:]:
        every = every.union(x)
    links = _compared(every, sets, threshold, kind, scratch)
    component = scratch.keep(connected_components(links.select(F.col("id").alias("a"), F.col("low").alias("b")), scratch), "components")
    total = links.groupBy("id").agg(F.sum("links").alias("links"))
    found = total.join(component.withColumnRenamed("node", "id"), "id", "left")
    if several:
        found = found.join(sets.select(F.col("id").alias("component"), F.col("first").alias("key")), "component", "left").select("id", "links", F.col("key").alias("component"))
    found = scratch.keep(found, "found")
    twins = sets.where("weight > 1 or again").join(found, "id", "left")
    twins = scratch.keep(twins.select("vec", "first", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("twin_links"), F.coalesce("component", "first").alias("twin_component")), "twins")
    if several:
        found = found.join(sets.where("again is null"), "id").select(F.col("first").alias("id"), "links", "component")
    if (twins.agg(F.sum(F.length("vec") + 32)).first()[0] or 0) <= BROADCAST_BYTES:
        twins = F.broadcast(twins)
    out = rows.join(twins.drop("first"), "vec", "left").drop("vec").join(found, "id", "left")
    usable = F.col("id").isNotNull() & (F.col("dim") > 0)
    n_links = F.when(usable, F.coalesce("twin_links", "links", F.lit(0))).otherwise(0)
    component = F.when(usable, F.coalesce("twin_component", "component", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), n_links.cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
