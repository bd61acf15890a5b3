"""Call graphs as node and edge tables.

Every function takes the columns that tell graphs apart (keys, such as year and apk_sha256) and works on all graphs at once. Adjacency
is a bag: an edge that the graph holds in both directions counts twice, and the count is carried as `mult`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .lineage import Kept, cut

NO_CUT = 1e9


def external_methods(methods: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct callees that are no method of their graph."""
    own = methods.select(*keys, F.col("sig")).distinct()
    return calls.select(*keys, F.col("callee").alias("sig")).distinct().join(own, [*keys, "sig"], "left_anti")


def connected_methods(methods: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """P5: methods that call or are called. Signatures go into the semi-join as they come: no task holds a set of them."""
    return methods.join(calls.select(*keys, F.explode(F.array("caller", "callee")).alias("sig")), [*keys, "sig"], "left_semi")


def build_nodes(methods: DataFrame, calls: DataFrame, api_perms: DataFrame, keys: list[str], keep_isolated: bool = True) -> DataFrame:
    """(keys, node_id, sig, is_external, is_sensitive, perms): methods in their order `ord`, then externals by name.

    Only externals are sensitive: those that the permission table names. The table is joined by whatever strategy its size allows.
    """
    inner = methods if keep_isolated else connected_methods(methods, calls, keys)
    outer = external_methods(methods, calls, keys).join(api_perms.withColumnRenamed("api_sig", "sig"), "sig", "left")
    none = F.array().cast("array<string>")
    rows = inner.select(*keys, "sig", F.lit(0).alias("is_external"), F.col("ord").cast("long").alias("ord"), none.alias("perms"))
    rows = rows.unionByName(outer.select(*keys, "sig", F.lit(1).alias("is_external"), F.lit(None).cast("long").alias("ord"), F.coalesce("perms", none).alias("perms")))
    w = Window.partitionBy(*keys).orderBy("is_external", "ord", "sig")
    return rows.select(*keys, (F.row_number().over(w) - 1).alias("node_id"), "sig", "is_external", ((F.size("perms") > 0) & (F.col("is_external") == 1)).cast("int").alias("is_sensitive"), F.array_sort("perms").alias("perms"))


def build_edges(nodes: DataFrame, calls: DataFrame, keys: list[str], reverse: bool = True, self_loops: bool = False, mark: str | None = None) -> DataFrame:
    """Distinct (keys, src, dst, is_fwd); calls whose ends are no nodes are dropped, a repeated signature means its last node.

    mark: a column of nodes that edges carry of both ends, as src_<mark> and dst_<mark>, so that edges at marked nodes are found without a join.
    """
    own = ["node_id", *([mark] if mark else [])]
    index = nodes.groupBy(*keys, "sig").agg(F.max(F.struct(*own) if mark else F.col("node_id")).alias("x"))
    index = index.select(*keys, "sig", *([F.col(f"x.{c}").alias(n) for c, n in zip(own, ["id", "mark"], strict=True)] if mark else [F.col("x").alias("id")]))
    ends = calls.select(*keys, "caller", "callee")
    ends = ends.join(index.withColumnsRenamed({"sig": "caller", "id": "src", "mark": "src_mark"}), [*keys, "caller"]).join(index.withColumnsRenamed({"sig": "callee", "id": "dst", "mark": "dst_mark"}), [*keys, "callee"])
    edges = ends.select(*keys, "src", "dst", F.lit(True).alias("is_fwd"), *([F.col(f"{e}_mark").alias(f"{e}_{mark}") for e in ("src", "dst")] if mark else []))
    if reverse:  # both directions of a pair meet in one row
        up, down = F.col("src") <= F.col("dst"), F.col("src") >= F.col("dst")
        marks = [F.max(F.when(up, x).otherwise(y)).alias(n) for n, x, y in (("a_mark", F.col("src_mark"), F.col("dst_mark")), ("b_mark", F.col("dst_mark"), F.col("src_mark")))] if mark else []
        pairs = ends.groupBy(*keys, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(up).alias("up"), F.max(down).alias("down"), *marks)
        edges = pairs.select(*keys, F.inline(_both(F.col("up"), F.col("down"), "is_fwd", mark)))
        if not self_loops:
            return edges
    if self_loops:
        edges = edges.union(nodes.select(*keys, "node_id", "node_id", F.lit(False), *([mark, mark] if mark else [])))
    return edges.groupBy(*keys, "src", "dst").agg(F.max("is_fwd").alias("is_fwd"), *([F.max(f"{e}_{mark}").alias(f"{e}_{mark}") for e in ("src", "dst")] if mark else []))


def _both(up: Column, down: Column, name: str, mark: str | None = None) -> Column:
    """The pair a <= b as an edge each way, with a value each and its ends' marks; a loop once."""
    way = lambda x, y, value: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), value.alias(name), *([F.col(f"{x}_mark").alias(f"src_{mark}"), F.col(f"{y}_mark").alias(f"dst_{mark}")] if mark else []))
    return F.when(F.col("a") == F.col("b"), F.array(way("a", "b", up))).otherwise(F.array(way("a", "b", up), way("b", "a", down)))


def node_features(nodes: DataFrame, vectors: DataFrame, keys: list[str], width: int, symbolic: int = 24) -> DataFrame:
    """x_base and x_symbolic of every node by signature; zeros where a method has none and, symbolic ones, for all externals."""
    zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)
    out = nodes.join(vectors.select(*keys, "sig", "embedding", "symbolic_features"), [*keys, "sig"], "left")
    sym = F.when(F.col("is_external") == 0, F.col("symbolic_features"))
    return out.withColumns({"x_base": F.coalesce("embedding", zeros(width)), "x_symbolic": F.coalesce(sym, zeros(symbolic))}).drop("embedding", "symbolic_features")


def graph_meta(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """A5: counters of each graph."""
    n = nodes.groupBy(*keys).agg(F.count("*").alias("num_nodes"), F.sum(1 - F.col("is_external")).alias("num_internal"), F.sum("is_external").alias("num_external"), F.sum("is_sensitive").alias("num_sensitive"))
    e = edges.groupBy(*keys).agg(F.count("*").alias("num_edges"), F.count_if("is_fwd").alias("num_edges_fwd"))
    return n.join(e, keys, "left").na.fill(0, ["num_edges", "num_edges_fwd"])


def adjacency(edges: DataFrame, keys: list[str], undirected: bool = True, mirrored: bool = False) -> DataFrame:
    """(keys, src, dst, mult).

    mirrored: edges are distinct and hold both directions of each pair, as build_edges makes them with reverse; then each pair counts two and
    a loop one, without a shuffle, and what else edges carry stays.
    """
    rows = edges.select(*keys, "src", "dst")
    if undirected and mirrored:
        return edges.drop("is_fwd").withColumn("mult", F.when(F.col("src") == F.col("dst"), F.lit(1)).otherwise(2).cast("long"))
    if undirected:  # both directions count for both
        pairs = rows.groupBy(*keys, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("mult"))
        return pairs.select(*keys, F.inline(_both(F.col("mult"), F.col("mult"), "mult")))
    return rows.groupBy(*keys, "src", "dst").agg(F.count("*").alias("mult"))


def degrees(adj: DataFrame, keys: list[str]) -> DataFrame:
    """Bag degree of each node."""
    return adj.groupBy(*keys, F.col("src").alias("node_id")).agg(F.sum("mult").alias("deg"))


def khop(adj: DataFrame, sources: DataFrame, k: int, keys: list[str], extra: list[str] = (), ends: DataFrame | None = None, mark: str | None = None) -> DataFrame:
    """(keys, extra, node_id, dist): hops to the nearest source, up to k. extra: columns that tell source sets of one graph apart.

    A hop is a join of the frontier alone; nodes reached before are taken out by an anti join. ends: (keys, node_id) where the last hop has to
    land; what it would reach besides is not made. mark: what edges carry of their ends (see build_edges) and is 1 at all sources and at just the ends;
    then the first hop reads edges that leave a marked node, the last one to given ends those that reach one, and neither moves all edges.
    """
    own = [*keys, *extra]
    found = sources.select(*own, "node_id").distinct().withColumn("dist", F.lit(0))
    frontier, links = found, adj.where("src <> dst")
    for d in range(1, k + 1):
        near = links.where(F.col(f"src_{mark}") == 1) if mark and d == 1 else links
        near = near.where(F.col(f"dst_{mark}") == 1) if mark and d == k and ends is not None else near
        steps = near.select(*keys, F.col("src").alias("node_id"), F.col("dst").alias("next"))
        if d == k and ends is not None and not mark:
            steps = steps.join(ends.select(*keys, F.col("node_id").alias("next")).distinct(), [*keys, "next"], "left_semi")
        new = frontier.join(steps, [*keys, "node_id"]).select(*own, F.col("next").alias("node_id")).distinct()
        frontier = cut(new.join(found.select(*own, "node_id"), [*own, "node_id"], "left_anti").withColumn("dist", F.lit(d)))
        found = found.union(frontier)
    return found


def _by_group(own: list[str], least: int, compute: Callable[..., pd.DataFrame | Iterator[pd.DataFrame]]):
    """Rows of whole numbers sorted by their group go through compute, many small groups at a time, a large one alone.

    compute(names, code, *columns): each group's keys, each row's group number and its other columns, which are held as 32-bit arrays and are
    compute's own to change; it gives its result as a frame or, a large one, in pieces. Columns are put together one by one, so none is held twice beside the others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, parts, rows = [], [], 0

        def flush(count: int) -> Iterator[pd.DataFrame]:
            nonlocal parts, rows
            lists, columns = [list(c) for c in zip(*parts, strict=True)], []
            parts = []
            while lists:
                columns.append(np.concatenate(lists.pop(0)))
            at = int(np.searchsorted(columns[0], count))
            rows = len(columns[0]) - at
            if rows:
                parts = [(columns[0][at:] - np.int32(count), *(c[at:].copy() for c in columns[1:]))]
            done = names[:count]
            del names[:count]
            out = compute(pd.DataFrame(done, columns=own, dtype=object), *(c[:at] for c in columns))
            yield from [out] if isinstance(out, pd.DataFrame) else out

        for pdf in batches:
            if pdf.empty:
                continue
            k = pdf[own]
            before = k.shift()
            new = ((k != before) & ~(k.isna() & before.isna())).any(axis=1).to_numpy()
            first = tuple(None if pd.isna(x) else x for x in k.iloc[0])
            new[0] = not names or names[-1] != first
            base = len(names)
            names += [tuple(None if pd.isna(x) else x for x in t) for t in k[new].itertuples(index=False, name=None)]
            parts.append(((base - 1 + np.cumsum(new)).astype(np.int32), *(pdf[c].to_numpy(dtype=np.int32) for c in pdf.columns if c not in own)))
            rows += len(pdf)
            if rows >= least and len(names) > 1:
                yield from flush(len(names) - 1)
        if names:
            yield from flush(len(names))

    return run


def _nodes_of(code: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Group number and id of each different node, sorted, and each column as places among these; ids below 0 get the place -1."""
    if len(code) and code[0] == code[-1] and max(int(c.max()) for c in columns) <= 2 * len(code) + 1000:  # a large graph: its ids are dense
        size = max(int(c.max()) for c in columns) + 1
        return np.zeros(size, np.int32), np.arange(size, dtype=np.int32), list(columns)
    keyed = [(code.astype(np.int64) << 32) | c for c in columns]
    ids = np.unique(np.concatenate([x[c >= 0] for x, c in zip(keyed, columns, strict=True)]))
    return (ids >> 32).astype(np.int32), (ids & 0xFFFFFFFF).astype(np.int32), [np.where(c >= 0, np.searchsorted(ids, x), -1).astype(np.int32) for x, c in zip(keyed, columns, strict=True)]


def _pieces(names: pd.DataFrame, group: np.ndarray, size: int = 1 << 17, **columns: np.ndarray) -> pd.DataFrame | Iterator[pd.DataFrame]:
    """Rows of keys and columns: one frame or, of more than size rows, so many at a time."""
    piece = lambda i: names.iloc[group[i : i + size]].reset_index(drop=True).assign(**{c: v[i : i + size] for c, v in columns.items()})
    return piece(0) if len(group) <= size else map(piece, range(0, len(group), size))


def _components(own: list[str]):
    def compute(names: pd.DataFrame, code: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame | Iterator[pd.DataFrame]:
        group, ids, (x, y) = _nodes_of(code, a, b)
        parent = list(range(len(ids)))

        def find(n: int) -> int:
            while parent[n] != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        linked = y >= 0
        for i, j in zip(x[linked].tolist(), y[linked].tolist(), strict=True):
            i, j = find(i), find(j)
            parent[max(i, j)] = min(i, j)
        there = np.unique(x)
        root = np.fromiter((find(n) for n in there.tolist()), np.int64, len(there))
        return _pieces(names, group[there], node_id=ids[there], component=ids[root])

    return compute


def _contracted(keys: list[str]):
    """Union-find within a partition: its edges become stars, one edge at most for each node of a graph."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[tuple, tuple] = {}

        def find(x: tuple) -> tuple:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for pdf in batches:
            for *k, a, b in pdf[[*keys, "a", "b"]].itertuples(index=False):
                x, y = find((*k, a)), find((*k, b))
                if x != y:
                    parent[max(x, y)] = min(x, y)
        pairs = [(*v, r[-1]) for v in parent if (r := find(v)) != v]
        for at in range(0, len(pairs), 1 << 16):
            yield pd.DataFrame(pairs[at : at + (1 << 16)], columns=[*keys, "a", "b"])

    return run


def star_components(edges: DataFrame, keys: list[str], rounds: int = 60) -> DataFrame:
    """(keys, node_id, component) of the nodes with an edge (keys, a, b) to another one, in graphs of any size: none needs to fit a task.

    A union-find in every partition thins the edges; then large-star and small-star rounds (Kiveris et al., 2014) alternate, each kept in
    the shared folder, until none changes an edge. Nodes' lists of neighbours are never gathered: a hub is an aggregation by its id.
    """
    kinds = [f"`{c}` {t}" for c, t in edges.dtypes if c in keys]
    with Kept(edges.sparkSession, "components") as kept:
        e = edges.where("a <> b").select(*keys, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
        e, seen = kept(e.mapInPandas(_contracted(keys), ", ".join([*kinds, "a long", "b long"])).distinct()), None
        for _ in range(rounds):
            both = e.union(e.select(*keys, "b", "a"))
            low = both.groupBy(*keys, "a").agg(F.min("b").alias("m")).select(*keys, "a", F.least("a", "m").alias("m"))
            large = both.where("b > a").join(low, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            low = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
            small = large.join(low, [*keys, "a"]).select(*keys, F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
            e = kept(small)
            now = e.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
            if now == seen:
                own = e.select(*keys, F.col("a").alias("node_id"), F.col("b").alias("component"))
                return kept.last(own.union(e.select(*keys, "b", F.col("b")).distinct()))
            seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds: raise rounds")


def components(nodes: DataFrame, links: DataFrame, keys: list[str], in_task: int = 1_000_000) -> DataFrame:
    """(keys, node_id, component): components of the subgraph that the nodes induce; a component is named by its smallest node.

    While no graph has more than in_task links, a task holds small graphs together and large ones alone; else all graphs go through star_components. The links are counted.
    """
    inside = links.join(nodes.select(*keys, F.col("node_id").alias("src")), [*keys, "src"], "left_semi").join(nodes.select(*keys, F.col("node_id").alias("dst")), [*keys, "dst"], "left_semi")
    inside = cut(inside.select(*keys, "src", "dst"))  # read twice: to be counted, and by a task
    own = nodes.select(*keys, "node_id").distinct()
    if (inside.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > in_task:
        found = star_components(inside.select(*keys, F.col("src").alias("a"), F.col("dst").alias("b")), keys)
        return own.join(found, [*keys, "node_id"], "left").select(*keys, F.col("node_id").cast("int").alias("node_id"), F.coalesce("component", "node_id").cast("int").alias("component"))
    rows = own.select(*keys, F.col("node_id").cast("int").alias("a"), F.lit(-1).alias("b")).union(inside.where("src <> dst").select(*keys, F.col("src").cast("int"), F.col("dst").cast("int")))
    fields = [*[f"`{k}` {t}" for k, t in rows.dtypes if k in keys], "node_id int", "component int"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_by_group(keys, 1 << 18, _components(keys)), ", ".join(fields))


def with_vectors(rows: DataFrame, vectors: DataFrame | tuple[DataFrame, DataFrame], keys: list[str], node: str = "node_id", out: str = "h", how: str = "inner") -> DataFrame:
    """rows with their nodes' vectors. vectors: (keys, node_id, h), or (keys, node_id, vec_id) and (vec_id, h) where many nodes share one.

    In the second form rows travel with a vec_id alone; the table of vectors is broadcast while it has 20,000 rows at most, which are counted.
    """
    if not isinstance(vectors, tuple):
        return rows.join(vectors.select(*keys, F.col("node_id").alias(node), F.col("h").alias(out)), [*keys, node], how)
    return with_shared(rows.join(vectors[0].select(*keys, F.col("node_id").alias(node), F.col("vec_id").alias("_vec")), [*keys, node], how), vectors[1], out, how)


def with_shared(rows: DataFrame, table: DataFrame, out: str = "h", how: str = "inner") -> DataFrame:
    """rows, which have a vec_id _vec, with that vector of the table (vec_id, h) in its place."""
    table = table.select(F.col("vec_id").alias("_vec"), F.col("h").alias(out))
    table = F.broadcast(table) if table.limit(20_001).count() <= 20_000 else table
    return rows.join(table, "_vec", how).drop("_vec")


def anchor_links(adj: DataFrame, nodes: DataFrame, vectors: DataFrame | tuple[DataFrame, DataFrame], keys: list[str], hops: int = 3, threshold: float = 0.55) -> DataFrame:
    """(keys, src, dst, sim) of sensitive nodes within `hops` whose vectors' cosine reaches the threshold, both directions.

    vectors: of sensitive nodes at least; others' are not looked at. Where links carry is_sensitive of their ends, the first and last hop read by it.
    """
    sens = nodes.where("is_sensitive = 1").select(*keys, "node_id")
    mark = "is_sensitive" if "src_is_sensitive" in adj.columns else None
    near = khop(adj, sens.withColumn("from", F.col("node_id")), hops, keys, ["from"], sens, mark).where("dist > 0").join(sens, [*keys, "node_id"], "left_semi")
    pairs = with_vectors(with_vectors(near, vectors, keys), vectors, keys, "from", "_from_h")
    return pairs.select(*keys, F.col("from").alias("src"), F.col("node_id").alias("dst"), V.cosine(F.col("_from_h"), F.col("h")).alias("sim")).where(F.col("sim") >= threshold)


def anchor_groups(nodes: DataFrame, links: DataFrame, keys: list[str], in_task: int = 1_000_000) -> DataFrame:
    """(keys, node_id, group_id) of sensitive nodes: components over their links, numbered by smallest member."""
    sens = nodes.where("is_sensitive = 1").select(*keys, F.col("node_id").cast("int").alias("node_id"))
    own = components(sens, links.select(*keys, F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst")), keys, in_task)
    return own.select(*keys, "node_id", (F.dense_rank().over(Window.partitionBy(*keys).orderBy("component")) - 1).alias("group_id"))


def ppr(adj: DataFrame, seeds: DataFrame, keys: list[str], extra: list[str] = (), alpha: float = 0.15, iterations: int = 25, mask: DataFrame | None = None) -> DataFrame:
    """(keys, extra, node_id, ppr) after so many rounds from the distinct seeds; a node without neighbours in the mask loses its mass.

    A round is one join and one sum; each fifth round is checkpointed.
    """
    own = [*keys, *extra]
    seeds = seeds.select(*own, "node_id").distinct()
    start = seeds.withColumn("s", F.lit(1.0) / F.count("*").over(Window.partitionBy(*own)))
    steps = adj.select(*keys, F.col("src").alias("node_id"), F.col("dst").alias("next"), "mult")
    if mask is not None:
        mask = mask.select(*own, "node_id").distinct()
        steps = mask.join(steps, [*keys, "node_id"]).join(mask.withColumnRenamed("node_id", "next"), [*own, "next"], "left_semi")
    by = own if mask is not None else keys
    steps = steps.withColumn("share", F.col("mult") / F.sum("mult").over(Window.partitionBy(*by, "node_id"))).drop("mult")
    p = start.select(*own, "node_id", F.col("s").alias("p"))
    base = start.select(*own, "node_id", (F.col("s") * alpha).alias("p"))
    steps, base = cut(steps), cut(base)
    for i in range(iterations):
        moved = p.join(steps, [*by, "node_id"]).select(*own, F.col("next").alias("node_id"), (F.col("p") * F.col("share") * (1 - alpha)).alias("p"))
        p = base.union(moved).groupBy(*own, "node_id").agg(F.sum("p").alias("p"))
        if i % 5 == 4:
            p = cut(p)
    return p.withColumnRenamed("p", "ppr")


def _ppr_arrays(own: list[str], alpha: float, iterations: int, slice_: int = 1 << 20):
    """Ranks of one graph or of many small ones at once; a row is an edge or, with dst -1, a seed. Edges are worked off in slices."""

    def compute(names: pd.DataFrame, code: np.ndarray, src: np.ndarray, dst: np.ndarray, mult: np.ndarray) -> pd.DataFrame | Iterator[pd.DataFrame]:
        group, ids, (x, y) = _nodes_of(code, src, dst)
        seed = y < 0
        s = np.zeros(len(ids))
        s[x[seed]] = 1 / np.bincount(code[seed], minlength=len(names))[code[seed]]
        y[seed], mult[seed] = x[seed], 0  # a loop without weight, in place of a copy of all edges
        cuts = [slice(i, i + slice_) for i in range(0, len(x), slice_)]
        total = np.ones(len(ids)) if not cuts else sum(np.bincount(x[c], mult[c], len(ids)) for c in cuts)
        total[total == 0] = 1
        p = s
        for _ in range(iterations):
            sent, p = p / total, alpha * s
            for c in cuts:
                p += (1 - alpha) * np.bincount(y[c], sent[x[c]] * mult[c], len(ids))
        keep = np.flatnonzero(p > 0)
        return _pieces(names, group[keep], node_id=ids[keep], ppr=p[keep])

    return compute


def masked(adj: DataFrame, mask: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """(keys, extra, src, dst, mult): edges with both ends among the same group's nodes (keys, extra, node_id). Steps that take adj also take these, and then
    neither move all edges nor find groups anew."""
    mask, own = mask.select(*keys, *extra, "node_id").distinct(), [*keys, *extra]
    rows = mask.withColumnRenamed("node_id", "src").join(adj.select(*keys, "src", "dst", "mult"), [*keys, "src"])
    return rows.join(mask.withColumnRenamed("node_id", "dst"), [*own, "dst"], "left_semi").select(*own, "src", "dst", "mult")


def _given(edges: DataFrame, keys: list[str], extra: list[str]) -> list[str]:
    """What tells edges apart: their graph, or their group where masked has made them."""
    return [*keys, *extra] if set(extra) <= set(edges.columns) else list(keys)


def ppr_per_graph(adj: DataFrame, seeds: DataFrame, keys: list[str], extra: list[str] = (), alpha: float = 0.15, iterations: int = 25, mask: DataFrame | None = None) -> DataFrame:
    """G7 with all rounds of a graph in one task: one shuffle in place of one a round, where graphs fit a task as an application's do.

    A task streams its graphs in their order, works small ones off together and holds a large one at twelve bytes a link and some more a node.
    """
    own = [*keys, *extra]
    sides = seeds.select(*own, "node_id").distinct()
    groups = sides.select(*own).distinct()
    if mask is not None:
        rows = masked(adj, mask, keys, extra)
    else:
        rows = groups.join(adj, _given(adj, keys, extra))
    rows = rows.select(*own, F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), F.col("mult").cast("int").alias("mult"))
    rows = rows.union(sides.select(*own, F.col("node_id").cast("int"), F.lit(-1), F.lit(0)))
    fields = [*[f"`{c}` {t}" for c, t in rows.dtypes if c in own], "node_id int", "ppr double"]
    return rows.repartition(*own).sortWithinPartitions(*own).mapInPandas(_by_group(own, 1 << 18, _ppr_arrays(own, alpha, iterations)), ", ".join(fields))


def ppr_by_size(adj: DataFrame, seeds: DataFrame, keys: list[str], alpha: float = 0.15, iterations: int = 25, in_task: int = 24_000_000) -> DataFrame:
    """ppr_per_graph while no graph has more than in_task links, which are counted; else ppr, which shuffles all links in each round."""
    most = adj.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return (ppr_per_graph if most <= in_task else ppr)(adj, seeds, keys, (), alpha, iterations)


def node_scores(candidates: DataFrame, ranks: DataFrame, vectors: DataFrame | tuple[DataFrame, DataFrame], anchors: DataFrame, keys: list[str], extra: list[str], weights: tuple[float, float, float] = (0.45, 0.25, 0.10)) -> DataFrame:
    """Weighted sum of rank, likeness to the anchors' mean vector, and nearness."""
    own = [*keys, *extra]
    parts = with_vectors(anchors.select(*own, "node_id"), vectors, keys).select(*own, F.posexplode("h").alias("i", "x")).groupBy(*own, "i").agg(F.avg("x").alias("x"))
    mean = parts.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    out = candidates.join(ranks, [*own, "node_id"], "left")
    if isinstance(vectors, tuple):  # rows have found their vec_id before they get a mean vector, and travel no more with it
        out = out.join(vectors[0].select(*keys, "node_id", F.col("vec_id").alias("_vec")), [*keys, "node_id"], "left").join(mean, own, "left")
        out = with_shared(out, vectors[1], how="left")
    else:
        out = with_vectors(out.join(mean, own, "left"), vectors, keys, how="left")
    score = F.coalesce("ppr", F.lit(0.0)) * weights[0] + F.coalesce(V.cosine(F.col("h"), F.col("mean")), F.lit(0.0)) * weights[1] + weights[2] / (F.col("dist") + 1.0)
    return out.select(*own, "node_id", "dist", score.alias("score"))


def sweep_cut(adj: DataFrame, candidates: DataFrame, anchors: DataFrame, keys: list[str], extra: list[str] = (), min_nodes: int = 8, max_nodes: int = 120) -> DataFrame:
    """(keys, extra, node_id, phi) of the picked prefix of each ranking.

    candidates: (keys, extra, node_id, score). Anchors stand first, then by falling score, ties by rising id. When a node enters, the boundary grows
    by its degree less twice its edges into the prefix, itself included; so boundary and volume are running sums. The first prefix of least
    conductance counts that holds all anchors and min_nodes to max_nodes nodes. If there is none: the anchors and the next best nodes up to
    min_nodes, with phi NO_CUT.
    """
    own = [*keys, *extra]
    marks = anchors.select(*own, "node_id").distinct().withColumn("is_anchor", F.lit(1))
    rows = candidates.select(*own, "node_id", "score").join(marks, [*own, "node_id"], "left").na.fill(0, ["is_anchor"])
    ranked = cut(rows.withColumn("r", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("is_anchor"), F.when(F.col("is_anchor") == 0, F.col("score")).desc_nulls_first(), "node_id"))))
    a = ranked.select(*own, F.col("node_id").alias("src"), F.col("r").alias("r"))
    b = ranked.select(*own, F.col("node_id").alias("dst"), F.col("r").alias("q"))
    by = _given(adj, keys, extra)
    inner = b.join(adj.select(*by, "src", "dst", "mult"), [*by, "dst"]).join(a, [*own, "src"])  # in this order sums by src need no further shuffle
    gains = inner.groupBy(*own, F.col("src").alias("node_id")).agg(F.sum("mult").alias("deg"), F.sum(F.when(F.col("q") <= F.col("r"), F.col("mult")).otherwise(0)).alias("back"))
    rows = ranked.join(gains, [*own, "node_id"], "left").na.fill(0, ["deg", "back"])
    upto = Window.partitionBy(*own).orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*own)
    need = marks.groupBy(*own).agg(F.count("*").alias("anchors"))
    rows = rows.join(need, own, "left").withColumns({
        "boundary": F.sum(F.col("deg") - 2 * F.col("back")).over(upto), "vol": F.sum("deg").over(upto), "total": F.sum("deg").over(whole), "held": F.sum("is_anchor").over(upto),
    })
    conductance = F.col("boundary") / F.greatest(F.lit(1), F.least("vol", F.greatest(F.col("total") - F.col("vol"), F.lit(1))))
    ok = (F.col("held") == F.coalesce("anchors", F.lit(0))) & F.col("r").between(min_nodes, max_nodes)
    best = F.min(F.when(ok, F.struct(conductance.alias("phi"), F.col("r").alias("k")))).over(whole)
    rows = rows.withColumn("best", best)
    fill = F.greatest(F.coalesce("anchors", F.lit(0)), F.lit(min_nodes))
    picked = rows.where(F.when(F.col("best").isNotNull(), F.col("r") <= F.col("best.k")).otherwise(F.col("r") <= fill))
    lost = marks.drop("is_anchor").join(rows.select(*own, "node_id"), [*own, "node_id"], "left_anti")  # anchors that are no candidates
    out = picked.select(*own, "node_id", F.coalesce("best.phi", F.lit(NO_CUT)).alias("phi"))
    return out.union(lost.select(*own, "node_id", F.lit(NO_CUT)))


def prune_external(picked: DataFrame, nodes: DataFrame, adj: DataFrame, anchors: DataFrame, keys: list[str], extra: list[str] = ()) -> DataFrame:
    """Without externals that are neither anchor nor sensitive and have at most one bag edge to picked internal nodes."""
    own = [*keys, *extra]
    kinds = nodes.select(*keys, "node_id", "is_external", "is_sensitive")
    rows = picked.join(kinds, [*keys, "node_id"]).join(anchors.select(*own, "node_id").distinct().withColumn("is_anchor", F.lit(1)), [*own, "node_id"], "left")
    inner = rows.where("is_external = 0").select(*own, F.col("node_id").alias("dst"))
    fed = rows.where("is_external = 1").select(*own, F.col("node_id").alias("src")).join(adj, [*_given(adj, keys, extra), "src"]).join(inner, [*own, "dst"]).groupBy(*own, F.col("src").alias("node_id")).agg(F.sum("mult").alias("deg_in"))
    rows = rows.join(fed, [*own, "node_id"], "left")
    drop = F.col("is_anchor").isNull() & (F.col("is_external") == 1) & (F.col("is_sensitive") == 0) & (F.coalesce("deg_in", F.lit(0)) <= 1)
    return rows.where(~drop).select(*picked.columns)


def unit_edges(edges: DataFrame, members: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """Edges with both ends in the same unit, reverse ones included."""
    own = [*keys, *extra]
    src = members.select(*own, F.col("node_id").alias("src"))
    dst = members.select(*own, F.col("node_id").alias("dst"))
    return edges.join(src, [*keys, "src"]).join(dst, [*own, "dst"], "left_semi").select(*own, "src", "dst")


def mine_units(nodes: DataFrame, edges: DataFrame, vectors: DataFrame | tuple[DataFrame, DataFrame], keys: list[str], link_hops: int = 3, link_threshold: float = 0.55, hops: int = 4, alpha: float = 0.15, iterations: int = 25, weights: tuple[float, float, float] = (0.45, 0.25, 0.10), min_nodes: int = 8, max_nodes: int = 120, keep_external: bool = True, drop_external: bool = True, split: bool = True, mirrored: bool = False) -> DataFrame:
    """(keys, group_id, unit_id, node_id, score, phi, is_anchor): behaviour units around the groups of sensitive nodes.

    Tables that several steps read are checkpointed.

    Per group: candidates within hops, ranks among them, scores, sweep cut, external pruning, components that hold an anchor and min_nodes
    nodes. unit_id counts units of a graph by group and smallest node. phi is that of the whole pick. mirrored: as in adjacency.
    """
    adj = adjacency(edges, keys, mirrored=True) if mirrored else cut(adjacency(edges, keys))
    groups = cut(anchor_groups(nodes, anchor_links(adj, nodes, vectors, keys, link_hops, link_threshold), keys))
    extra, own = ["group_id"], [*keys, "group_id"]
    candidates = cut(khop(adj, groups, hops, keys, extra))
    inner = cut(masked(adj, candidates, keys, extra))  # all that follows stays within a group's candidates
    ranks = ppr_per_graph(inner, groups, keys, extra, alpha, iterations)
    scored = cut(node_scores(candidates, ranks, vectors, groups, keys, extra, weights))
    if not keep_external:
        scored = scored.join(nodes.where("is_external = 0").select(*keys, "node_id"), [*keys, "node_id"], "left_semi")
    picked = cut(sweep_cut(inner, scored, groups, keys, extra, min_nodes, max_nodes))
    if keep_external and drop_external:
        picked = cut(prune_external(picked, nodes, inner, groups, keys, extra))
    if split:
        member = picked.select(*own, F.col("node_id").cast("int").alias("node_id"))
        part = components(member, inner.select(*own, F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst")), own)
    else:
        part = picked.select(*own, "node_id", F.min("node_id").over(Window.partitionBy(*own)).alias("component"))
    rows = picked.join(part, [*own, "node_id"]).join(groups.withColumn("is_anchor", F.lit(1)), [*own, "node_id"], "left").na.fill(0, ["is_anchor"])
    unit = Window.partitionBy(*own, "component")
    rows = rows.withColumns({"_size": F.count("*").over(unit), "_anchors": F.sum("is_anchor").over(unit)}).where((F.col("_size") >= min_nodes) & (F.col("_anchors") > 0))
    rows = rows.join(scored.select(*own, "node_id", "score"), [*own, "node_id"], "left").na.fill(0.0, ["score"])
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("group_id", "component")) - 1
    return rows.select(*keys, "group_id", number.alias("unit_id"), "node_id", "score", "phi", "is_anchor")


def ranked_nodes(units: DataFrame, keys: list[str]) -> DataFrame:
    """Rank within the unit by falling score, ties by node id."""
    return units.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "unit_id").orderBy(F.desc("score"), "node_id")))


def chain_edges(units: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """Links between a unit's anchors, a < b; each is listed twice, once as found from either end."""
    a = units.where("is_anchor = 1").select(*keys, "unit_id", F.col("node_id").alias("src"))
    b = units.where("is_anchor = 1").select(*keys, "unit_id", F.col("node_id").alias("dst"))
    once = links.where("src < dst").join(a, [*keys, "src"]).join(b, [*keys, "unit_id", "dst"])
    return once.select(*keys, "unit_id", "src", "dst", "sim", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))


def compact(members: DataFrame, edges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes renumbered from 0 in order of their ids, and distinct edges under the new numbers, without self loops.

    edges: (keys, unit_id, src, dst) as unit_edges gives them, or a graph's (keys, src, dst), of which those inside a unit count.
    """
    own = [*keys, "unit_id"]
    numbered = members.select(*own, "node_id", "sig").distinct().withColumn("id", F.dense_rank().over(Window.partitionBy(*own).orderBy("node_id")) - 1)
    index = cut(numbered.select(*own, "node_id", "id").distinct())
    given = own if "unit_id" in edges.columns else keys
    out = edges.where("src <> dst").select(*given, "src", "dst")
    out = out.join(index.withColumnsRenamed({"node_id": "src", "id": "s"}), [*given, "src"]).join(index.withColumnsRenamed({"node_id": "dst", "id": "t"}), [*own, "dst"])
    # Old and new numbers go together, so repeats are dropped where the last join put them.
    return numbered, out.groupBy(*own, "dst", "s", "t").agg(F.lit(1)).select(*own, F.col("s").alias("src"), F.col("t").alias("dst"))


def attach_text(members: DataFrame, methods: DataFrame, keys: list[str], max_lines: int = 160) -> DataFrame:
    """Each member with the first max_lines lines of its method's text and whether that is all; null for externals."""
    text = methods.select(*keys, "sig", F.slice("lines", 1, max_lines).alias("text_lines"), (F.size("lines") > max_lines).alias("truncated")).dropDuplicates([*keys, "sig"])
    return members.join(text, [*keys, "sig"], "left")


def _seeded(seed: int, layer: int, inputs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A layer's fixed weights for a node's own vector and its neighbours' mean."""
    rng = np.random.Generator(np.random.PCG64([seed, layer]))
    own, near = (rng.standard_normal((inputs, width)) / math.sqrt(max(inputs, 1)) for _ in range(2))
    return own, near


def propagate(nodes: DataFrame, edges: DataFrame, keys: list[str], layers: int = 2, width: int = 32, seed: int = 7, weights: list | None = None) -> DataFrame:
    """(keys, node_id, h): mean-neighbour encoder with the given weights, else fixed seeded ones in place of trained ones.

    weights: for each layer two matrices, (inputs x outputs), for a node's own vector and its neighbours' mean.

    A layer averages the vectors of incoming neighbours and adds a second projection of the node's own; ReLU stands between layers.
    nodes: (keys, node_id, x). Averages are joins and sums; products with small matrices are column expressions, others run in Arrow batches.
    A layer's vectors are written before the next one, which reads them twice.
    """
    from .encoder import incoming_means, narrow, product

    rows = nodes.select(*keys, "node_id", F.col("x").cast("array<double>").alias("h"))
    given = None if weights is None else [tuple(np.array(m, dtype=float) for m in pair) for pair in weights]
    layers = layers if given is None else len(given)
    one = rows.select(F.size("h").alias("n")).first() if given is None else None
    size = given[0][0].shape[0] if given else one.n if one else 0
    for layer in range(layers):
        mean, inputs = incoming_means(rows, edges, keys, size), size
        size = width if given is None else given[layer][0].shape[1]
        both = rows.join(mean, [*keys, "node_id"], "left")
        last = layer == layers - 1

        def project(batches: Iterator[pd.DataFrame], layer: int = layer, last: bool = last) -> Iterator[pd.DataFrame]:
            weights: dict[int, tuple] = {}
            for pdf in batches:
                if pdf.empty:
                    continue
                h = np.stack([np.array(x, dtype=float) for x in pdf["h"]])
                if given is not None:
                    weights[h.shape[1]] = given[layer]
                elif h.shape[1] not in weights:
                    weights[h.shape[1]] = _seeded(seed, layer, h.shape[1], width)
                m = np.stack([np.zeros(h.shape[1]) if x is None else np.array(x, dtype=float) for x in pdf["m"]])
                out = h @ weights[h.shape[1]][0] + m @ weights[h.shape[1]][1]
                yield pdf.drop(columns=["h", "m"]).assign(h=list(out if last else np.maximum(out, 0)))

        own, near = given[layer] if given is not None else _seeded(seed, layer, inputs, width)
        if inputs and narrow(own, near):
            out = product(("h", own), ("m", near))
            rows = both.select(*keys, "node_id", (out if last else F.transform(out, lambda x: F.greatest(x, F.lit(0.0)))).alias("h"))
        else:
            fields = [*[f"`{c}` {t}" for c, t in rows.dtypes if c != "h"], "h array<double>"]
            rows = both.mapInPandas(project, ", ".join(fields))
        rows = rows if last else cut(rows)
    return rows


def split_edges(edges: DataFrame, keys: list[str], val_share: float = 0.1, seed: int = 7) -> DataFrame:
    """is_val marks int(edges * share) edges of each graph, drawn by a seeded hash."""
    w = Window.partitionBy(*keys)
    r = F.row_number().over(w.orderBy(F.xxhash64("src", "dst", F.lit(seed)), "src", "dst"))
    return edges.withColumn("is_val", r <= F.floor(F.count("*").over(w) * val_share))


def edge_scores(edges: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Dot product of the ends' vectors."""
    h = vectors.select(*keys, "node_id", "h")
    out = edges.join(h.withColumnsRenamed({"node_id": "src", "h": "hs"}), [*keys, "src"]).join(h.withColumnsRenamed({"node_id": "dst", "h": "hd"}), [*keys, "dst"])
    return out.select(*edges.columns, V.dot(F.col("hs"), F.col("hd")).alias("score"))


def load_weights(spark: SparkSession, path: str) -> list[list[list[list[float]]]]:
    """An encoder's weights out of a JSON file {"layers": [{"own": [[...]], "neighbours": [[...]]}]}; small by nature."""
    row = spark.read.schema("layers array<struct<own:array<array<double>>,neighbours:array<array<double>>>>").json(path, multiLine=True).first()
    return [[x["own"], x["neighbours"]] for x in row["layers"]]


def encoder_weights(spark: SparkSession, path: str, make, rebuild: bool = False) -> list:
    """The stored weights, unless they are to be made anew or aren't there: then make()'s."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stored = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return load_weights(spark, path) if stored and not rebuild else make()
