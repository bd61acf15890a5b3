"""Graph encoders as Spark jobs: mean and attention layers over node and edge tables, and their training by link prediction.

Messages go from an edge's src to its dst. Neighbours meet through joins and sums over (graph, node); matrix products run in Arrow
batches; weights are a few small matrices that the driver holds. A node with very many edges is summed map-side first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .lineage import Kept

#: Slope of the attention's leaky rectifier below zero (fixed value).
SLOPE = 0.2
#: Vectors of more components are summed in rows of one component.
WIDE = 64


def _matrix(column: pd.Series, width: int | None = None) -> np.ndarray:
    """Rows of arrays as a matrix; null rows are zeros of that width."""
    if width is None:
        return np.stack([np.asarray(x, dtype=float) for x in column])
    return np.stack([np.zeros(width) if x is None else np.asarray(x, dtype=float) for x in column])


def _mapped(df: DataFrame, drop: list[str], add: dict[str, str], f: Callable[[pd.DataFrame], dict[str, list]]) -> DataFrame:
    """df without some columns and with those that f makes out of each batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.drop(columns=drop).assign(**f(pdf))

    fields = [*[f"`{c}` {t}" for c, t in df.dtypes if c not in drop], *[f"`{c}` {t}" for c, t in add.items()]]
    return df.mapInPandas(run, ", ".join(fields))


def narrow(*matrices: np.ndarray) -> bool:
    """Are products with these matrices short enough for column expressions? Others run in Arrow batches."""
    return all(m.size <= 512 and bool(np.isfinite(m).all()) for m in matrices)


def product(*terms: tuple[str, np.ndarray]) -> Column:
    """Sum of array columns times matrices of doubles, as an array of doubles; a null array counts as zeros."""
    part = lambda c, i, w: f"coalesce(get({c}, {i}), 0D) * ({float(w)!r}D)"
    outputs = terms[0][1].shape[1]
    return F.expr("array(" + ", ".join(" + ".join(part(c, i, m[i, j]) for c, m in terms for i in range(len(m))) for j in range(outputs)) + ")")


def _ordered(parts: DataFrame, by: list[str], out: str) -> DataFrame:
    """(by, i, v) rows back into arrays ordered by i: one row a component, so an array is as long as a vector."""
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias(out))


def by_component(rows: DataFrame, by: list[str], vector: str, width: int, out: str, agg: Callable[[Column], Column] = F.sum) -> DataFrame:
    """(by, out): the arrays' components aggregated one by one, in one row a group; arrays over WIDE components go by rows (by, i)."""
    if width > WIDE:
        parts = rows.select(*by, F.posexplode(vector).alias("i", "v")).groupBy(*by, "i").agg(agg(F.col("v")).alias("v"))
        return _ordered(parts, by, out)
    sums = rows.groupBy(*by).agg(*[agg(F.get(vector, i)).alias(f"_v{i}") for i in range(width)])
    return sums.select(*by, F.array(*[f"_v{i}" for i in range(width)]).alias(out))


def incoming_means(rows: DataFrame, edges: DataFrame, keys: list[str], width: int, vector: str = "h", out: str = "m") -> DataFrame:
    """(keys, node_id, out): mean vector of the sources of each node's incoming edges; nodes without any are absent.

    Vectors under WIDE components have one count a node; a null component beside others counts as zero there.
    """
    at = edges.select(*keys, F.col("src").alias("node_id"), F.col("dst").alias("to"))
    met = rows.select(*keys, "node_id", vector).join(at, [*keys, "node_id"]).select(*keys, F.col("to").alias("node_id"), vector)
    if width >= WIDE:
        return by_component(met, [*keys, "node_id"], vector, width, out, F.avg)
    counted = by_component(met.withColumn(vector, F.concat(vector, F.array(F.lit(1.0)))), [*keys, "node_id"], vector, width + 1, out)  # one count a node, not one a component
    return counted.withColumn(out, F.transform(F.slice(out, 1, width), lambda x: x / F.get(out, width)))


def attention_layer(rows: DataFrame, edges: DataFrame, keys: list[str], heads: list[dict], relu: bool, bias: list[float] | None = None) -> DataFrame:
    """(keys, node_id, h): one attention layer; the heads' outputs stand one after the other.

    heads: for each one {"weight": inputs x width, "src": width, "dst": width}. With z = h @ weight, an edge's score is the leaky rectifier of
    src . z[source] + dst . z[target]; a node's weights are the softmax of the scores of its incoming edges and of a loop to itself, which it
    gets once whether the graph has it or not. The softmax takes the largest score off before the exponentials. Repeated edges count each.
    """
    w = np.concatenate([np.asarray(x["weight"], float) for x in heads], axis=1)
    width = np.asarray(heads[0]["weight"], float).shape[1]
    side = [np.stack([np.asarray(x[c], float) for x in heads]) for c in ("src", "dst")]

    def project(pdf: pd.DataFrame) -> dict[str, list]:
        z = _matrix(pdf["h"]) @ w
        parts = z.reshape(len(z), len(heads), width)
        return {"z": list(z), "a": list((parts * side[0]).sum(axis=2)), "b": list((parts * side[1]).sum(axis=2))}

    own = rows.select(*keys, "node_id", "h")
    if narrow(w):
        sums = [np.zeros((len(heads) * width, len(heads))) for _ in side]
        for c, m in enumerate(sums):
            for k in range(len(heads)):
                m[k * width : (k + 1) * width, k] = side[c][k]
        z = own.withColumn("z", product(("h", w))).drop("h").withColumns({"a": product(("z", sums[0])), "b": product(("z", sums[1]))})
    else:
        z = _mapped(own, ["h"], {"z": "array<double>", "a": "array<double>", "b": "array<double>"}, project)
    with Kept(rows.sparkSession, "attention") as kept:
        z = kept(z)
        # Messages and each node's own row, which brings its b and is its loop, meet once at the target: scores, their maximum and the sums need no more shuffles.
        sent = edges.where("src <> dst").select(*keys, "src", "dst").join(z.select(*keys, F.col("node_id").alias("src"), "a", "z"), [*keys, "src"])
        sent = sent.select(*keys, F.col("dst").alias("node_id"), "a", "z", F.lit(None).cast("array<double>").alias("b")).union(z.select(*keys, "node_id", "a", "z", "b"))
        at, each = Window.partitionBy(*keys, "node_id"), range(len(heads))
        met = sent.repartition(*keys, "node_id").withColumns({f"b{k}": F.max(F.get("b", k)).over(at) for k in each}).where("b0 is not null")
        scores = {f"e{k}": F.get("a", k) + F.col(f"b{k}") for k in each}
        met = met.withColumns(scores).withColumns({f"e{k}": F.when(F.col(f"e{k}") > 0, F.col(f"e{k}")).otherwise(SLOPE * F.col(f"e{k}")) for k in each})
        met = met.withColumns({f"top{k}": F.max(f"e{k}").over(at) for k in each}).withColumn("p", F.array(*[F.exp(F.col(f"e{k}") - F.col(f"top{k}")) for k in each]))
        weighed = lambda k: F.transform(F.slice("z", k * width + 1, width), lambda v: v * F.get("p", k))
        share = F.concat(*[weighed(k) for k in range(len(heads))])
        both = by_component(met.select(*keys, "node_id", F.concat(share, "p").alias("x")), [*keys, "node_id"], "x", len(heads) * (width + 1), "x")
        whole = F.transform(F.slice("x", 1, len(heads) * width), lambda v, i: v / F.get("x", F.lit(len(heads) * width) + F.floor(i / width).cast("int")))
        out = both.select(*keys, "node_id", whole.alias("h"))
        if bias is not None:
            out = out.withColumn("h", F.zip_with("h", F.lit([float(x) for x in bias]), lambda x, y: x + y))
        if relu:
            out = out.withColumn("h", F.transform("h", lambda x: F.greatest(x, F.lit(0.0))))
        return kept.last(out)


def attend(nodes: DataFrame, edges: DataFrame, keys: list[str], layers: list[dict]) -> DataFrame:
    """(keys, node_id, h) after all attention layers, ReLU between them. layers: [{"heads": [...], "bias": [...] or absent}]."""
    rows = nodes.select(*keys, "node_id", F.col("x").cast("array<double>").alias("h"))
    for k, layer in enumerate(layers):
        rows = attention_layer(rows, edges, keys, layer["heads"], k < len(layers) - 1, layer.get("bias"))
    return rows


# --- link prediction -------------------------------------------------------------------------------------------------


def first_weights(inputs: int, hidden: int, outputs: int, layers: int = 2, seed: int = 7) -> list[list[np.ndarray]]:
    """Seeded start weights [own, neighbours] of each mean layer, uniform within 1 / sqrt(inputs)."""
    rng, sizes = np.random.Generator(np.random.PCG64(seed)), [inputs, *[hidden] * (layers - 1), outputs]
    return [[rng.uniform(-1, 1, (a, b)) / math.sqrt(a) for _ in range(2)] for a, b in zip(sizes, sizes[1:], strict=False)]


def _draw(seed: int, n: Column, *more: int) -> Column:
    return F.pmod(F.xxhash64("src", "dst", F.lit(seed), *[F.lit(x) for x in more]), n)


def negatives(positives: DataFrame, edges: DataFrame, nodes: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """(keys, src, dst): a pair of nodes of the same graph for each positive edge, drawn by a seeded hash, if it is neither an edge nor a loop.

    Nodes are numbered within ranges of their ids, so drawing one is a join on its number. A pair that is an edge is left out, as
    are all of a graph whose nodes are all linked.
    """
    numbered = nodes.select(*keys, "node_id").withColumn("n", F.row_number().over(_by(keys).orderBy("node_id")) - 1)
    sizes = numbered.groupBy(*keys).agg(F.count("*").alias("size"))
    drawn = positives.join(sizes, keys).select(*keys, _draw(seed, F.col("size"), 1).alias("a"), _draw(seed, F.col("size"), 2).alias("b"))
    pairs = drawn.join(numbered.select(*keys, F.col("n").alias("a"), F.col("node_id").alias("src")), [*keys, "a"]).join(numbered.select(*keys, F.col("n").alias("b"), F.col("node_id").alias("dst")), [*keys, "b"])
    return pairs.where("src <> dst").select(*keys, "src", "dst").join(edges.select(*keys, "src", "dst").distinct(), [*keys, "src", "dst"], "left_anti")


def _by(keys: list[str]):
    return Window.partitionBy(*keys)


def forward(nodes: DataFrame, edges: DataFrame, keys: list[str], weights: list, kept: Kept) -> list[DataFrame]:
    """Tables (keys, node_id, h, m) of each layer's input and the last layer's output, all kept."""
    rows = kept(nodes.select(*keys, "node_id", F.col("x").cast("array<double>").alias("h")))
    tables = []
    for k, (own, near) in enumerate(weights):
        last = k == len(weights) - 1
        both = kept(rows.join(incoming_means(rows, edges, keys, len(own)), [*keys, "node_id"], "left"))
        tables.append(both)

        def project(pdf: pd.DataFrame, own=own, near=near, last=last) -> dict[str, list]:
            out = _matrix(pdf["h"]) @ own + _matrix(pdf["m"], len(near)) @ near
            return {"h": list(out if last else np.maximum(out, 0))}

        if narrow(own, near):
            out = product(("h", own), ("m", near))
            rows = kept(both.select(*keys, "node_id", (out if last else F.transform(out, lambda x: F.greatest(x, F.lit(0.0)))).alias("h")))
        else:
            rows = kept(_mapped(both, ["h", "m"], {"h": "array<double>"}, project))
    return [*tables, rows]


def _summed(parts: DataFrame) -> np.ndarray:
    """Sums of arrays of one length over all rows: as many numbers as a layer has weights, plus the loss and the number of pairs."""
    rows = parts.select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(max((r.i for r in rows), default=-1) + 1)
    for r in rows:
        out[r.i] = r.v
    return out


def gradients(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, keys: list[str], weights: list) -> tuple[float, list]:
    """(loss, gradients) of the mean binary cross-entropy of all pairs (keys, src, dst, y) under the mean encoder's dot products.

    The way back mirrors the way there: a pair's error goes to both ends, a node's to its own vector and, shared out by the number of
    edges into it, to the sources of these. What is summed over all nodes is a matrix for each weight, first within Arrow batches. A table
    without pairs has loss 0 and no slope.
    """
    edges = edges.select(*keys, "src", "dst")
    with Kept(nodes.sparkSession, "training") as kept:
        *tables, z = forward(nodes, edges, keys, weights, kept)
        ends = pairs.join(z.select(*keys, F.col("node_id").alias("src"), F.col("h").alias("s")), [*keys, "src"]).join(z.select(*keys, F.col("node_id").alias("dst"), F.col("h").alias("d")), [*keys, "dst"])

        x, width = F.col("_x"), weights[-1][0].shape[1]
        loss = F.greatest(x, F.lit(0.0)) - x * F.col("y") + F.log1p(F.exp(-F.abs(x)))
        ends = ends.withColumn("_x", V.dot(F.col("s"), F.col("d"))).withColumns({"_loss": loss, "_slope": 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-700.0)), F.lit(700.0)))) - F.col("y")})
        slope = lambda c: F.transform(c, lambda v: v * F.col("_slope"))
        # A pair goes to both ends in one pass; its loss and the number of pairs travel with the first.
        sides = [F.struct(F.col(n).alias("node_id"), F.concat(slope(c), F.array(*more)).alias("v")) for n, c, more in (("src", "d", [F.col("_loss"), F.lit(1.0)]), ("dst", "s", [F.lit(0.0), F.lit(0.0)]))]
        summed = kept(by_component(ends.select(*keys, F.inline(F.array(*sides))), [*keys, "node_id"], "v", width + 2, "v"))
        total, n = summed.agg(F.sum(F.get("v", width)), F.sum(F.get("v", width + 1))).first()
        slopes = [[np.zeros_like(w) for w in pair] for pair in weights]
        if not n:
            return 0.0, slopes
        back = summed.select(*keys, "node_id", F.transform(F.slice("v", 1, width), lambda v: v / n).alias("grad"))
        into = edges.groupBy(*keys, "dst").agg(F.count("*").alias("deg"))
        for k in range(len(weights) - 1, -1, -1):
            own, near = weights[k]
            both = kept(tables[k].join(back, [*keys, "node_id"]))

            def outer(batches: Iterator[pd.DataFrame], size: int = len(near)) -> Iterator[pd.DataFrame]:
                part = None
                for pdf in batches:
                    if len(pdf):
                        g = _matrix(pdf["grad"])
                        now = np.concatenate([(_matrix(pdf["h"]).T @ g).ravel(), (_matrix(pdf["m"], size).T @ g).ravel()])
                        part = now if part is None else part + now
                if part is not None:
                    yield pd.DataFrame({"part": [part]})

            both_sums = _summed(both.select("h", "m", "grad").mapInPandas(outer, "part array<double>"))
            if len(both_sums):
                slopes[k] = [both_sums[: own.size].reshape(own.shape), both_sums[own.size :].reshape(near.shape)]
            if k:

                def down(pdf: pd.DataFrame, own=own, near=near) -> dict[str, list]:
                    g = _matrix(pdf["grad"])
                    return {"own": list(g @ own.T), "near": list(g @ near.T)}

                sent = kept(_mapped(both.select(*keys, "node_id", "grad"), ["grad"], {"own": "array<double>", "near": "array<double>"}, down))
                shared = sent.select(*keys, F.col("node_id").alias("dst"), "near").join(into, [*keys, "dst"]).join(edges, [*keys, "dst"])
                shared = shared.select(*keys, F.col("src").alias("node_id"), F.transform("near", lambda x: x / F.col("deg")).alias("part"))
                every = by_component(shared.union(sent.select(*keys, "node_id", "own")), [*keys, "node_id"], "part", len(own), "grad")
                passed = every.join(tables[k].select(*keys, "node_id", "h"), [*keys, "node_id"])
                back = kept(passed.select(*keys, "node_id", F.zip_with("grad", "h", lambda g, h: F.when(h > 0, g).otherwise(F.lit(0.0))).alias("grad")))
        return total / n, slopes


def _rows_of(graph: np.ndarray, node: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """(graphs, nodes) -> their rows among the given ones, which are sorted by both; -1 where there is none."""
    graphs, ids = np.unique(graph), np.unique(node)

    def among(values: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dense = int(given[-1]) - int(given[0]) == len(given) - 1
        i = values.astype(np.int64) - given[0] if dense else np.searchsorted(given, values)
        i = np.clip(i, 0, len(given) - 1)
        return i, given[i] == values

    code = among(graph, graphs)[0] * len(ids) + among(node, ids)[0]

    def find(g: np.ndarray, x: np.ndarray) -> np.ndarray:
        (i, known), (j, there) = among(g, graphs), among(x, ids)
        k, held = among(i * len(ids) + j, code)
        return np.where(known & there & held, k, -1)

    return find


def _slopes_of_graphs(weights: list, inputs: int):
    """One row: the summed loss, the number of pairs, and the slopes of all weights, over some whole graphs.

    links: (graph, src, dst, a, b), a and b being the numbers of a drawn edge's pair that is to be no edge, else -1. nodes: (graph, node_id, x0, x1, ...).
    What gradients does by joins is done here on arrays with a row a component.
    """

    def run(links: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        if links.empty or nodes.empty:
            return pd.DataFrame({"part": []})
        nodes = nodes.sort_values(["graph", "node_id"], kind="stable")
        owner, rows, g = nodes["graph"].to_numpy(), len(nodes), links["graph"].to_numpy()
        find = _rows_of(owner, nodes["node_id"].to_numpy())
        src, dst = (find(g, links[c].to_numpy()) for c in ("src", "dst"))
        there, drawn = (src >= 0) & (dst >= 0), links["a"].to_numpy() >= 0
        first = np.searchsorted(owner, g[drawn])
        none = [first + links[c].to_numpy()[drawn] for c in ("a", "b")]
        real = [x[drawn & there] for x in (src, dst)]
        src, dst = src[there], dst[there]
        code, held = np.sort(src * rows + dst), none[0] * rows + none[1]
        at = np.searchsorted(code, held)
        free = (none[0] != none[1]) & (code[np.minimum(at, len(code) - 1)] != held if len(code) else True)
        del code
        p, q = (np.concatenate([x, y[free]]) for x, y in zip(real, none, strict=True))
        y = np.repeat([1.0, 0.0], [len(real[0]), free.sum()])
        deg = np.maximum(np.bincount(dst, minlength=rows), 1)
        gathered = lambda to, values, at: np.bincount(to, values[at], rows)
        h, m = [np.stack([nodes[f"x{i}"].to_numpy(float) for i in range(inputs)])], []
        for k, (own, near) in enumerate(weights):
            m.append(np.stack([gathered(dst, v, src) / deg for v in h[k]]))
            out = own.T @ h[k] + near.T @ m[k]
            h.append(out if k == len(weights) - 1 else np.maximum(out, 0))
        z = h[-1]
        x = sum(v[p] * v[q] for v in z)
        loss = np.maximum(x, 0) - x * y + np.log1p(np.exp(-np.abs(x)))
        slope = 1 / (1 + np.exp(-np.clip(x, -700, 700))) - y
        back = np.stack([np.bincount(p, slope * v[q], rows) + np.bincount(q, slope * v[p], rows) for v in z])
        parts = []
        for k in range(len(weights) - 1, -1, -1):
            own, near = weights[k]
            parts = [(h[k] @ back.T).ravel(), (m[k] @ back.T).ravel(), *parts]
            if k:
                shared = near @ back / deg
                back = np.where(h[k] > 0, own @ back + np.stack([gathered(src, v, dst) for v in shared]), 0)
        return pd.DataFrame({"part": [np.concatenate([[loss.sum(), float(len(x))], *parts])]})

    return run


def _step_by_graphs(kept: Kept, nodes: DataFrame, split: DataFrame, sizes: DataFrame, links: int, inputs: int, keys: list[str], pos_batch: int, seed: int) -> Callable[[int, list], tuple[float, list]]:
    """(epoch, weights) -> (loss, gradients): whole graphs in a task each, small ones together; an epoch is one shuffle of nodes and edges.

    sizes: (keys, size, links, all), a graph's numbers of nodes, of edges and of those to draw from.
    """
    parts = max(1, -(-links // 1_000_000))
    alone = F.when(F.col("links") > 500_000, -1 - F.col("graph"))
    graphs = kept(sizes.withColumn("graph", F.monotonically_increasing_id()).withColumn("at", F.coalesce(alone, F.pmod(F.xxhash64(*keys), F.lit(parts)))).drop("links"))
    x = [F.coalesce(F.get(F.col("x").cast("array<double>"), i), F.lit(0.0)).alias(f"x{i}") for i in range(inputs)]
    nodes = kept(nodes.join(graphs, keys).select("at", "graph", "node_id", *x))
    split = kept(split.join(graphs, keys).select("at", "graph", "src", "dst", "is_val", "size", "all"))

    def step(epoch: int, weights: list) -> tuple[float, list]:
        of = seed * 1_000_003 + epoch
        drawn = ~F.col("is_val") & (_draw(seed, F.lit(1 << 30), epoch) < F.lit(pos_batch) / F.col("all") * (1 << 30))
        pair = [F.when(drawn, _draw(of, F.col("size"), n)).otherwise(-1).cast("int").alias(c) for n, c in ((1, "a"), (2, "b"))]
        sides = [df.repartition(min(4 * parts, 2000), "at").groupBy("at") for df in (split.select("at", "graph", "src", "dst", *pair), nodes)]
        met = sides[0].cogroup(sides[1])
        sums = _summed(kept(met.applyInPandas(_slopes_of_graphs(weights, inputs), "part array<double>")))  # written, so its shuffle files go
        if len(sums) == 0 or not sums[1]:
            return 0.0, [[np.zeros_like(w) for w in pair] for pair in weights]
        flat, slopes = sums[2:] / sums[1], []
        for pair in weights:
            slopes.append([])
            for w in pair:
                slopes[-1].append(flat[: w.size].reshape(w.shape))
                flat = flat[w.size :]
        return float(sums[0] / sums[1]), slopes

    return step


def _step_by_joins(kept: Kept, nodes: DataFrame, edges: DataFrame, split: DataFrame, keys: list[str], pos_batch: int, seed: int) -> Callable[[int, list], tuple[float, list]]:
    """(epoch, weights) -> (loss, gradients): neighbours meet through joins, for graphs of any size."""
    chosen = kept(split.where("not is_val").drop("is_val"))
    sizes = chosen.groupBy(*keys).agg(F.count("*").alias("all"))

    def step(epoch: int, weights: list) -> tuple[float, list]:
        drawn = chosen.join(sizes, keys).where(_draw(seed, F.lit(1 << 30), epoch) < F.lit(pos_batch) / F.col("all") * (1 << 30)).drop("all")
        none = negatives(drawn, edges, nodes, keys, seed * 1_000_003 + epoch)
        pairs = kept(drawn.withColumn("y", F.lit(1.0)).union(none.withColumn("y", F.lit(0.0))))
        return gradients(nodes, edges, pairs, keys, weights)

    return step


def train(nodes: DataFrame, edges: DataFrame, keys: list[str], hidden: int = 128, outputs: int = 64, layers: int = 2, epochs: int = 3, rate: float = 1e-3, decay: float = 1e-5, val_share: float = 0.1, pos_batch: int = 100_000, seed: int = 7, in_task: int = 80_000_000) -> tuple[list, list[float]]:
    """(weights, losses): the mean encoder trained to tell edges from pairs that are none, one Adam step an epoch over all graphs.

    A hashed val_share of each graph's edges is held out of the positives; of more than pos_batch the hash draws about so many a graph, anew
    each epoch, as it does the negatives. Messages run over all edges. nodes: (keys, node_id, x). weights go into graph.propagate and, by
    writers.write_json in the form of graph.load_weights, to a file.

    A graph stays in one task while none, counted by its nodes and edges, takes more than in_task numbers of eight bytes there; beyond that, and with ids that are no
    whole numbers, an epoch is joins over all edges. Either way the pairs and sums are the same.
    """
    from .graph import split_edges

    edges = edges.select(*keys, "src", "dst")
    sample = nodes.select(F.size("x").alias("n")).first()
    inputs = max(sample.n, 0) if sample else 0
    weights = first_weights(inputs, hidden, outputs, layers, seed)
    flat = [w for pair in weights for w in pair]
    mean, square, losses = [np.zeros_like(w) for w in flat], [np.zeros_like(w) for w in flat], []
    with Kept(nodes.sparkSession, "epochs") as kept:
        split = split_edges(edges, keys, val_share, seed)
        sizes = kept(nodes.groupBy(*keys).agg(F.count("*").alias("size")).join(edges.groupBy(*keys).agg(F.count("*").alias("links")), keys))
        width = 2 * sum(len(own) for own, _ in weights) + 3 * max([hidden, outputs]) + outputs  # numbers of a node: inputs and means of layers, outputs, slopes
        most, links = sizes.agg(F.max(F.col("size") * width + F.col("links") * 8), F.sum("links")).first()
        whole = all(t in ("int", "bigint", "smallint", "tinyint") for t in (dict(nodes.dtypes)["node_id"], *(dict(edges.dtypes)[c] for c in ("src", "dst"))))
        if not inputs:  # no nodes, or such without features
            step = lambda epoch, weights: (0.0, [[np.zeros_like(w) for w in pair] for pair in weights])
        elif most and most <= in_task and whole:
            sizes = sizes.select(*keys, "size", "links", (F.col("links") - F.floor(F.col("links") * val_share)).alias("all"))
            step = _step_by_graphs(kept, nodes, split, sizes, links, inputs, keys, pos_batch, seed)
        else:
            step = _step_by_joins(kept, nodes, edges, split, keys, pos_batch, seed)
        for epoch in range(epochs):
            loss, slopes = step(epoch, weights)
            losses.append(loss)
            for i, (w, g) in enumerate(zip(flat, [g for pair in slopes for g in pair], strict=True)):
                g = g + decay * w
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                w -= rate * (mean[i] / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(square[i] / (1 - 0.999 ** (epoch + 1))) + 1e-8)
    return [[w.tolist() for w in pair] for pair in weights], losses
