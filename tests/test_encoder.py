"""Attention layers, gradients and training against dense numpy."""

import math

import numpy as np
import pytest

from unitforge.operators import encoder, graph


def dense(nodes, edges):
    """Nodes of all graphs in one numbering, and the edges in it."""
    at = {k: i for i, k in enumerate(sorted(nodes))}
    return at, np.array([nodes[k] for k in sorted(nodes)], float), [(at[g, s], at[g, d]) for g, s, d in edges]


def planted(rng, graphs=2, n=12, width=5):
    """Two graphs of two blocks each, nodes of a block being alike and linked; one node without edges; a hub of a third of the edges."""
    nodes, edges = {}, set()
    for g in range(graphs):
        for v in range(n):
            nodes[g, v] = (np.arange(width) % 2 == v % 2) * 1.0 + rng.normal(size=width) * 0.1
        for _ in range(4 * n):
            a, b = rng.integers(0, n - 1, 2)
            if a % 2 == b % 2 and a != b:
                edges |= {(g, int(a), int(b)), (g, int(b), int(a))}
        edges |= {(g, 0, v) for v in range(2, n - 1)} | {(g, v, 0) for v in range(2, n - 1)}
    return nodes, sorted(edges)


def tables(spark, nodes, edges):
    n = spark.createDataFrame([(g, v, [float(y) for y in x]) for (g, v), x in nodes.items()], "g int, node_id int, x array<double>")
    return n, spark.createDataFrame(edges, "g int, src int, dst int")


def dense_forward(x, edges, weights):
    into = np.zeros((len(x), len(x)))
    for s, d in edges:
        into[d, s] += 1
    mean = into / np.maximum(into.sum(axis=1, keepdims=True), 1)
    steps, h = [], x
    for k, (own, near) in enumerate(weights):
        out = h @ own + mean @ h @ near
        steps.append((h, out))
        h = out if k == len(weights) - 1 else np.maximum(out, 0)
    return mean, steps, h


def dense_loss(x, edges, pairs, weights):
    z = dense_forward(x, edges, weights)[2]
    return np.mean([math.log1p(math.exp(-(z[s] @ z[d]) * (1 if y else -1))) for s, d, y in pairs])


def test_gradients_equal_a_dense_pass(spark):
    rng = np.random.default_rng(1)
    nodes, edges = planted(rng)
    at, x, own = dense(nodes, edges)
    weights = encoder.first_weights(5, 4, 3, layers=3)
    pairs = [(g, s, d, 1.0) for g, s, d in edges[::3]] + [(0, 1, 2, 0.0), (1, 3, 4, 0.0), (1, 3, 11, 0.0)]
    loss, slopes = encoder.gradients(*tables(spark, nodes, edges), spark.createDataFrame(pairs, "g int, src int, dst int, y double"), ["g"], weights)
    flat = [(at[g, s], at[g, d], y) for g, s, d, y in pairs]
    assert loss == pytest.approx(dense_loss(x, own, flat, weights))
    for k, pair in enumerate(weights):
        for side, w in enumerate(pair):
            for i in [(0, 0), (w.shape[0] - 1, w.shape[1] - 1), (1, 2)]:
                ends = []
                for step in (1e-6, -1e-6):
                    moved = [[m.copy() for m in p] for p in weights]
                    moved[k][side][i] += step
                    ends.append(dense_loss(x, own, flat, moved))
                assert slopes[k][side][i] == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-4, abs=1e-8)


def test_training_lowers_the_loss_and_weights_go_on(spark, tmp_path):
    nodes, edges = planted(np.random.default_rng(2))
    n, e = tables(spark, nodes, edges)
    weights, losses = encoder.train(n, e, ["g"], hidden=6, outputs=4, epochs=4, rate=0.05)
    assert len(losses) == 4 and losses[-1] < losses[0]
    layers = [{"own": a, "neighbours": b} for a, b in weights]
    spark.createDataFrame([(layers,)], "layers array<struct<own:array<array<double>>,neighbours:array<array<double>>>>").coalesce(1).write.json(f"{tmp_path}/w")
    again = graph.encoder_weights(spark, f"{tmp_path}/w", lambda: None)
    h = {(r.g, r.node_id): r.h for r in graph.propagate(n, e, ["g"], weights=again).collect()}
    at, x, own = dense(nodes, edges)
    z = dense_forward(x, own, [[np.array(w) for w in p] for p in weights])[2]
    assert all(h[k] == pytest.approx(z[i].tolist()) for k, i in at.items())


def test_negatives_are_no_edges(spark):
    nodes, edges = planted(np.random.default_rng(3))
    n, e = tables(spark, nodes, edges)
    got = {(r.g, r.src, r.dst) for r in encoder.negatives(e, e, n, ["g"], 5).collect()}
    assert got and not got & set(edges) and all((g, s) in nodes and (g, d) in nodes and s != d for g, s, d in got)
    full = spark.createDataFrame([(0, 0, 1), (0, 1, 0)], "g int, src int, dst int")
    assert encoder.negatives(full, full, n.where("g = 0 and node_id < 2"), ["g"], 5).count() == 0


def test_no_pairs(spark):
    n, e = tables(spark, {(0, 0): np.ones(2)}, [])
    loss, slopes = encoder.gradients(n, e, e.selectExpr("*", "1D y"), ["g"], encoder.first_weights(2, 2, 2))
    assert loss == 0 and all((w == 0).all() for p in slopes for w in p)


def test_attention_equals_a_dense_pass(spark):
    """Several heads, large scores, a hub of many edges, repeated edges, given loops and a node alone."""
    rng = np.random.default_rng(4)
    nodes, edges = planted(rng)
    edges = [*edges, edges[0], (0, 3, 3)]
    at, x, own = dense(nodes, edges)
    layers = [{"heads": [{"weight": (rng.normal(size=(5, 3)) * 40).tolist(), "src": (rng.normal(size=3) * 9).tolist(), "dst": rng.normal(size=3).tolist()} for _ in range(4)], "bias": rng.normal(size=12).tolist()}]
    layers.append({"heads": [{"weight": (rng.normal(size=(12, 2)) / 50).tolist(), "src": rng.normal(size=2).tolist(), "dst": rng.normal(size=2).tolist()}]})
    h = x
    for k, layer in enumerate(layers):
        heads = []
        for head in layer["heads"]:
            z = h @ np.array(head["weight"])
            out = np.zeros_like(z)
            for v in range(len(z)):
                near = [s for s, d in own if d == v and s != d] + [v]
                score = np.array([z[s] @ head["src"] + z[v] @ head["dst"] for s in near])
                score = np.where(score > 0, score, 0.2 * score)
                p = np.exp(score - score.max())
                out[v] = p @ z[near] / p.sum()
            heads.append(out)
        h = np.concatenate(heads, axis=1) + np.array(layer.get("bias", 0))
        h = np.maximum(h, 0) if k == 0 else h
    got = {(r.g, r.node_id): r.h for r in encoder.attend(*tables(spark, nodes, edges), ["g"], layers).collect()}
    assert set(got) == set(at) and all(got[k] == pytest.approx(h[i].tolist(), abs=1e-9) for k, i in at.items())


def test_components_summed_in_one_row(spark):
    """Vectors up to WIDE components and beyond give the same means; nulls count for nothing."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, None]), (2, [5.0, 6.0])], "k int, h array<double>")
    narrow, wide = ({r.k: r.m for r in encoder.by_component(rows, ["k"], "h", w, "m", F.avg).collect()} for w in (2, encoder.WIDE + 1))
    assert narrow == wide == {1: [2.0, 2.0], 2: [5.0, 6.0]}


def _refuse(*_):
    raise AssertionError("narrow products need no Python")


def test_narrow_layers_run_as_columns(spark):
    """Products with small matrices are column expressions, equal to those in Arrow batches."""
    nodes, edges = tables(spark, *planted(np.random.default_rng(6)))
    h = graph.propagate(nodes, edges, ["g"], width=8)
    assert "MapInPandas" not in h._jdf.queryExecution().toString()
    given = [[m.tolist() for m in graph._seeded(7, layer, n, 8)] for layer, n in ((0, 5), (1, 8))]
    _, x, own = dense(*planted(np.random.default_rng(6)))
    want = dense_forward(x, own, [[np.array(m) for m in pair] for pair in given])[2]
    got = sorted(h.collect(), key=lambda r: (r.g, r.node_id))
    assert np.array([r.h for r in got]) == pytest.approx(want)


def test_narrow_attention_runs_as_columns(spark, monkeypatch):
    """Without Python; edges to or from what is no node, whose rows no longer meet in a join at the target, are left out."""
    rng = np.random.default_rng(7)
    nodes, edges = planted(rng)
    layers = [{"heads": [{"weight": rng.normal(size=(5, 3)).tolist(), "src": rng.normal(size=3).tolist(), "dst": rng.normal(size=3).tolist()} for _ in range(2)]}]
    monkeypatch.setattr(encoder, "_mapped", _refuse)
    clean, odd = ({(r.g, r.node_id): r.h for r in encoder.attend(*tables(spark, nodes, e), ["g"], layers).collect()} for e in (edges, [*edges, (0, 1, 99), (0, 99, 1), (2, 0, 1)]))
    assert set(odd) == set(nodes) and all(odd[k] == pytest.approx(clean[k]) for k in clean)


def test_narrow_gradients_run_as_columns(spark, monkeypatch):
    """Losses and slopes of pairs are summed by node in one pass, without Python."""
    nodes, edges = planted(np.random.default_rng(8))
    at, x, own = dense(nodes, edges)
    weights = encoder.first_weights(5, 4, 3, layers=1)
    pairs = [(g, s, d, float((s + d) % 2)) for g, s, d in edges]
    monkeypatch.setattr(encoder, "_mapped", _refuse)
    loss, slopes = encoder.gradients(*tables(spark, nodes, edges), spark.createDataFrame(pairs, "g int, src int, dst int, y double"), ["g"], weights)
    assert loss == pytest.approx(dense_loss(x, own, [(at[g, s], at[g, d], y) for g, s, d, y in pairs], weights))
    assert [w.shape for w in slopes[0]] == [(5, 3), (5, 3)]


def odd_graphs(rng):
    """Graphs of two keys: small ones, one whose edges are all held out or drawn, ids with gaps and below zero, repeated edges, loops, nodes alone."""
    nodes, edges = {}, []
    for g in range(7):
        ids = [int(x) for x in rng.choice(np.arange(-5, 60 if g % 2 else 20), 14, replace=False)]
        for v in ids:
            nodes[g // 3, f"s{g}", v] = rng.normal(size=3)
        if g != 3:
            edges += [(g // 3, f"s{g}", ids[a], ids[b]) for a, b in rng.integers(0, 12, (30 if g else 1, 2))]
    return nodes, edges + edges[:9]


def test_training_by_graphs_equals_that_by_joins(spark, monkeypatch):
    """epochs over whole graphs in tasks draw the same pairs and give the same losses and weights as joins, which they don't run."""
    nodes, edges = odd_graphs(np.random.default_rng(5))
    n = spark.createDataFrame([(*k, [float(y) for y in x]) for k, x in nodes.items()], "year int, apk string, node_id int, x array<double>")
    e = spark.createDataFrame(edges, "year int, apk string, src int, dst int")
    train = lambda **k: encoder.train(n, e, ["year", "apk"], hidden=5, outputs=3, layers=3, epochs=2, rate=0.05, pos_batch=12, **k)
    want, losses = train(in_task=0)
    monkeypatch.setattr(encoder, "gradients", None)
    got, same = train()
    assert same == pytest.approx(losses) and losses[0] > 0
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert np.allclose(x, y, atol=1e-9)


@pytest.mark.parametrize("alone", [True, False])
def test_slopes_of_graphs_in_one_call(alone):
    """several graphs in one call, ends that are no nodes, and pairs that are edges or loops, against a dense pass."""
    import pandas as pd

    rng = np.random.default_rng(8)
    ids = {0: [3, 4, 9], 5: [3, 7, 8, 10]} if not alone else {0: [3, 4, 9]}
    nodes = pd.DataFrame([(g, v, *rng.normal(size=2)) for g, vs in ids.items() for v in vs], columns=["graph", "node_id", "x0", "x1"]).sample(frac=1, random_state=1)
    rows = [(0, 3, 4, 0, 2), (0, 4, 3, 0, 1), (0, 9, 9, 1, 1), (0, 3, 99, -1, -1), (1, 3, 4, -1, -1)] + ([] if alone else [(5, 7, 8, 3, 0), (5, 8, 7, -1, -1), (5, 3, 7, 2, 1)])
    links = pd.DataFrame(rows, columns=["graph", "src", "dst", "a", "b"])
    weights = encoder.first_weights(2, 4, 3, layers=2)
    got = encoder._slopes_of_graphs(weights, 2)(links, nodes)["part"].iloc[0]
    at = {k: i for i, k in enumerate(sorted((g, v) for g, vs in ids.items() for v in vs))}
    x = nodes.sort_values(["graph", "node_id"])[["x0", "x1"]].to_numpy()
    own = [(at[g, s], at[g, d]) for g, s, d, _, _ in rows if (g, s) in at and (g, d) in at]
    pairs = [(at[g, s], at[g, d], 1) for g, s, d, a, _ in rows if a >= 0]
    none = [(at[g, ids[g][a]], at[g, ids[g][b]]) for g, _, _, a, b in rows if a >= 0]
    pairs += [(a, b, 0) for a, b in none if a != b and (a, b) not in own]
    assert got[1] == len(pairs) and got[0] / got[1] == pytest.approx(dense_loss(x, own, pairs, weights))
    flat = [w for p in weights for w in p]
    assert len(got) == 2 + sum(w.size for w in flat)
    step, at_ = 1e-6, 2
    for w in flat:
        for i in np.ndindex(w.shape):
            w[i] += step
            up = dense_loss(x, own, pairs, weights)
            w[i] -= 2 * step
            down = dense_loss(x, own, pairs, weights)
            w[i] += step
            assert got[at_] / got[1] == pytest.approx((up - down) / (2 * step), rel=1e-4, abs=1e-8)
            at_ += 1


def test_training_without_nodes(spark):
    """a table without nodes has loss 0."""
    n, e = spark.createDataFrame([], "g int, node_id int, x array<double>"), spark.createDataFrame([], "g int, src int, dst int")
    assert encoder.train(n, e, ["g"], hidden=2, outputs=2, epochs=2)[1] == [0.0, 0.0]
