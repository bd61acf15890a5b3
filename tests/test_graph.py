import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from unitforge.operators import graph as G
from unitforge.plans import queries

K = ["g"]


def bag(edges):
    adj = defaultdict(list)
    for u, v in edges:
        adj[u].append(v)
        if u != v:
            adj[v].append(u)
    return adj


def random_graph(seed, n=14, m=30):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)], {i: rng.random() for i in range(n)}, sorted(rng.sample(range(n), 2))


def frame(spark, rows, fields):
    return spark.createDataFrame(rows, fields)


def sweep(adj, cand, score, anchors, least, most):
    """Straight from the rule: enter one by one, keep the first best prefix."""
    order = sorted(anchors) + sorted((u for u in cand if u not in anchors), key=lambda u: (-score[u], u))
    inside = lambda s: sum(v in cand for u in s for v in adj[u])
    total, best = inside(cand), None
    for k in range(max(least, len(anchors)), min(most, len(order)) + 1):
        s = order[:k]
        now, cut = set(), 0
        for u in s:
            now.add(u)
            cut += sum((-1 if v in now else 1) for v in adj[u] if v in cand)
        phi = cut / max(1, min(inside(s), max(total - inside(s), 1)))
        if best is None or phi < best[0]:
            best = (phi, s)
    return best or (G.NO_CUT, order[: max(least, len(anchors))])


@pytest.mark.parametrize("least", [3, 40])
def test_sweep(spark, least):
    graphs = {i: random_graph(i) for i in range(6)}
    edges = frame(spark, [(g, u, v) for g, (es, _, _) in graphs.items() for u, v in es], "g int, src int, dst int")
    cand = frame(spark, [(g, i, s) for g, (_, score, _) in graphs.items() for i, s in score.items()], "g int, node_id int, score double")
    anchors = frame(spark, [(g, a) for g, (_, _, an) in graphs.items() for a in an], "g int, node_id int")
    got = defaultdict(set)
    phi = {}
    for r in G.sweep_cut(G.adjacency(edges, K), cand, anchors, K, min_nodes=least, max_nodes=10).collect():
        got[r["g"]].add(r["node_id"])
        phi[r["g"]] = r["phi"]
    for g, (es, score, an) in graphs.items():
        want, nodes = sweep(bag(es), set(score), score, an, least, 10)
        assert got[g] == set(nodes) and phi[g] == pytest.approx(want)


def test_ppr(spark):
    graphs = {i: random_graph(20 + i) for i in range(4)}
    edges = frame(spark, [(g, u, v) for g, (es, _, _) in graphs.items() for u, v in es], "g int, src int, dst int")
    seeds = frame(spark, [(g, a) for g, (_, _, an) in graphs.items() for a in an], "g int, node_id int")
    mask = frame(spark, [(g, i) for g, (_, score, _) in graphs.items() for i in score if i % 5 or i in graphs[g][2]], "g int, node_id int")
    adj = G.adjacency(edges, K)
    for within in (None, mask):
        a = {(r["g"], r["node_id"]): r["ppr"] for r in G.ppr(adj, seeds, K, iterations=6, mask=within).collect()}
        b = {(r["g"], r["node_id"]): r["ppr"] for r in G.ppr_per_graph(adj, seeds, K, iterations=6, mask=within).collect()}
        for g, (es, score, an) in graphs.items():
            near, s = bag(es), {u: 1 / len(an) for u in an}
            allowed = set(score) if within is None else {i for i in score if i % 5 or i in an}
            p = dict(s)
            for _ in range(6):
                new = defaultdict(float, {u: 0.15 * x for u, x in s.items()})
                for u, x in p.items():
                    vs = [v for v in near[u] if v in allowed]
                    for v in vs:
                        new[v] += 0.85 * x / len(vs)
                p = new
            for u, x in p.items():
                assert a.get((g, u), 0) == pytest.approx(x) and b.get((g, u), 0) == pytest.approx(x)
            assert sum(p.values()) <= 1 + 1e-9


@pytest.mark.parametrize("name", ["ppr_ranks", "ppr_grouped_ranks"])
def test_ppr_queries(spark, monkeypatch, name):
    """Every reached node after 25 rounds, though with 300 seeds most ranks are under 0.004."""
    rng = random.Random(6)
    es = sorted({(rng.randrange(400), rng.randrange(400)) for _ in range(900)})
    nodes = frame(spark, [(1, i, int(i < 300)) for i in range(400)], "g int, node_id int, is_sensitive int")
    monkeypatch.setattr(queries, "_graph", lambda *_: (nodes, frame(spark, [(1, u, v) for u, v in es], "g int, src int, dst int")))
    near, s = bag(es), {u: 1 / 300 for u in range(300)}
    p = dict(s)
    for _ in range(25):
        new = defaultdict(float, {u: 0.15 * x for u, x in s.items()})
        for u, x in p.items():
            for v in near[u]:
                new[v] += 0.85 * x / len(near[u])
        p = new
    got = {r["node_id"]: r["ppr"] for r in queries.QUERIES[name](spark, "").collect()}
    assert got == pytest.approx({u: x for u, x in p.items() if x > 0})


def test_build_and_mine(spark):
    methods = frame(spark, [(1, f"m{i}", i) for i in range(6)] + [(1, "m0", 9)], "g int, sig string, ord int")
    calls = frame(spark, [(1, "m0", "api"), (1, "m0", "m1"), (1, "m0", "m1"), (1, "m1", "m2"), (1, "m2", "log"), (1, "m3", "m3"), (1, "ghost", "m1")], "g int, caller string, callee string")
    perms = frame(spark, [("api", ["P2", "P1"]), ("m1", ["X"])], "api_sig string, perms array<string>")
    nodes = G.build_nodes(methods, calls, perms, K)
    rows = {r["node_id"]: r for r in nodes.collect()}
    assert [rows[i]["sig"] for i in range(9)] == ["m0", "m1", "m2", "m3", "m4", "m5", "m0", "api", "log"]
    assert rows[7]["is_sensitive"] == 1 and rows[7]["perms"] == ["P1", "P2"] and rows[1]["is_sensitive"] == 0
    edges = G.build_edges(nodes, calls, K)
    got = {(r["src"], r["dst"]): r["is_fwd"] for r in edges.collect()}
    assert got == {(6, 7): True, (7, 6): False, (6, 1): True, (1, 6): False, (1, 2): True, (2, 1): False, (2, 8): True, (8, 2): False, (3, 3): True}
    meta = G.graph_meta(nodes, edges, K).first()
    assert (meta["num_nodes"], meta["num_internal"], meta["num_sensitive"], meta["num_edges"], meta["num_edges_fwd"]) == (9, 7, 1, 9, 5)
    adj = {(r["src"], r["dst"]): r["mult"] for r in G.adjacency(edges, K).collect()}
    assert adj[(6, 7)] == 2 and adj[(3, 3)] == 1
    h = nodes.select("g", "node_id", F.array(F.lit(1.0), F.col("node_id").cast("double")).alias("h"))
    units = G.mine_units(nodes, edges, h, K, min_nodes=3, max_nodes=5).collect()
    assert {r["node_id"] for r in units} >= {7, 6, 1} and {r["unit_id"] for r in units} == {0} and sum(r["is_anchor"] for r in units) == 1
    numbered, links = G.compact(spark.createDataFrame([(1, 0, 7, "api"), (1, 0, 2, "m2"), (1, 0, 5, "z")], "g int, unit_id int, node_id int, sig string"), spark.createDataFrame([(1, 0, 7, 2), (1, 0, 7, 7), (1, 0, 7, 2)], "g int, unit_id int, src int, dst int"), K)
    assert {r["node_id"]: r["id"] for r in numbered.collect()} == {2: 0, 5: 1, 7: 2} and [(r["src"], r["dst"]) for r in links.collect()] == [(2, 0)]


def test_khop_and_components(spark):
    edges = frame(spark, [(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 4, 5), (2, 0, 1)], "g int, src int, dst int")
    adj = G.adjacency(edges, K)
    got = {(r["g"], r["node_id"]): r["dist"] for r in G.khop(adj, frame(spark, [(1, 0), (2, 1)], "g int, node_id int"), 2, K).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (2, 1): 0, (2, 0): 1}
    nodes = frame(spark, [(1, i) for i in (0, 1, 3, 4, 5)], "g int, node_id int")
    part = {r["node_id"]: r["component"] for r in G.components(nodes, adj, K).collect()}
    assert part == {0: 0, 1: 0, 3: 3, 4: 4, 5: 4}


@pytest.mark.parametrize("in_task", [0, 10**6])
def test_components_of_any_size(spark, in_task):
    """A path of 100,000 nodes in random order, a hub of 5,000, equal ids in another graph, nodes alone, links to nodes that are left out."""
    rng = random.Random(6)
    order = rng.sample(range(100_000), 100_000)
    links = [("p", a, b) for a, b in zip(order, order[1:], strict=False)] + [("h", 7, i) for i in range(8, 5_008)] + [("q", 1, 2), ("q", 2, 9), ("q", 4, 5)]
    nodes = [("p", i) for i in order] + [("h", i) for i in range(7, 5_008)] + [("q", i) for i in range(6)]
    n, e = spark.createDataFrame(nodes, "k string, node_id int"), spark.createDataFrame(links, "k string, src int, dst int")
    got = {(r.k, r.node_id): r.component for r in G.components(n, e, ["k"], in_task).collect()}
    assert got == {**{("p", i): 0 for i in order}, **{("h", i): 7 for i in range(7, 5_008)}, ("q", 0): 0, ("q", 1): 1, ("q", 2): 1, ("q", 3): 3, ("q", 4): 4, ("q", 5): 4}


def test_last_hop_lands_on_ends(spark):
    """What the last hop reaches besides the ends is not made; shared vectors give the same links as a vector a node."""
    edges = frame(spark, [(1, 0, i) for i in range(1, 9)] + [(1, 9, 8), (1, 9, 9)], "g int, src int, dst int")
    adj = G.adjacency(edges, K)
    got = {(r["node_id"], r["dist"]) for r in G.khop(adj, frame(spark, [(1, 1)], "g int, node_id int"), 2, K, ends=frame(spark, [(1, 3), (1, 8)], "g int, node_id int")).collect()}
    assert got == {(1, 0), (0, 1), (3, 2), (8, 2)}
    nodes = frame(spark, [(1, i, int(i in (1, 3, 8))) for i in range(10)], "g int, node_id int, is_sensitive int")
    table = frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, h array<double>")
    index = nodes.select("g", "node_id", (F.col("node_id") % 2).cast("long").alias("vec_id"))
    plain = index.join(table, "vec_id").drop("vec_id")
    a, b = ({(r["src"], r["dst"]): round(r["sim"], 9) for r in G.anchor_links(adj, nodes, v, K, 2, 0.1).collect()} for v in (plain, (index, table)))
    assert a == b and set(a) == {(x, y) for x in (1, 3, 8) for y in (1, 3, 8) if x != y}


def test_small_graphs_share_a_call_and_large_ones_are_sliced(spark):
    """Groups cut by batches and by the bound on held rows; ranks in slices of edges equal those in one."""
    import pandas as pd

    rng = random.Random(4)
    rows = [(g, rng.randrange(30), rng.randrange(30), 1) for g in range(40) for _ in range(rng.randrange(1, 60))] + [(g, 1, -1, 0) for g in range(40)]
    pdf = pd.DataFrame(sorted(rows), columns=["g", "src", "dst", "mult"])
    run = lambda least, step, size: pd.concat(G._by_group(K, least, G._ppr_arrays(K, 0.15, 5, size))(iter([pdf.iloc[i : i + step] for i in range(0, len(pdf), step)]))).reset_index(drop=True)
    want = pd.concat([G._ppr_arrays(K, 0.15, 5)(pd.DataFrame({"g": [g]}), *(p[c].to_numpy("int32") for c in ("zero", "src", "dst", "mult"))) for g, p in pdf.assign(zero=0).groupby("g")]).reset_index(drop=True)
    for got in (run(1, 7, 1 << 22), run(100, 13, 3), run(1 << 20, 1 << 20, 50)):
        assert got[["g", "node_id"]].values.tolist() == want[["g", "node_id"]].values.tolist() and got["ppr"].tolist() == pytest.approx(want["ppr"].tolist())


def test_connected_methods_hold_no_set_of_signatures(spark):
    """used signatures reach the semi-join as they come, and repeats change nothing."""
    m = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "g int, sig string")
    c = spark.createDataFrame([(1, "a", "x")] * 3 + [(1, "y", "b")] * 2 + [(2, "b", "c")], "g int, caller string, callee string")
    out = G.connected_methods(m, c, ["g"])
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (1, "b")]
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_mirrored_edges_need_no_counting(spark):
    """the bag degree of both directions' edges without a shuffle, as counted."""
    nodes = spark.createDataFrame([(1, i, s) for i, s in enumerate("abcd")], "g int, node_id int, sig string")
    calls = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (1, "c", "b"), (1, "d", "d"), (1, "a", "b")], "g int, caller string, callee string")
    edges = G.build_edges(nodes, calls, ["g"]).localCheckpoint()
    got, want = G.adjacency(edges, ["g"], mirrored=True), G.adjacency(edges, ["g"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.dtypes == want.dtypes
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("in_task", [0, 100])
def test_ranks_by_counted_size(spark, in_task, monkeypatch):
    """graphs that fit a task are ranked in one, larger ones by joins, with the same ranks."""
    adj = spark.createDataFrame([(1, a, b, 2) for a, b in [(0, 1), (1, 0), (1, 2), (2, 1)]] + [(2, 0, 1, 2), (2, 1, 0, 2)], "g int, src int, dst int, mult long")
    seeds = spark.createDataFrame([(1, 0), (2, 1)], "g int, node_id int")
    used, plain = [], G.ppr
    monkeypatch.setattr(G, "ppr", lambda *a: used.append(1) or plain(*a))
    got = {(r.g, r.node_id): r.ppr for r in G.ppr_by_size(adj, seeds, ["g"], iterations=6, in_task=in_task).collect()}
    want = {(r.g, r.node_id): r.ppr for r in plain(adj, seeds, ["g"], iterations=6).collect()}
    assert bool(used) == (in_task == 0) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_ranks_of_a_large_graph_hold_its_links_once():
    """memory of a task stays near the links' own arrays."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    n, rng = 600_000, np.random.default_rng(1)

    def batches():
        for _ in range(n // 10_000):
            a, b = rng.integers(0, 5_000, 5_000, dtype=np.int32), rng.integers(5_000, 50_000, 5_000, dtype=np.int32)
            yield pd.DataFrame({"g": 1, "src": np.concatenate([a, b]), "dst": np.concatenate([b, a]), "mult": np.int32(2)})
        yield pd.DataFrame({"g": [1], "src": [0], "dst": [-1], "mult": [0]})

    tracemalloc.start()
    total = sum(p["ppr"].sum() for p in G._by_group(["g"], 1 << 18, G._ppr_arrays(["g"], 0.15, 5, 1 << 16))(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(total - 1) < 1e-9 and peak < 32 * n


def test_marked_edges_give_the_same_hops_and_links(spark):
    """Edges with their ends' marks: the same pairs, hops and links as by joins; loops, both directions, isolated and several sources."""
    rng = random.Random(8)
    methods = spark.createDataFrame([(g, f"m{i}", i) for g in (1, 2) for i in range(30)], "g int, sig string, ord int")
    pairs = {(g, f"m{rng.randrange(30)}", rng.choice([f"m{rng.randrange(30)}", f"api{rng.randrange(12)}"])) for g in (1, 2) for _ in range(70)} | {(1, "m3", "m3"), (1, "m4", "m5"), (1, "m5", "m4")}
    calls = spark.createDataFrame(sorted(pairs), "g int, caller string, callee string")
    perms = spark.createDataFrame([(f"api{i}", ["P"]) for i in range(7)], "api_sig string, perms array<string>")
    nodes = G.build_nodes(methods, calls, perms, K)
    plain, marked = G.build_edges(nodes, calls, K), G.build_edges(nodes, calls, K, mark="is_sensitive").localCheckpoint()
    rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    columns = ["g", "src", "dst", "is_fwd"]
    assert rows(marked, *columns) == rows(plain, *columns)
    kind = {(r["g"], r["node_id"]): r["is_sensitive"] for r in nodes.collect()}
    assert all((r["src_is_sensitive"], r["dst_is_sensitive"]) == (kind[r["g"], r["src"]], kind[r["g"], r["dst"]]) for r in marked.collect())
    for loops in (True, False):
        one = G.build_edges(nodes, calls, K, reverse=False, self_loops=loops, mark="is_sensitive")
        assert rows(one, *columns) == rows(G.build_edges(nodes, calls, K, reverse=False, self_loops=loops), *columns)
    adj, bare = G.adjacency(marked, K, mirrored=True), G.adjacency(plain, K, mirrored=True)
    sens = nodes.where("is_sensitive = 1").select("g", "node_id")
    for k in (1, 2, 3):
        assert rows(G.khop(adj, sens, k, K, mark="is_sensitive"), "g", "node_id", "dist") == rows(G.khop(bare, sens, k, K), "g", "node_id", "dist")
    h = nodes.select("g", "node_id", F.array(1.0 + F.col("node_id") % 3, F.lit(-1.5)).alias("h"))
    want = rows(G.anchor_links(bare, nodes, h, K, 3, 0.3), "g", "src", "dst", "sim")
    assert want and rows(G.anchor_links(adj, nodes, h.join(sens, ["g", "node_id"], "left_semi"), K, 3, 0.3), "g", "src", "dst", "sim") == want


def test_compact_of_a_graphs_edges(spark):
    """A whole graph's edges give what the edges inside of its units give; a node may stand in several units, rows may repeat."""
    members = spark.createDataFrame([(1, u, n, f"s{n}") for u, n in [(0, 7), (0, 2), (0, 5), (1, 5), (1, 2), (1, 9)]] * 2, "g int, unit_id int, node_id int, sig string")
    edges = spark.createDataFrame([(1, 7, 2), (1, 2, 5), (1, 2, 5), (1, 5, 9), (1, 7, 9), (1, 2, 2)], "g int, src int, dst int")
    got = sorted(tuple(r) for r in G.compact(members, edges, K)[1].collect())
    inside = G.unit_edges(edges, members, K, ["unit_id"])
    assert got == [(1, 0, 0, 1), (1, 0, 2, 0), (1, 1, 0, 1), (1, 1, 1, 2)] == sorted(tuple(r) for r in G.compact(members, inside, K)[1].collect())


def test_pruning_reads_edges_among_picks_only(spark, monkeypatch):
    """whole graphs' edges are moved once for pruning and for the edges of the pick; the first hop reads marked edges."""
    seen, prune = [], G.prune_external
    monkeypatch.setattr(G, "prune_external", lambda picked, nodes, adj, *a: (seen.append((picked, adj)), prune(picked, nodes, adj, *a))[1])
    assert queries.prune_and_edges(spark, "/root/testdata/sf0.001").count()
    (picked, adj), = seen
    ends = adj.select("g", F.explode(F.array("src", "dst")).alias("node_id"))
    assert adj.count() and ends.join(picked, ["g", "node_id"], "left_anti").isEmpty()


def test_steps_of_mining_read_edges_within_groups(spark, monkeypatch):
    """sweep and pruning over a group's own edges equal those over all, and mining hands them these; a node is in several groups."""
    rng = random.Random(8)
    pairs = {(g, *sorted(rng.sample(range(30), 2))) for g in range(2) for _ in range(70)}
    adj = frame(spark, [(g, x, y, 2) for g, a, b in pairs for x, y in ((a, b), (b, a))], "g int, src int, dst int, mult long")
    nodes = frame(spark, [(g, v, int(v % 3 > 0), int(v in (2, 11)), None) for g in range(2) for v in range(30)], "g int, node_id int, is_external int, is_sensitive int, sig string")
    groups = frame(spark, [(g, v, q) for g in range(2) for q, v in enumerate((2, 11))], "g int, node_id int, group_id int")
    near = G.cut(G.khop(adj, groups, 2, K, ["group_id"]))
    inner = G.masked(adj, near, K, ["group_id"])
    scored = near.select("g", "group_id", "node_id", (F.col("node_id") * 7 % 11).cast("double").alias("score"))
    picked = [sorted(map(tuple, G.sweep_cut(x, scored, groups, K, ["group_id"], 4, 12).collect())) for x in (adj, inner)]
    assert picked[0] == picked[1] and len({r[:2] for r in picked[0]}) == 4
    picks = frame(spark, picked[0], "g int, group_id int, node_id int, phi double")
    assert sorted(map(tuple, G.prune_external(picks, nodes, inner, groups, K, ["group_id"]).collect())) == sorted(map(tuple, G.prune_external(picks, nodes, adj, groups, K, ["group_id"]).collect()))
    seen = []
    for name, at in (("sweep_cut", 0), ("prune_external", 2)):
        monkeypatch.setattr(G, name, lambda *a, f=getattr(G, name), at=at, **k: seen.append(set(a[at].columns)) or f(*a, **k))
    h = nodes.select("g", "node_id", F.array(F.lit(1.0), F.col("node_id").cast("double")).alias("h"))
    edges = adj.select("g", "src", "dst", F.lit(True).alias("is_fwd"))
    assert G.mine_units(nodes, edges, h, K, min_nodes=3, max_nodes=9, mirrored=True).count() and all("group_id" in x for x in seen) and len(seen) == 2


def test_scores_carry_no_mean_to_the_index(spark):
    """F2: shared vectors give the same scores as each node's own, and rows meet their vec_id before they get a mean vector."""
    table = frame(spark, [(i, [1.0, float(i)]) for i in range(3)], "vec_id long, h array<double>")
    index = frame(spark, [(1, v, v % 3) for v in range(9)], "g int, node_id int, vec_id long")
    groups = frame(spark, [(1, 0, 0), (1, 0, 4), (1, 1, 5)], "g int, group_id int, node_id int")
    near = frame(spark, [(1, q, v, v % 2) for q in range(2) for v in range(10)], "g int, group_id int, node_id int, dist int")
    ranks = frame(spark, [(1, 0, v, 0.1 * v) for v in range(5)], "g int, group_id int, node_id int, ppr double")
    plain = index.join(table, "vec_id").select("g", "node_id", "h")
    out = [G.node_scores(near, ranks, x, groups, K, ["group_id"]) for x in ((index, table), plain)]
    assert len({tuple(sorted(map(tuple, x.collect()))) for x in out}) == 1
    plan = out[0]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = lambda what: min(i for i, x in enumerate(plan) if "Join LeftOuter" in x and what in x)
    assert at("group_id") < at("node_id")


def test_tables_leave_no_shuffle_files(spark):
    """a job that writes a table leaves none of its shuffles behind."""
    import time

    shuffles = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before, out = shuffles(), G.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before and out.count() == 7
