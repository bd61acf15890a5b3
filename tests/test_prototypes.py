"""The ordered clustering with bounded state, in batches and as a stream, against a pass that keeps all units."""

import random

import pytest

from unitforge.operators import cluster
from unitforge.streaming import jobs

FIELDS = "store string, ord long, unit_id string, psi array<string>, q double, unit_emb array<double>, anchors array<string>"


def some_units(n, seed=3, common=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        angle = [rng.random() + 0.05, rng.random() + 0.05]
        psi = sorted({f"t{rng.randrange(6)}" for _ in range(3)} | {f"own{i % 5}"} | ({"all"} if common else set()))
        rows.append(("s", i, f"u{rng.randrange(n // 2)}", [] if i % 17 == 5 else psi, float(i % 5), None if i % 11 == 3 else angle, [f" a{rng.randrange(50)}" for _ in range(i % 4)]))
    return rows


def kept_lists(rows, assigned, p):
    """Members, exemplars and audit lists out of all units of a cluster."""
    by, out = {r[1]: r for r in rows}, {}
    for a in sorted(assigned, key=lambda r: r.ord):
        out.setdefault(a.cluster_id, []).append((a, by[a.ord]))
    best = lambda xs: sorted(xs, key=lambda x: (-x[2], -x[1]))
    lists = {}
    for c, own in out.items():
        listed = [(r[2], r[4], 1.0 if a.action == "create" else a.semantic_sim) for a, r in own]
        seen = {}
        for x in best([x for x in listed if x[2] >= p.exemplar_sim]):
            seen.setdefault(x[0], x)
        audit = [x for x in own[0][1][6]][: p.audit]
        for _, r in own[1:]:
            audit += [x for x in dict.fromkeys(y.strip() for y in r[6]) if x not in audit]
        lists[c] = (len(own), best(listed)[: p.members], list(seen.values())[: p.exemplars], audit[: p.audit])
    return lists


@pytest.mark.parametrize("shards", [True, False])
def test_prototypes(spark, shards):
    rows, p = some_units(240), cluster.Params(tau=0.8, gamma=0.15, members=4, exemplars=3, exemplar_sim=0.95, audit=6)
    df = spark.createDataFrame(rows, FIELDS).repartition(5)
    assigned, states = cluster.leader_prototypes(df, p, shards=shards, audit=["anchors"])
    assigned, got = assigned.collect(), {r.cluster_id: r for r in states.collect()}
    assert sorted(map(tuple, assigned)) == sorted(map(tuple, cluster.leader_clusters(df, p, shards=shards).collect())) and len(got) > 5
    want = kept_lists(rows, assigned, p)
    assert set(got) == set(want)
    for c, (size, members, exemplars, audit) in want.items():
        six = lambda xs: [(x[0], x[1], round(x[2], 6)) for x in xs]
        assert (got[c].size, six(got[c].members), six(got[c].exemplars), got[c].audit["anchors"]) == (size, six(members), six(exemplars), audit)
    centers = {r.cluster_id: r for r in cluster.centers(df, spark.createDataFrame(assigned), p).collect()}
    for c, r in got.items():
        assert r.n_eff == pytest.approx(centers[c].n_eff) and r.centers.get("unit_emb", []) == pytest.approx([] if centers[c].center is None else list(centers[c].center))


def test_one_shard_streams_through_a_task(spark):
    """All units in one component, in far more rows than an Arrow batch holds: the fold sees batches, and their order is that of ord."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        rows = some_units(600, seed=8)
        got = cluster.leader_clusters(spark.createDataFrame(rows, FIELDS).repartition(7), cluster.Params(tau=0.8)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    now, want, made = cluster.Pass(cluster.Params(tau=0.8), {"unit_emb": 1.0}), {}, 0
    for _, o, u, psi, q, v, _ in rows:
        if psi:
            c, action, sem, jac = now.take(made + 1, u, set(psi), q, {"unit_emb": v} if v else {}, {})
            made += action == "create"
            want[o] = (u, f"p_{c:06d}", action)
    assert {r.ord: (r.unit_id, r.cluster_id, r.action) for r in got} == want


@pytest.mark.parametrize("cuts", [[40, 41, 120], [100]])
def test_stream_equals_batch_and_restarts(spark, tmp_path, cuts):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows, p = some_units(160, seed=5), cluster.Params(tau=0.8, gamma=0.15)

        def go():
            units = jobs.read_units(spark, f"{tmp_path}/in", FIELDS, files_per_batch=1)
            jobs.leader_stream(units, p).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()

        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):  # stopped and started again between the parts
            spark.createDataFrame(rows[a:b], FIELDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            go()
        got = spark.read.parquet(f"{tmp_path}/out").drop("store").select("ord", "unit_id", "cluster_id", "action", "semantic_sim", "symbolic_jaccard").collect()
    finally:
        spark.conf.set(name, before)
    assert sorted(map(tuple, got)) == sorted(map(tuple, cluster.leader_clusters(spark.createDataFrame(rows, FIELDS), p).collect()))
