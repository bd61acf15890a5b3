import math
import random

from pyspark.sql import functions as F

from unitforge.operators import cluster as C
from unitforge.operators import decide as D
from unitforge.operators import retrieve as R
from unitforge.operators import units as U
from unitforge.sources import readers, writers
from unitforge.streaming import jobs

UNITS = [
    (0, "u0", ["A", "B"], 2.0, [1.0, 0.0]),
    (1, "u1", ["A", "B"], 2.0, [0.9, 0.1]),
    (2, "u2", ["A"], 2.0, [0.0, 1.0]),
    (3, "u3", [], 2.0, [1.0, 0.0]),
    (4, "u4", ["C"], 2.0, [1.0, 0.0]),
    (5, "u5", ["A", "D"], 2.0, [1.0, 0.05]),
    (6, "u6", ["A", "B"], 2.0, None),
]
FIELDS = "ord long, unit_id string, psi array<string>, q double, unit_emb array<double>"


def test_leader_clusters(spark):
    units = spark.createDataFrame(UNITS, FIELDS)
    p = C.Params(tau=0.7, gamma=0.3)
    for shards in (True, False):
        rows = {r["unit_id"]: r for r in C.leader_clusters(units, p, shards=shards).collect()}
        assert {k: (r["cluster_id"], r["action"]) for k, r in rows.items()} == {
            "u0": ("p_000001", "create"), "u1": ("p_000001", "merge"), "u2": ("p_000002", "create"), "u4": ("p_000003", "create"), "u5": ("p_000001", "merge"), "u6": ("p_000004", "create"),
        }
        assert rows["u1"]["semantic_sim"] == round(0.9 / math.hypot(0.9, 0.1), 6) and rows["u1"]["symbolic_jaccard"] == 1.0
    done = C.leader_clusters(units, p).withColumn("apk_id", F.lit("2020/X"))
    counts = C.psi_counts(units, done)
    assert {(r["cluster_id"], r["token"]): r["cnt"] for r in counts.collect() if r["cluster_id"] == "p_000001"} == {("p_000001", "A"): 3, ("p_000001", "B"): 2, ("p_000001", "D"): 1}
    freq = C.frequent_psi(counts, C.cluster_sizes(done), eta=0.5)
    assert {r["token"] for r in freq.where("cluster_id = 'p_000001'").collect()} == {"A", "B"}
    center = C.centers(units, done, p).where("cluster_id = 'p_000001'").first()
    c, n = [1.0, 0.0], 1.0
    for v in ([0.9, 0.1], [1.0, 0.05]):
        w = min(max(math.log1p(2.0), 0.5), 3.0)
        a = min(max(w / (n + w), 1e-6), 0.02)
        c = [(1 - a) * x + a * y for x, y in zip(c, v, strict=True)]
        c, n = [x / math.hypot(*c) for x in c], n + w
    assert all(abs(x - y) < 1e-12 for x, y in zip(center["center"], c, strict=True)) and abs(center["n_eff"] - n) < 1e-12
    family, behavior = C.label_counts(done, spark.createDataFrame([("X", "fam", ["b", " "])], "apk_id string, family string, behaviors array<string>"))
    assert {r["cluster_id"]: r["cnt"] for r in family.collect()}["p_000001"] == 3 and behavior.count() == 4
    s = C.build_summary(done).first()
    assert (s["apks"], s["bus"], s["created"], s["merged"]) == (1, 6, 4, 2)
    assert [r["unit_id"] for r in C.top_members(done, units).where("cluster_id = 'p_000001'").orderBy("rank").collect()][0] == "u0"
    ranked = R.rank_clusters(units, C.centers(units, done, p).withColumnRenamed("center", "unit_emb"), freq, tau=0.5, gamma=0.1)
    best = {r["unit_id"]: r["cluster_id"] for r in ranked.where("rank = 1").collect()}
    assert best["u0"] == "p_000001" and best["u4"] == "p_000003" and "u3" not in best


def test_units(spark):
    nodes = spark.createDataFrame(
        [("k", 0, " s1 ", 1, ["P"], ['const-string v0, "GET"', "Cipher"], [1.0, 0.0]), ("k", 1, "s2", 0, [], None, [0.0, 1.0, 2.0]), ("k", 2, "s3", 0, [], ['const-string v1, "low"'], [3.0, 4.0])],
        "unit string, ord int, sig string, is_sensitive int, perms array<string>, lines array<string>, h array<double>",
    )
    anchors = spark.createDataFrame([("k", "a1", ["P", "Q"]), ("k", None, ["R"])], "unit string, sig string, perms array<string>")
    r = U.build_units(nodes, anchors, ["unit"]).first()
    assert (r["sapi"], r["perms"], r["hints"], r["lexical"], r["unit_emb"]) == (["a1", "s1"], {"P": ["a1", "s1"], "Q": ["a1"], "R": []}, ["HINT:CRYPTO"], ["GET"], [2.0, 2.0])


def test_smali_and_features(spark):
    body = '.class public La/B;\n.method public onCreate(I)V\n  .line 1\n  const-string/jumbo v0, "http://x.com"\n  invoke-virtual {v0}, Lapi/X;->go()V\n  invoke-virtual {v0}, [I->clone()V\n.end method\n.method abstract z()V\n.end method\n'
    files = spark.createDataFrame([("sha", "f1", body), ("sha", "f2", "no class")], "apk string, file string, body string")
    methods = R_sorted(readers.parse_smali(files, ["apk"]))
    assert [(m["method_sig"], m["invokes"], m["strings"]) for m in methods] == [("La/B;->onCreate(I)V", ["Lapi/X;->go()V"], ["http://x.com"]), ("La/B;->z()V", [], [])]
    perms = spark.createDataFrame([("Lapi/X;->go()V", ["P"])], "api_sig string, perms array<string>")
    df = readers.parse_smali(files, ["apk"])
    calls = U.call_edges(df, perms, ["apk"])
    assert [(c["callee_is_sensitive"], c["callee_perms"]) for c in calls.collect()] == [(1, ["P"])]
    roles = readers.component_roles(readers.manifests(spark.createDataFrame([("p", ["b", "a", "a"], ["a.B"], None, None, None)], "package string, permissions array<string>, activities array<string>, services array<string>, receivers array<string>, providers array<string>").withColumn("apk", F.lit("sha"))), ["apk"])
    out = U.method_features(df, calls, perms, roles, ["apk"]).where("method_name = 'onCreate'").first()
    assert out["method_family_tags"] == ["lifecycle"] and out["method_stats"]["sensitive_invoke_count_total"] == 1 and out["roles"] == ["activity"] and out["evidence_spans"][1]["perms"] == ["P"]


def R_sorted(df):
    return df.orderBy("method_ord").collect()


def test_sources(spark, tmp_path):
    assert readers.parse_years("2014-2012,2020") == ["2012", "2013", "2014", "2020"] and readers.parse_years(["2012", ["2011-2011"]]) == ["2011", "2012"] and readers.parse_years(None) is None
    import zipfile

    (tmp_path / "2020").mkdir()
    with zipfile.ZipFile(tmp_path / "2020" / "abc.apk", "w") as z:
        for name in ("classes.dex", "classes10.dex", "lib/classes2.dex", "other.txt"):
            z.writestr(name, "x")
    (tmp_path / "2020" / "bad.apk").write_text("no zip")
    apks = readers.list_apks(spark, str(tmp_path), "2020")
    assert [(r["year"], r["apk_sha256"]) for r in apks.collect()] == [("2020", "ABC"), ("2020", "BAD")]
    dex = readers.list_dex(spark, str(tmp_path)).orderBy("apk_path", "ord").collect()
    assert [r["dex"] for r in dex if r["dex"]] == ["classes.dex", "lib/classes2.dex", "classes10.dex"] and sum(r["error"] is not None for r in dex) == 1
    failed = readers.disassemble(apks, lambda p: [("f", "body")] if "abc" in p else 1 / 0).collect()
    assert [(r["apk_sha256"], r["body"], bool(r["error"])) for r in failed] == [("ABC", "body", False), ("BAD", None, True)]
    (tmp_path / "l.jsonl").write_text('{"apk_id":"a","family":"f1"}\nbroken\n{"sha":"b"}\n{"apk_id":"a","family":"f2","behaviors":["x"]}\n')
    got = {r["apk_id"]: (r["family"], r["behaviors"]) for r in readers.read_labels(spark, str(tmp_path / "l.jsonl")).collect()}
    assert got == {"a": ("f2", ["x"]), "b": ("unknown", [])}
    wanted = spark.createDataFrame([("/x/2020/abc.apk",), ("bad",)], "p string")
    assert [r["apk_sha256"] for r in readers.select_targets(apks, wanted).collect()] == ["ABC", "BAD"]
    writers.write_table(apks, str(tmp_path / "t"))
    assert readers.read_table(spark, str(tmp_path / "t"), "2019").count() == 0


def test_fold(spark):
    rows = spark.createDataFrame([("x", f"b{i}", i, "spyware steals" if i == 0 else "calm") for i in range(3)] + [("y", "b", 0, "calm")], "apk_id string, bu_id string, rank int, summary string")
    got = {r["apk_id"]: r for r in D.fold_states(rows).collect()}
    assert got["x"]["verdict"] == "malicious" and got["x"]["calls"] == 3 and got["x"]["processed"] == ["b0", "b1", "b2"] and got["y"]["verdict"] == "unknown"
    out = D.results(spark.createDataFrame([("x",), ("z",), ("w",)], "apk_id string"), D.fold_states(rows), spark.createDataFrame([("w",)], "apk_id string")).collect()
    assert {r["apk_id"]: r["note"] for r in out}["z"] == "no_units_loaded" and {r["apk_id"]: r["note"] for r in out}["w"] == "no_bu_packs"
    tries = []

    def flaky(prompt):
        tries.append(1)
        if len(tries) < 3:
            raise TimeoutError
        return "ok"

    assert D.with_retries(flaky, pause=lambda s: None)("p") == "ok" and len(tries) == 3
    said = D.ask(spark.createDataFrame([("a",)], "prompt string"), "prompt", lambda p: 1 / 0).first()
    assert said["reply"] is None and "ZeroDivisionError" in said["error"]
    s = spark.createDataFrame([('x {"risk_signal":"benign","confidence":"7"} y',)], "r string").select(D.local_summary(F.lit("b"), F.col("r")).alias("s")).first()["s"]
    assert (s["risk_signal"], s["confidence"], s["local_intents"]) == ("benign", 7.0, "[]")


def test_stream_equals_batch(spark, tmp_path):
    units = spark.createDataFrame(UNITS, FIELDS).where("unit_emb is not null")
    units.repartition(3).write.parquet(f"{tmp_path}/in")
    index = spark.createDataFrame([("p1", "A"), ("p1", "B"), ("p2", "C")], "cluster_id string, token string")
    centers = spark.createDataFrame([("p1", [1.0, 0.0]), ("p2", [0.0, 1.0])], "cluster_id string, unit_emb array<double>")
    stream = jobs.read_units(spark, f"{tmp_path}/in", FIELDS, 1)
    jobs.retrieve_stream(stream, centers, index, f"{tmp_path}/out", f"{tmp_path}/cp", tau=0.0, gamma=0.0).trigger(availableNow=True).start().awaitTermination()
    want = R.rank_clusters(units, centers, index, tau=0.0, gamma=0.0)
    got = spark.read.parquet(f"{tmp_path}/out").select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_similar_sets(spark):
    """Common tokens only, groups of equal sets, a hot token, empty sets; against brute force."""
    rng = random.Random(3)
    units = [(i, [f"t{k}" for k in rng.sample(range(14), rng.randrange(1, 9))]) for i in range(150)]
    units += [(200 + i, ["p", "q", f"u{i}"]) for i in range(40)] + [(300 + i, ["x", "y"]) for i in range(20)] + [(400, []), (401, [])]
    sets = {i: frozenset(x) for i, x in units}
    first = {}
    for i, s in sorted(sets.items()):
        first.setdefault(s, i)
    want = {("equal", first[s], i): 1.0 for i, s in sets.items() if first[s] != i}
    for s, a in first.items():
        for t, b in first.items():
            if a < b and 2 * len(s & t) >= len(s | t):
                want["near", a, b] = round(len(s & t) / len(s | t), 6)
    rows = R.similar_sets(spark.createDataFrame(units, "unit_id long, psi array<string>"), 1, 2, salt_rows=8).collect()
    assert {(r["kind"], r["a"], r["b"]): r["jac"] for r in rows} == want and len(rows) == len(want)
