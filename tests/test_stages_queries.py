"""The queries that have SQL, side by side with DuckDB on the smallest tables, and functions that no query reaches."""

import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from unitforge.functions import state as S
from unitforge.functions import text as T
from unitforge.operators import cluster, decide, graph
from unitforge.plans import registry, stages  # noqa: F401
from unitforge.sources import readers, writers

SF = "/root/testdata/sf0.001"
TABLES = "nation customer supplier part orders lineitem events documents embeddings pages labels conversations".split()
NEW = [n for n, f in registry.QUERIES.items() if f.__module__ == "unitforge.plans.stages" and n in registry.ORACLE_SQL]


def rows_of(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is pd.NA or v is None or v != v:
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", NEW)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) and rows_of(got) == rows_of(want)


def test_reply_forms(spark):
    raw = [
        '{"choices":[{"message":{"content":"hi"}}]}', '{"choices":[{"message":{"content":"[1]"}}]}', '{"choices":[{"message":{"content":[{"type":"x"}]}}],"text":"t"}',
        '{"output":[{"content":[{"text":"a"},{"text":"b"}]},{"content":[{"text":"c"}]}]}', '{"text":5,"content":"c"}', '{"content":{"a":1}}', "plain", None,
    ]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, r string").coalesce(1).orderBy("i").select(S.reply_text(F.col("r"))).collect()]
    assert got == ["hi", "[1]", "t", "a\nb\nc", "c", '{"content":{"a":1}}', "plain", ""]


def test_label_files(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"a": {"family": "f", "behaviors": ["x"]}, "b": {}}')
    assert {r["apk_id"]: (r["family"], r["behaviors"]) for r in readers.read_labels(spark, str(tmp_path / "l.json")).collect()} == {"a": ("f", ["x"]), "b": ("unknown", [])}
    assert readers.read_labels(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_listing_is_one_level_deep(spark, tmp_path):
    (tmp_path / "2020" / "inner").mkdir(parents=True)
    for p in ("2020/a.apk", "2020/inner/b.apk", "2020/c.txt"):
        (tmp_path / p).write_text("x")
    assert [(r["year"], r["apk_sha256"]) for r in readers.list_apks(spark, str(tmp_path)).collect()] == [("2020", "A")]


def test_tables_written_once_and_paths(spark, tmp_path):
    df = spark.range(3)
    assert writers.write_new(df, f"{tmp_path}/t") and not writers.write_new(df.union(df), f"{tmp_path}/t") and spark.read.parquet(f"{tmp_path}/t").count() == 3
    assert [writers.under_out(p) for p in ("a/b", "out/a", "./out/a", "/x", "outer/a")] == ["out/a/b", "out/a", "out/a", "/x", "out/outer/a"]
    writers.write_json(df, f"{tmp_path}/j")
    writers.append_results(df.withColumn("note", F.lit("n")), f"{tmp_path}/r", ["id", "note"])
    writers.append_results(df.withColumn("note", F.lit("n")), f"{tmp_path}/r", ["id", "note"])
    assert spark.read.json(f"{tmp_path}/j").count() == 3 and spark.read.option("header", True).csv(f"{tmp_path}/r").count() == 6


def test_embedding_switches(spark):
    t = spark.createDataFrame([(["a", "b", "c"],), ([],)], "t array<string>")
    assert [tuple(r[0]) for r in t.select(T.truncated(F.col("t"), 2)).collect()] == [([["a", "b"]], 2), ([[]], 0)]
    zero = t.select(T.external_vector(F.lit("La;->b()V"), F.lit(None).cast("array<string>"), width=3)).first()[0]
    named = t.select(T.external_vector(F.lit("La;->b()V"), F.array(F.lit("P")), "signature", 16)).first()[0]
    assert zero == [0.0] * 3 and math.isclose(sum(x * x for x in named), 1.0)
    with pytest.raises(ValueError, match="unknown mode"):
        T.external_vector(F.lit("s"), F.lit(None), "other")


def test_encoder_weights(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"layers": [{"own": [[1.0]], "neighbours": [[0.5]]}]}')
    assert graph.encoder_weights(spark, str(tmp_path / "w.json"), lambda: "made") == [[[[1.0]], [[0.5]]]]
    assert graph.encoder_weights(spark, str(tmp_path / "w.json"), lambda: "made", rebuild=True) == graph.encoder_weights(spark, str(tmp_path / "x.json"), lambda: "made") == "made"


def test_shards_that_do_not_settle(spark):
    units = spark.createDataFrame([(i, [f"t{i}", f"t{i + 1}"]) for i in range(40)], "ord long, psi array<string>")
    with pytest.raises(RuntimeError, match="did not settle"):
        cluster.token_shards(units, rounds=1)


def test_leader_clusters_against_a_plain_pass(spark):
    """Create or merge by the rules, one unit after the other, with one view and no limits in reach."""
    import random

    rng = random.Random(2)
    units = [(i, f"u{i}", [f"t{rng.randrange(6)}" for _ in range(3)] + ([f"own{i % 4}"]), float(i % 5), [rng.random() + 0.1, rng.random() + 0.1]) for i in range(60)]
    units = [(o, u, sorted(set(p)), q, v) for o, u, p, q, v in units]
    got = {r["unit_id"]: (r["cluster_id"], r["action"]) for r in cluster.leader_clusters(spark.createDataFrame(units, "ord long, unit_id string, psi array<string>, q double, unit_emb array<double>")).collect()}
    clusters, want = [], {}
    unit = lambda v: [x / math.hypot(*v) for x in v]
    for _, u, psi, q, v in units:
        best = None
        for k, c in enumerate(clusters):
            frequent = {t for t, n in c["counts"].items() if n >= 0.5 * c["size"]}
            if not frequent & set(psi):
                continue
            sem = sum(a * b for a, b in zip(unit(v), c["center"], strict=True))
            jac = len(frequent & set(psi)) / len(frequent | set(psi))
            if sem >= 0.7 and jac >= 0.1 and (best is None or 0.85 * sem + 0.15 * jac > best[0]):
                best = (0.85 * sem + 0.15 * jac, k)
        if best is None:
            clusters.append({"center": list(v), "size": 1, "mass": 1.0, "counts": dict.fromkeys(psi, 1)})
            want[u] = (f"p_{len(clusters):06d}", "create")
            continue
        c = clusters[best[1]]
        w = min(max(math.log1p(q), 0.5), 3.0)
        a = min(max(w / (c["mass"] + w), 1e-6), 0.02)
        c["center"] = unit([(1 - a) * x + a * y for x, y in zip(c["center"], v, strict=True)])
        c["size"], c["mass"] = c["size"] + 1, c["mass"] + w
        for t in psi:
            c["counts"][t] = c["counts"].get(t, 0) + 1
        want[u] = (f"p_{best[1] + 1:06d}", "merge")
    assert got == want


def test_fold_with_a_model_that_keeps_count(spark):
    """Every call's state goes into the next one: the reply's confidence is the number of units that the prompt's state has seen."""

    def count(prompt: str) -> str:
        import json

        state = json.loads(prompt.split("state: ", 1)[1].split("\n", 1)[0])
        return json.dumps({"verdict": "benign", "confidence": 10 * len(state["processed_bu_ids"]), "note": state["note"] + "x"})

    rows = spark.createDataFrame([("a", f"b{i}", 5 - i, "s") for i in range(5)], "apk_id string, bu_id string, rank int, summary string")
    r = decide.fold_states(rows, count).first()
    assert (r["processed"], r["calls"], r["confidence"], r["note"], r["verdict"]) == (["b4", "b3", "b2", "b1", "b0"], 4, 50.0, "xxxx", "benign")


def test_fold_stream_equals_batch(spark, tmp_path):
    from unitforge.streaming import jobs

    schema = "apk_id string, bu_id string, rank int, summary string"
    rows = spark.createDataFrame([("a", f"b{i}", 5 - i, "spyware" if i == 2 else "s") for i in range(5)] + [("z", "b", 1, "s")], schema)
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = jobs.fold_stream(jobs.read_units(spark, f"{tmp_path}/in", schema))
    stream.writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {r["apk_id"]: (r["verdict"], r["processed"]) for r in spark.table("folded").collect()}
    assert got == {r["apk_id"]: (r["verdict"], r["processed"]) for r in decide.fold_states(rows, reconcile=False).collect()}
