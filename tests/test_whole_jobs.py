"""Queries whose whole results small tables don't show: large units, documents without labels."""

import duckdb
import pytest
from test_stages_queries import rows_of

from unitforge.plans import queries, registry, stages  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def one_nation(tmp_path_factory):
    """1,200 suppliers of one nation: more literals than the operator's own limit of a unit."""
    path = tmp_path_factory.mktemp("sf")
    duckdb.sql(f"COPY (SELECT i AS s_suppkey, 'S' || i AS s_name, CAST(3 AS INT) AS s_nationkey, 1.0::DOUBLE AS s_acctbal FROM range(1200) t(i)) TO '{path}/supplier.parquet'")
    return str(path)


def check_units(spark, name, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{sf}/supplier.parquet'")
    got, want = registry.QUERIES[name](spark, sf).toPandas(), con.sql(registry.ORACLE_SQL[name]).df()
    assert len(want) == 1 and rows_of(got) == rows_of(want)


def test_unit_parts_of_many_literals(spark, one_nation):
    check_units(spark, "unit_parts", one_nation)


def test_unit_tokens_of_many_literals(spark, one_nation):
    check_units(spark, "unit_tokens", one_nation)


def test_label_fallback_counts_every_document(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES["label_fallback"](spark, SF).toPandas(), con.sql(registry.ORACLE_SQL["label_fallback"]).df()
    assert rows_of(got) == rows_of(want)
    assert got["n"].sum() == con.sql("SELECT count(*) FROM documents").fetchall()[0][0] and "unknown" in set(got["family"])


@pytest.mark.parametrize("within", [True, False])
def test_marks_lose_no_pair_and_leave_few_others(within):
    """Of sets that all share common tokens, marks leave the pairs that agree by half and next to no other."""
    import random
    import zlib

    import pandas as pd

    from unitforge.operators import retrieve

    rng, sets = random.Random(1), {}
    for i in range(120):
        base = set(sets[i - 1]) if i % 3 == 2 else {f"c{k}" for k in range(20)} | {f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 120))}
        sets[i] = {t for t in base if rng.random() < 0.85 or i % 3 != 2}
    rows = [(i, len(s), sorted({zlib.crc32(t.encode()) % retrieve.BITS for t in s})) for i, s in sets.items()]
    marks = pd.concat(retrieve._marks(iter([pd.DataFrame(rows, columns=["id", "n", "at"])])))
    marks = marks.assign(block=0 if within else marks["id"] % 2, low=0, high=0 if within else 1)
    got = set(retrieve._close(1, 2, 16)(marks).itertuples(index=False, name=None))
    want = {(a, b) for a in sets for b in sets if a < b and (within or (a + b) % 2) and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert want and want <= got and len(got) <= len(want) + 10


@pytest.mark.parametrize("rows", [3, 2048])
def test_cosine_pairs_meet_in_blocks(spark, rows):
    """vectors of a key in several blocks give the pairs of a plain comparison; odd vectors pair with none."""
    import numpy as np

    from unitforge.operators import retrieve

    rng = np.random.default_rng(3)
    x = {(k, 100 * k + i): rng.standard_normal(5).astype(np.float32) for k in range(2) for i in range(14)}
    table = [(k, i, v.tolist()) for (k, i), v in x.items()] + [(0, 900, []), (0, 901, None), (0, 902, [1.0, None, 0.0, 0.0, 0.0]), (0, 903, [1.0] * 4), (None, 904, [1.0] * 5), (None, 905, [1.0] * 5)]
    got = retrieve.cosine_pairs(spark.createDataFrame(table, "k int, id long, v array<float>"), ["k"], 0.3, rows).collect()
    u = {n: v.astype(float) / np.linalg.norm(v.astype(float)) for n, v in x.items()}
    want = {(a[1], b[1]): u[a] @ u[b] for a in x for b in x if a[0] == b[0] and a[1] < b[1] and u[a] @ u[b] >= 0.3}
    assert len(got) == len(want) and all(abs(want[r.a, r.b] - r.sim) < 1e-12 for r in got)


def test_type_names_are_worked_out_once(spark):
    """the expression for a signature stays small, so a row costs a few patterns, not their product."""
    from pyspark.sql import functions as F

    from unitforge.functions import text as T

    df = spark.createDataFrame([("int",), ("java.util.Map<a.B<C>,D>[]",), ("a.B...",), ("",), (None,)], "t string").select(T.smali_type(F.col("t")).alias("d"))
    assert [r.d for r in df.collect()] == ["I", "[Ljava/util/Map;", "[La/B;", "", ""]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("<[^<>]*>") < 10


def test_token_jaccard_prunes_by_size_and_keeps_pairs_at_the_half(spark, tmp_path):
    """sets of one to two sizes whose tokens agree by just half stay; pairs of more unlike sizes go before sets are joined."""
    rows = [(1, "aaa bbb"), (2, "aaa bbb ccc ddd"), (3, "aaa bbb ccc ddd eee"), (4, "zzz"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' AS source").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES["token_jaccard"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [(1, 2, 0.5), (2, 3, 0.8)]
    assert "least(n_a" in df._jdf.queryExecution().optimizedPlan().toString()


def test_marks_of_large_sets_tell_unlike_ones_apart():
    """marks grow with sets, so pairs of large sets that don't agree are not left to a comparison of the full sets."""
    import random
    import zlib

    import pandas as pd

    from unitforge.operators import retrieve

    rng = random.Random(2)
    sets = [{f"c{k}" for k in range(1200)} | {f"w{rng.randrange(10**6)}" for _ in range(1800)} for _ in range(20)]
    sets.append({t for t in sets[0] if rng.random() < 0.9})
    dealt, meet = retrieve._size_blocks([(len(s), 1) for s in sets], 64, 1, 2)
    assert len({b for _, b, _ in dealt}) == 1 and len(meet) == 1
    rows = [(i, len(s), [zlib.crc32(t.encode()) for t in s], meet[0][3]) for i, s in enumerate(sets)]
    marks = pd.concat(retrieve._marks(iter([pd.DataFrame(rows, columns=["id", "n", "at", "bits"])])))
    got = set(retrieve._close(1, 2, 4, 8)(marks.assign(block=0, low=0, high=0)).itertuples(index=False, name=None))
    assert got == {(0, 20)}


@pytest.mark.parametrize(("num", "den", "rows"), [(1, 2, 3), (1, 2, 16_384), (3, 4, 5)])
def test_similar_sets_equal_a_plain_comparison(spark, num, den, rows):
    """sets of all sizes in blocks of their size, shares of one size and a crowd of near copies give the pairs of a plain comparison."""
    import random

    from unitforge.operators import retrieve

    rng, sets = random.Random(6), {1: set(), 2: set(), 3: {"a"}, 4: {"a", "b"}}
    for i in range(5, 65):
        base = {f"w{rng.randrange(90)}" for _ in range(rng.choice([3, 12, 12, 40]))}
        sets[i] = {f"c{k}" for k in range(11)} | {f"x{i}"} if i > 50 else base if i % 4 else {t for t in sorted(sets[i - 1]) if rng.random() < 0.8}
    got = retrieve.similar_sets(spark.createDataFrame([(i, list(s)) for i, s in sets.items()], "unit_id long, psi array<string>"), num, den, rows, 1).collect()
    least = {frozenset(s): i for i, s in sorted(sets.items(), reverse=True)}
    want = {("equal", least[frozenset(s)], i, 1.0) for i, s in sets.items() if least[frozenset(s)] != i}
    one = [(i, s) for i, s in sets.items() if s and least[frozenset(s)] == i]
    want |= {("near", i, j, round(len(x & y) / len(x | y), 6)) for i, x in one for j, y in one if i < j and den * len(x & y) >= num * len(x | y)}
    assert len(want) > 40 and sorted(map(tuple, got)) == sorted(want)


def test_sizes_meet_within_the_ratio_only():
    """every size has its blocks, sizes that can agree meet, and others don't travel to each other."""
    from unitforge.operators import retrieve

    dealt, meet = retrieve._size_blocks([(n, 1 + n % 7) for n in range(1, 300)], 6, 1, 2)
    of = {n: set(range(first, first + shares)) for n, first, shares in dealt}
    pairs = {(low, high) for _, low, high, _ in meet}
    bits = {(low, high): b for _, low, high, b in meet}
    for a in of:
        for b in range(a, min(2 * a, 299) + 1):
            assert {(min(x, y), max(x, y)) for x in of[a] for y in of[b]} <= pairs and all(bits[min(x, y), max(x, y)] >= 4 * b for x in of[a] for y in of[b])
    assert len(pairs) < max(map(max, of.values())) ** 2 / 3
