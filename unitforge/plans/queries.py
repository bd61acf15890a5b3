"""Queries for the operators of the behaviour pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sets as X
from ..functions import state as S
from ..functions import text as T
from ..functions import vectors as V
from ..operators import cluster, decide, graph, retrieve, units
from ..operators.lineage import cut
from ..sources import readers
from . import bindings as B
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401  kept under their old names


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


KINDS = {"url": T.URL, "domain": T.DOMAIN, "ip": T.IPV4, "email": T.EMAIL, "intent": T.INTENT_ACTION, "content_uri": T.CONTENT_URI, "file_path": T.FILE_PATH}
#: What a text must hold for a pattern to match.
MARKS = {"url": "://", "ip": ".", "email": "@", "intent": "android.intent.", "content_uri": "://", "file_path": "/"}
_ALL = " UNION ALL ".join(f"SELECT id, source, '{k}' AS kind, unnest(regexp_extract_all(body, '{_q(p)}')) AS value FROM texts" for k, p in KINDS.items())
_TEXTS = "texts AS (SELECT doc_id AS id, source, text AS body FROM documents UNION ALL SELECT page_id, 'pages', html FROM pages UNION ALL SELECT page_id, 'urls', url FROM pages)"
_HITS = f"WITH {_TEXTS}, hits AS (SELECT * FROM ({_ALL}) WHERE NOT (kind = 'domain' AND starts_with(value, 'android.')))"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.col("text").alias("body"))
    pages = B.table(spark, sf_dir, "pages")
    docs = docs.union(pages.select("page_id", F.lit("pages"), "html")).union(pages.select("page_id", F.lit("urls"), "url"))
    lists = [F.struct(F.lit(k).alias("kind"), (T.domains(F.col("body")) if k == "domain" else T.extract_where(F.col("body"), p, MARKS[k])).alias("values")) for k, p in KINDS.items()]
    return docs.select("id", "source", F.explode(F.array(*lists)).alias("x")).select("id", "source", "x.kind", F.explode("x.values").alias("value"))


@query(f"{_HITS}, n AS (SELECT source, kind, value, count(DISTINCT id) AS n_docs, count(*) AS n_hits FROM hits GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY n_docs DESC, n_hits DESC, value) AS rank FROM n) SELECT source, kind, value, n_docs, n_hits, rank FROM r WHERE rank <= 5")
def indicator_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship (F10-F16, W-rank): the five commonest indicators of each kind by source."""
    n = _hits(spark, sf_dir).groupBy("source", "kind", "value", "id").agg(F.count("*").alias("h")).groupBy("source", "kind", "value").agg(F.count("*").alias("n_docs"), F.sum("h").alias("n_hits"))
    w = Window.partitionBy("source", "kind").orderBy(F.desc("n_docs"), F.desc("n_hits"), "value")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 5)


@query(f"{_HITS} SELECT kind, count(*) AS n_hits, count(DISTINCT value) AS n_values FROM hits GROUP BY kind")
def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n_hits"), F.countDistinct("value").alias("n_values"))


@query(r"""WITH t AS (SELECT unnest(string_split_regex(text, '\s+')) AS s FROM documents), u AS (SELECT s, length(s) AS n FROM t WHERE s <> '')
SELECT CASE WHEN regexp_matches(s, '(?i)\bhttps?://') THEN '<URL>' WHEN regexp_matches(s, '\b\d{1,3}(\.\d{1,3}){3}\b') THEN '<IP>' WHEN n >= 40 AND regexp_full_match(s, '[A-Za-z0-9+/=]+') THEN '<BASE64(' || n || ')>'
 WHEN n >= 32 AND regexp_full_match(s, '[0-9a-fA-F]+') THEN '<HEX(' || n || ')>' WHEN n <= 64 THEN '<PLAIN>' ELSE s[1:32] || '...<LEN=' || n || '>' END AS literal, count(*) AS n,
 count_if(n >= 24 AND regexp_full_match(s, '[A-Za-z0-9+/=]+') AND regexp_matches(s, '[+/=]')) AS base64, count_if(n >= 16 AND regexp_full_match(s, '[0-9a-fA-F]+')) AS hex,
 count_if(regexp_full_match(s, '[a-zA-Z_]\w*(\.[a-zA-Z_]\w*){2,}')) AS package_like FROM u GROUP BY 1""")
def literal_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6-F9, F18 over the words of documents."""
    t = B.table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("s")).where("s <> ''")
    t = t.groupBy("s").agg(F.count("*").alias("k"))  # each different word is classified once
    kind = T.normalize_literal(F.col("s"))
    t = t.withColumn("literal", kind).withColumn("literal", F.when(F.col("literal") == F.col("s"), "<PLAIN>").otherwise(F.col("literal")))
    held = lambda test: F.sum(F.when(test, F.col("k")).otherwise(0))
    return t.groupBy("literal").agg(F.sum("k").alias("n"), held(T.is_base64(F.col("s"))).alias("base64"), held(T.is_hex(F.col("s"))).alias("hex"), held(T.is_package_like(F.col("s"))).alias("package_like"))


_ANY = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_HINT_SQL = ", ".join([*[f"CASE WHEN {_ANY('s', w)} THEN '{k}' END" for k, w in T.HINTS.items()], "CASE WHEN regexp_matches(s, '(?i)https?://|ftp://') THEN 'LIT:URL_PRESENT' END", f"CASE WHEN regexp_matches(s, '{T.IPV4}') THEN 'LIT:IP_PRESENT' END", f"CASE WHEN regexp_matches(s, '{T.HEX_LITERAL}') THEN 'LIT:HEX_LIKE' END", f"CASE WHEN contains(s, '{T.STREAM_EXTRA}') AND {_ANY('s', T.PARCELABLE)} THEN 'HINT:INTENT_EXTRA_STREAM' END"])


@query(f"WITH t AS (SELECT doc_id, text AS s FROM documents) SELECT doc_id, array_to_string(list_sort(list_filter([{_HINT_SQL}], lambda x: x IS NOT NULL)), ',') AS hints FROM t")
def hint_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F25 on documents."""
    return B.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.hints(F.col("text")), ",").alias("hints"))


@query(f"SELECT role, count(*) AS n, sum(CAST(regexp_matches(text, '{_q(T.URL)}') AS INT)) AS has_url, sum(CAST(regexp_matches(text, '{T.IPV4}') AS INT)) AS has_ip, sum(CAST(regexp_matches(text, '{T.DOMAIN}') AS INT)) AS has_domain, sum(CAST({_ANY('text', (*T.NETWORK, 'Socket'))} AS INT)) AS api_network, sum(CAST({_ANY('text', T.CRYPTO)} AS INT)) AS api_crypto, sum(CAST(starts_with(lower(role), 'onreceive') AS INT)) AS cb_onreceive FROM conversations GROUP BY role")
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F21 on conversation turns: how many have each of some features."""
    c = B.table(spark, sf_dir, "conversations").withColumn("f", T.symbolic_features(F.col("role"), F.array(F.coalesce("text", F.lit(""))), F.array(F.coalesce("text", F.lit(""))), F.lit(False), F.array().cast("array<string>")))
    picked = ["has_url", "has_ip", "has_domain", "api_network", "api_crypto", "cb_onreceive"]
    return c.groupBy("role").agg(F.count("*").alias("n"), *[F.sum(F.get("f", T.FEATURES.index(x)).cast("int")).alias(x) for x in picked])


@query(r"""WITH t AS (SELECT source, unnest(list_distinct(string_split_regex(text, '\s+'))) AS t FROM documents), u AS (SELECT source, t, lower(t) AS l FROM t WHERE length(t) >= 3)
SELECT source, t AS token, count(*) AS n FROM u WHERE starts_with(l, 'android.intent.') OR starts_with(l, 'android.permission.') OR regexp_matches(t, '(?i)\A/|/sdcard/|/Android/') OR regexp_matches(t, '(?i)\.apk\z') OR t IN ('GET', 'POST', 'PUT', 'DELETE')
 OR (contains(t, '/') AND (contains(l, 'vnd.android') OR contains(l, 'application/'))) OR (regexp_full_match(t, '[A-Z0-9_]{3,}') AND t NOT IN ('TRUE', 'FALSE')) GROUP BY ALL""")
def lexical_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors among the words of documents, by source."""
    t = B.table(spark, sf_dir, "documents").select("source", F.explode(T.clean_lexical(F.split("text", r"\s+"), 1 << 30)).alias("token"))
    return t.groupBy("source", "token").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT doc_id, [x for x in list_transform(string_split(text, chr(10)), lambda y: trim(y)) if x <> ''] AS ls FROM documents), d AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l), f AS (SELECT doc_id, line, min(i) AS i FROM d GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rank FROM f) SELECT doc_id, line, rank FROM r WHERE rank <= 3""")
def stable_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three distinct lines of each document."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.stable_topk(F.split("text", "\n"), 3)).alias("pos", "line"))
    return d.select("doc_id", "line", (F.col("pos") + 1).cast("long").alias("rank"))


@query("SELECT l_returnflag, coalesce(p_type, 'none') AS perm, count(*) AS n, sum(CASE WHEN p_type IS NOT NULL THEN 1 ELSE 0 END) AS sensitive FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size = 1) ON l_partkey = p_partkey GROUP BY ALL")
def permission_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the permission of their part; the dictionary is joined by the strategy its size allows."""
    perms = B.table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("api_sig"), F.array("p_type").alias("perms"))
    m = B.table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_orderkey").alias("method_sig"), F.array("l_partkey").alias("invokes"))
    rows = units.call_edges(m, perms, ["l_returnflag"])
    perm = F.coalesce(F.get("callee_perms", 0), F.lit("none")).alias("perm")
    return rows.groupBy("l_returnflag", perm).agg(F.count("*").alias("n"), F.sum("callee_is_sensitive").alias("sensitive"))


@query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS perms FROM part GROUP BY p_brand")
def api_permission_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: sorted permission set of each API."""
    lines = F.array_join(F.collect_set(F.concat(F.lit("<a."), "p_brand", F.lit(": void call()>"))), "\n")
    t = B.table(spark, sf_dir, "part").groupBy("p_type").agg(lines.alias("t"))
    m = readers.permission_map(t.select(F.concat(F.lit("Permission: "), "p_type", F.lit("\n"), "t").alias("value")))
    return m.select(F.regexp_extract("api_sig", "La/(.*);->", 1).alias("p_brand"), F.array_join("perms", ",").alias("perms"))


@query("SELECT source, coalesce(CASE WHEN a.toxic = 1 THEN 'toxic' WHEN a.doc_id IS NOT NULL THEN 'clean' END, CASE WHEN b.toxic = 1 THEN 'toxic' WHEN b.doc_id IS NOT NULL THEN 'clean' END, 'unknown') AS family, count(*) AS n FROM documents d LEFT JOIN labels a ON a.doc_id = d.doc_id LEFT JOIN labels b ON b.doc_id = d.doc_id // 2 GROUP BY ALL")
def label_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label by the full key, else by its last part; documents without either count as unknown."""
    full = lambda c: F.concat(c, F.lit("/"), F.floor(c / 2))
    label = B.table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("family"), F.array().cast("array<string>").alias("behaviors"))
    keys = label.select(F.explode(F.array(full(F.col("doc_id")), F.col("doc_id").cast("string"))).alias("apk_id"), "family", "behaviors")
    assigned = B.table(spark, sf_dir, "documents").select(F.col("source").alias("cluster_id"), full(F.col("doc_id")).alias("apk_id"))
    rows = cluster.labelled(assigned, keys)
    return rows.groupBy(F.col("cluster_id").alias("source"), F.coalesce("l.family", F.lit("unknown")).alias("family")).agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) GROUP BY 1")
def anti_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 as an anti join: customers without a large order, by nation."""
    called = B.table(spark, sf_dir, "customer").select(F.lit(0).alias("g"), F.col("c_custkey").alias("callee"), "c_nationkey")
    own = B.table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.lit(0).alias("g"), F.col("o_custkey").alias("sig"))
    outer = graph.external_methods(own, called, ["g"]).select(F.col("sig").alias("callee"))
    return called.join(outer, "callee", "left_semi").groupBy("c_nationkey").agg(F.count("*").alias("n"))


def _graph(spark: SparkSession, sf_dir: str, mark: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables, checkpointed: what follows reads each several times. mark: as in build_edges."""
    calls = cut(B.distinct_calls(spark, sf_dir))
    nodes = cut(graph.build_nodes(B.methods(spark, sf_dir), calls, B.api_perms(spark, sf_dir), B.KEYS))
    return nodes, cut(graph.build_edges(nodes, calls, B.KEYS, mark=mark))


def _adjacency(edges: DataFrame) -> DataFrame:
    """Edges as build_edges makes them, told by is_fwd, hold both directions of each pair; others are counted."""
    return graph.adjacency(edges, B.KEYS, mirrored="is_fwd" in edges.columns)


@query(f"WITH {B.NODES_SQL}, n AS (SELECT g, count(*) AS num_nodes, sum(1 - is_external) AS num_internal, sum(is_external) AS num_external, sum(is_sensitive) AS num_sensitive FROM nodes GROUP BY g), e AS (SELECT g, count(*) AS num_edges, count_if(is_fwd) AS num_edges_fwd FROM edges GROUP BY g) SELECT g, num_nodes, num_internal, num_external, num_sensitive, num_edges, num_edges_fwd FROM n JOIN e USING (g)")
def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of each nation's graph."""
    nodes, edges = _graph(spark, sf_dir)
    return graph.graph_meta(nodes, edges, B.KEYS)


@query(f"WITH {B.NODES_SQL} SELECT g, node_id, sig, is_sensitive, coalesce(CASE WHEN is_sensitive = 1 THEN p_type END, '') AS perms FROM nodes WHERE is_sensitive = 1")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: ids, signatures and permissions of the sensitive nodes."""
    nodes = graph.build_nodes(B.methods(spark, sf_dir), B.distinct_calls(spark, sf_dir), B.api_perms(spark, sf_dir), B.KEYS)
    return nodes.where("is_sensitive = 1").select("g", "node_id", "sig", "is_sensitive", F.array_join("perms", ",").alias("perms"))


@query(f"WITH {B.NODES_SQL} SELECT g, src AS node_id, sum(mult) AS deg FROM adj GROUP BY ALL")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag degrees."""
    _, edges = _graph(spark, sf_dir)
    return graph.degrees(_adjacency(edges), B.KEYS)


_HOPS = f"WITH RECURSIVE {B.NODES_SQL}, hop(g, node_id, dist) AS (SELECT g, node_id, 0 FROM nodes WHERE is_sensitive = 1 UNION SELECT h.g, e.dst, h.dist + 1 FROM hop h JOIN edges e ON e.g = h.g AND e.src = h.node_id WHERE h.dist < 2), near AS (SELECT g, node_id, min(dist) AS dist FROM hop GROUP BY ALL)"


@query(f"{_HOPS} SELECT g, dist, count(*) AS n FROM near GROUP BY ALL")
def khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by hops from the sensitive ones, up to two."""
    nodes, edges = _graph(spark, sf_dir, "is_sensitive")
    found = graph.khop(_adjacency(edges), nodes.where("is_sensitive = 1"), 2, B.KEYS, mark="is_sensitive")
    return found.groupBy("g", "dist").agg(F.count("*").alias("n"))


_PPR = ", ".join(f"p{i} AS (SELECT g, node_id, sum(p) AS p FROM (SELECT g, node_id, 0.15 * s AS p FROM seeds UNION ALL SELECT p.g, a.dst, 0.85 * p.p * a.mult / t.total FROM p{i - 1} p JOIN adj a ON a.g = p.g AND a.src = p.node_id JOIN totals t ON t.g = p.g AND t.src = p.node_id) GROUP BY ALL)" for i in range(1, 26))
_PPR_SQL = f"WITH {B.NODES_SQL}, seeds AS (SELECT g, node_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY g) AS s FROM nodes WHERE is_sensitive = 1), totals AS (SELECT g, src, sum(mult) AS total FROM adj GROUP BY ALL), p0 AS (SELECT g, node_id, s AS p FROM seeds), {_PPR} SELECT g, node_id, round(p, 9) AS ppr FROM p25"


@query(_PPR_SQL)
def ppr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 25 rounds from the sensitive nodes, in a task a graph or, with graphs too large for one, a join and a sum each; every ranked node."""
    nodes, edges = _graph(spark, sf_dir)
    p = graph.ppr_by_size(_adjacency(edges), nodes.where("is_sensitive = 1"), B.KEYS)
    return p.select("g", "node_id", F.round("ppr", 9).alias("ppr"))


@query(_PPR_SQL)
def ppr_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7 with all 25 rounds of a graph in one task; every ranked node."""
    nodes, edges = _graph(spark, sf_dir)
    p = graph.ppr_per_graph(_adjacency(edges), nodes.where("is_sensitive = 1"), B.KEYS)
    return p.select("g", "node_id", F.round("ppr", 9).alias("ppr"))


@query()
def ppr_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7 as `ppr`, ranks not rounded."""
    nodes, edges = _graph(spark, sf_dir)
    return graph.ppr_by_size(_adjacency(edges), nodes.where("is_sensitive = 1"), B.KEYS)


@query()
def ppr_grouped_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7 as `ppr_grouped`, ranks not rounded."""
    nodes, edges = _graph(spark, sf_dir)
    return graph.ppr_per_graph(_adjacency(edges), nodes.where("is_sensitive = 1"), B.KEYS)


_SWEEP = f"""{_HOPS}, deg AS (SELECT g, src AS node_id, sum(mult) AS d FROM adj GROUP BY ALL), cand AS (SELECT n.g, n.node_id, CAST(coalesce(d, 0) AS DOUBLE) AS score, coalesce(s.is_sensitive, 0) AS a FROM near n LEFT JOIN deg USING (g, node_id) JOIN nodes s USING (g, node_id)),
 rk AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY a DESC, CASE WHEN a = 0 THEN score END DESC NULLS FIRST, node_id) AS r FROM cand),
 gain AS (SELECT x.g, x.node_id, sum(mult) AS deg, sum(CASE WHEN y.r <= x.r THEN mult ELSE 0 END) AS back FROM rk x JOIN adj e ON e.g = x.g AND e.src = x.node_id JOIN rk y ON y.g = x.g AND y.node_id = e.dst GROUP BY ALL),
 run AS (SELECT rk.*, sum(coalesce(deg, 0) - 2 * coalesce(back, 0)) OVER w AS boundary, sum(coalesce(deg, 0)) OVER w AS vol, sum(coalesce(deg, 0)) OVER (PARTITION BY rk.g) AS total, sum(a) OVER w AS held, sum(a) OVER (PARTITION BY rk.g) AS anchors FROM rk LEFT JOIN gain USING (g, node_id) WINDOW w AS (PARTITION BY rk.g ORDER BY r ROWS UNBOUNDED PRECEDING)),
 phi AS (SELECT g, r, boundary / greatest(1, least(vol, greatest(total - vol, 1))) AS phi FROM run WHERE held = anchors AND r BETWEEN 8 AND 120), best AS (SELECT g, arg_min(r, (phi, r)) AS k, min(phi) AS phi FROM phi GROUP BY g),
 picked AS (SELECT run.g, node_id, a, coalesce(phi, 1e9) AS phi FROM run LEFT JOIN best USING (g) WHERE r <= coalesce(k, greatest(anchors, 8)))"""


def _picked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    nodes, edges = _graph(spark, sf_dir, "is_sensitive")
    adj, anchors = _adjacency(edges), nodes.where("is_sensitive = 1").select("g", "node_id")
    near = graph.khop(adj, anchors, 2, B.KEYS, mark="is_sensitive")
    scored = near.join(graph.degrees(adj, B.KEYS), ["g", "node_id"], "left").select("g", "node_id", F.coalesce("deg", F.lit(0)).cast("double").alias("score"))
    return nodes, edges, adj, anchors, cut(graph.sweep_cut(adj, scored, anchors, B.KEYS))


@query(f"{_SWEEP} SELECT g, count(*) AS n, sum(a) AS anchors, sum(node_id) AS ids, round(max(phi), 6) AS phi FROM picked GROUP BY g")
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix of least conductance around the sensitive nodes, ranked by degree."""
    nodes, _, _, _, picked = _picked(spark, sf_dir)
    rows = picked.join(nodes.select("g", "node_id", "is_sensitive"), ["g", "node_id"])
    return rows.groupBy("g").agg(F.count("*").alias("n"), F.sum("is_sensitive").alias("anchors"), F.sum("node_id").alias("ids"), F.round(F.max("phi"), 6).alias("phi"))


@query(f"{_SWEEP}, k AS (SELECT p.g, p.node_id, p.a, n.is_external, n.is_sensitive FROM picked p JOIN nodes n USING (g, node_id)), fed AS (SELECT x.g, x.node_id, sum(mult) AS deg_in FROM k x JOIN adj e ON e.g = x.g AND e.src = x.node_id JOIN k y ON y.g = x.g AND y.node_id = e.dst AND y.is_external = 0 GROUP BY ALL), kept AS (SELECT k.* FROM k LEFT JOIN fed USING (g, node_id) WHERE NOT (a = 0 AND is_external = 1 AND is_sensitive = 0 AND coalesce(deg_in, 0) <= 1)), inside AS (SELECT e.g, count(*) AS n_edges FROM edges e JOIN kept a ON a.g = e.g AND a.node_id = e.src JOIN kept b ON b.g = e.g AND b.node_id = e.dst GROUP BY e.g), m AS (SELECT g, count(*) AS n FROM kept GROUP BY g) SELECT m.g, n, coalesce(n_edges, 0) AS n_edges FROM m LEFT JOIN inside ON inside.g = m.g")
def prune_and_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pick without loose externals, and the edges inside it."""
    nodes, edges, _, anchors, picked = _picked(spark, sf_dir)
    among = cut(graph.unit_edges(edges, picked, B.KEYS, []))  # few of all edges, which are moved once for both steps
    kept = graph.prune_external(picked, nodes, graph.adjacency(among, B.KEYS, mirrored="is_fwd" in edges.columns), anchors, B.KEYS)
    inside = graph.unit_edges(among, kept, B.KEYS, []).groupBy("g").agg(F.count("*").alias("n_edges"))
    return kept.groupBy("g").agg(F.count("*").alias("n")).join(inside, "g", "left").na.fill(0, ["n_edges"])


def _vectors(spark: SparkSession, sf_dir: str, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node's vec_id, and the vectors: many nodes share one."""
    e = B.table(spark, sf_dir, "embeddings")
    n = e.count()
    return nodes.select("g", "node_id", F.pmod(F.col("node_id").cast("long"), F.lit(n)).alias("vec_id")), e.select("vec_id", F.col("embedding").cast("array<double>").alias("h"))


@query()
def anchor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of sensitive nodes within two hops and with cosine 0.3."""
    nodes, edges = _graph(spark, sf_dir, "is_sensitive")
    links = graph.anchor_links(_adjacency(edges), nodes, _vectors(spark, sf_dir, nodes), B.KEYS, 2, 0.3)
    return graph.anchor_groups(nodes, links, B.KEYS)


@query()
def mine_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviour units of the nations' graphs."""
    nodes, edges = _graph(spark, sf_dir, "is_sensitive")
    return graph.mine_units(nodes, edges, _vectors(spark, sf_dir, nodes), B.KEYS, link_hops=2, link_threshold=0.3, hops=2, iterations=10, mirrored="is_fwd" in edges.columns)


@query()
def propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of two mean-neighbour layers."""
    nodes, edges = _graph(spark, sf_dir)
    x = nodes.select("g", "node_id", F.array(F.col("is_external").cast("double"), F.col("is_sensitive").cast("double"), F.lit(1.0)).alias("x"))
    return graph.propagate(x, edges, B.KEYS, width=8)


_VEC = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings"


@query(f"WITH e AS ({_VEC}), n AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM e) SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.v, b.v), 6) AS sim FROM n a JOIN n b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_inner_product(a.v, b.v) >= 0.3")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one label with cosine 0.3; blocks of a label's vectors meet in pairs."""
    e = B.table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieve.cosine_pairs(e, ["label"], 0.3).select("a", "b", F.round("sim", 6).alias("sim"))


@query(f"WITH e AS ({_VEC}), p AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM e) SELECT label, i, round(avg(x), 6) AS x FROM p GROUP BY ALL")
def pooled_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of each label."""
    e = B.table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("ord"), F.col("embedding").cast("array<double>").alias("h"))
    return units.pool_units(e, ["label"]).select("label", F.posexplode("unit_emb").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


_CENTER = f"e AS ({_VEC}), p AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label), u AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS c FROM c)"


def _near_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("unit_emb"))
    c = units.pool_units(e.select("label", F.col("vec_id").alias("ord"), F.col("unit_emb").alias("h")), ["label"], mode="mean_norm").withColumnRenamed("unit_emb", "center")
    return e.join(c, "label").select("vec_id", "label", V.multi_view_similarity({"unit_emb": F.col("unit_emb")}, {"unit_emb": F.col("center")}).alias("sim"))


@query(f"WITH {_CENTER} SELECT vec_id, label, round(list_inner_product(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))), c), 6) AS sim FROM e JOIN u USING (label)")
def weighted_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5 with one view: vectors against their label's center."""
    return _near_center(spark, sf_dir).withColumn("sim", F.round("sim", 6))


@query(f"WITH {_CENTER}, s AS (SELECT vec_id, label, round(list_inner_product(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))), c), 6) AS sim FROM e JOIN u USING (label)), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rank FROM s) SELECT label, rank, vec_id, sim FROM r WHERE rank <= 20")
def member_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest members of each label."""
    s = _near_center(spark, sf_dir).select(F.col("label").alias("cluster_id"), F.col("vec_id").alias("unit_id"), F.col("vec_id").alias("ord"), F.lit("merge").alias("action"), F.round("sim", 6).alias("semantic_sim"))
    top = cluster.top_members(s, s.select("unit_id", F.lit(1.0).alias("q")))
    return top.select(F.col("cluster_id").alias("label"), F.col("rank").cast("long").alias("rank"), F.col("unit_id").alias("vec_id"), "sim")


@query("SELECT doc_id, round(1 + 0.6 * ln(1 + len(list_distinct(string_split(text, ' ')))) + 0.5 * ln(1 + len(string_split(text, chr(10)))) + 0.4 * ln(1 + length(source)), 6) AS q, round(least(greatest(ln(1 + 1 + 0.6 * ln(1 + len(list_distinct(string_split(text, ' ')))) + 0.5 * ln(1 + len(string_split(text, chr(10)))) + 0.4 * ln(1 + length(source))), 0.5), 3.0), 6) AS weight FROM documents")
def q_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8, V9 on sizes of documents' parts."""
    q = V.quality(sapi=F.size(F.array_distinct(F.split("text", " "))), perms=F.size(F.split("text", "\n")), hints=F.length("source"))
    return B.table(spark, sf_dir, "documents").select("doc_id", F.round(q, 6).alias("q"), F.round(V.update_weight(q), 6).alias("weight"))


@query(f"WITH {B.UNITS_SQL}, t AS (SELECT unit_id, unnest(psi) AS t FROM units), rare AS (SELECT t FROM t GROUP BY t HAVING count(*) BETWEEN 2 AND 8), c AS (SELECT DISTINCT a.unit_id AS a, b.unit_id AS b FROM t a JOIN rare USING (t) JOIN t b USING (t) WHERE a.unit_id < b.unit_id) SELECT a, b, round(len(list_intersect(x.psi, y.psi)) / len(list_distinct(list_concat(x.psi, y.psi))), 6) AS jac FROM c JOIN units x ON x.unit_id = a JOIN units y ON y.unit_id = b WHERE len(list_intersect(x.psi, y.psi)) / len(list_distinct(list_concat(x.psi, y.psi))) >= 0.5")
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a rare token in common whose token sets agree by half; pairs join on the token.

    Sets of which one has over twice the other's tokens can't agree by half: such pairs go before sets travel to them.
    """
    u = B.document_units(spark, sf_dir)
    t = u.select("unit_id", F.size("psi").alias("n"), F.explode("psi").alias("t"))
    rare = t.groupBy("t").agg(F.count("*").alias("held")).where("held between 2 and 8").select("t")
    t = t.join(rare, "t")
    c = t.withColumnsRenamed({"unit_id": "a", "n": "n_a"}).join(t.withColumnsRenamed({"unit_id": "b", "n": "n_b"}), "t")
    c = c.where("a < b and 2 * least(n_a, n_b) >= greatest(n_a, n_b)").select("a", "b").distinct()
    c = c.join(u.select(F.col("unit_id").alias("a"), F.col("psi").alias("x")), "a").join(u.select(F.col("unit_id").alias("b"), F.col("psi").alias("y")), "b")
    return c.withColumn("jac", X.jaccard(F.col("x"), F.col("y"))).where("jac >= 0.5").select("a", "b", F.round("jac", 6).alias("jac"))


@query(f"""WITH {B.UNITS_SQL}, r AS (SELECT unit_id, list_sort(psi) AS psi, min(unit_id) OVER (PARTITION BY list_sort(psi)) AS rep FROM units), d AS MATERIALIZED (SELECT rep AS id, psi, len(psi) AS n FROM r WHERE unit_id = rep),
 p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.psi, b.psi)) AS s, a.n + b.n AS n FROM d a JOIN d b ON a.id < b.id AND 2 * least(a.n, b.n) >= greatest(a.n, b.n) AND a.n > 0)
 SELECT 'equal' AS kind, rep AS a, unit_id AS b, 1.0::DOUBLE AS jac FROM r WHERE unit_id <> rep UNION ALL SELECT 'near', a, b, round(s / (n - s), 6) FROM p WHERE 3 * s >= n""")
def token_jaccard_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5, C6, J12 whole: all documents whose token sets agree by half, however common their tokens (`token_jaccard` asks for a rare one)."""
    return retrieve.similar_sets(B.document_units(spark, sf_dir), 1, 2)


_FREQ = f"WITH {B.UNITS_SQL}, t AS (SELECT cluster_id, unnest(psi) AS token FROM units), n AS (SELECT cluster_id, token, count(*) AS cnt FROM t GROUP BY ALL), s AS (SELECT cluster_id, count(*) AS size FROM units GROUP BY ALL), f AS (SELECT cluster_id, token, cnt, row_number() OVER (PARTITION BY cluster_id ORDER BY cnt DESC, token DESC) AS r FROM n JOIN s USING (cluster_id) WHERE cnt >= 0.5 * size), freq AS (SELECT * FROM f WHERE r <= 256)"


def _frequent(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    u = B.document_units(spark, sf_dir)
    counts = u.select("cluster_id", F.explode("psi").alias("token")).groupBy("cluster_id", "token").agg(F.count("*").alias("cnt"))
    return u, cluster.frequent_psi(counts, cluster.cluster_sizes(u))


@query(f"{_FREQ} SELECT cluster_id, token, cnt FROM freq")
def frequent_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in half of a source's documents."""
    return _frequent(spark, sf_dir)[1]


@query(f"{_FREQ}, k AS (SELECT cluster_id, count(*) AS k FROM freq GROUP BY ALL), c AS (SELECT unit_id, f.cluster_id, count(*) AS shared FROM (SELECT unit_id, unnest(psi) AS token FROM units) u JOIN freq f USING (token) GROUP BY ALL), j AS (SELECT c.unit_id, c.cluster_id, shared / (len(psi) + k - shared) AS jac FROM c JOIN k ON k.cluster_id = c.cluster_id JOIN units u ON u.unit_id = c.unit_id), r AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY jac DESC, cluster_id) AS rank FROM j WHERE jac >= 0.05) SELECT unit_id, rank, cluster_id, round(jac, 6) AS jac FROM r WHERE rank <= 3")
def retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three sources whose frequent tokens a document matches best."""
    u, freq = _frequent(spark, sf_dir)
    one = F.array(F.lit(1.0))
    sources = freq.select("cluster_id").distinct().withColumn("unit_emb", one)
    out = retrieve.rank_clusters(u.withColumn("unit_emb", one), sources, freq, tau=0.5, gamma=0.05, k=3)
    return out.select("unit_id", F.col("rank").cast("long").alias("rank"), "cluster_id", F.round("jac", 6).alias("jac"))


def _embedded_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "embeddings")
    psi = F.array(F.concat(F.lit("LIT:"), F.col("label").cast("string")), F.concat(F.lit("PERM:"), F.pmod("vec_id", F.lit(3)).cast("string"), F.lit("-"), F.col("label").cast("string")))
    return e.select(F.col("vec_id").alias("ord"), F.format_string("unit_%06d", "vec_id").alias("unit_id"), psi.alias("psi"), F.lit(2.0).alias("q"), F.col("embedding").cast("array<double>").alias("unit_emb"))


@query()
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered clustering of vectors with their label's tokens."""
    return cluster.leader_clusters(_embedded_units(spark, sf_dir), cluster.Params(tau=0.2, gamma=0.1))


@query()
def cluster_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: centers after the pass, folded again from the assignments."""
    u = _embedded_units(spark, sf_dir)
    return cluster.centers(u, cluster.leader_clusters(u, cluster.Params(tau=0.2, gamma=0.1)))


@query("SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 2) AS INT) AS batch FROM conversations")
def batching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in batches of two."""
    return retrieve.batches(B.table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 2).select("conv_id", "turn", "batch")


@query("""SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS total FROM events GROUP BY event_type""")
def json_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties wrapped in prose, found again and read."""
    wrapped = F.concat(F.lit("Answer: "), "props", F.lit(" (end)"))
    k = S.number(F.get_json_object(S.safe_json(wrapped), "$.k"))
    return B.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


_STRONG_SQL = " + ".join(f"CAST(contains(lower(text), '{k}') AS INT)" for k in (*S.STRONG,))


@query(f"""WITH s AS (SELECT d.doc_id, coalesce(toxic, 0) AS toxic, {_STRONG_SQL} AS hits, CASE WHEN coalesce(toxic, 0) = 1 THEN 90.0 ELSE 40.0 END AS conf FROM documents d LEFT JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN toxic = 0 THEN 'benign' WHEN conf >= 70 AND hits >= 1 THEN 'malicious' ELSE 'unknown' END AS verdict, conf AS confidence, hits AS strong_hits,
 CASE WHEN toxic = 1 AND hits < 1 THEN 'verdict_gate: weaken malicious->unknown (conf=' || printf('%.1f', conf) || ', strong_hits=' || hits || ', behaviors=1)' ELSE '' END AS note FROM s""")
def verdict_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents through the gate."""
    d = B.table(spark, sf_dir, "documents").join(B.table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    toxic = F.coalesce("toxic", F.lit(0)) == 1
    g = S.gate(F.when(toxic, "Malicious").otherwise("benign"), F.when(toxic, "90").otherwise("40"), F.lit("f"), F.array("text"), F.array().cast("array<string>"), F.lit(""))
    return d.select("doc_id", g.alias("x")).select("doc_id", "x.verdict", "x.confidence", "x.strong_hits", "x.note")


@query()
def fold_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations folded into one state each, with the offline stand-in for a model."""
    c = B.table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").cast("string").alias("apk_id"), F.format_string("t%06d", "turn").alias("bu_id"), F.col("turn").alias("rank"), F.coalesce("text", F.lit("")).alias("summary"))
    return decide.fold_states(rows)


@query("""WITH m AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer), r AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS role FROM m) SELECT k AS class_name, array_to_string(list_sort(list(lower(role))), ',') AS roles FROM r GROUP BY k""")
def role_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted role set of each class."""
    c = B.table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").alias("class_name")).agg(F.array_join(F.array_sort(F.collect_set(F.lower("c_mktsegment"))), ",").alias("roles"))


@query("WITH c AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) SELECT o_orderkey, r AS rank FROM c")
def creation_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1's numbering: rank over all rows by ranges, no task sorts them all."""
    o = B.table(spark, sf_dir, "orders").select("o_orderkey")
    return cluster.rank_in_ranges(o, "o_orderkey", 10_000).select("o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT 'Lcom/x/' || p_partkey || ';->call(Ljava/lang/String;[I)I' AS api_sig, 'android.permission.' || p_brand AS perms FROM part")
def permission_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7, F20, A1, W12 on mapping texts made out of suppliers' permissions and parts' signatures."""
    lines = B.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<com.x."), F.col("p_partkey").cast("string"), F.lit(": int call(java.lang.String,int[])> ()")))), "\n").alias("t"))
    m = readers.permission_map(lines.select(F.concat(F.lit("Permission:android.permission."), "p_brand", F.lit("\n"), "t").alias("value")))
    return m.withColumn("perms", F.array_join("perms", ","))
