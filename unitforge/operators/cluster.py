"""Prototypes: ordered leader clustering of units, and views on its outcome.

Each unit sees the clusters as all earlier ones left them, so the pass is an ordered fold. Units that share no token, not even through
others, can never meet; so the fold runs apart for every connected component of units and tokens.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import SEMANTIC, SYMBOLIC, VIEWS
from .lineage import cut


@dataclass(frozen=True)
class Params:
    """Thresholds and limits of the clustering."""

    tau: float = 0.70
    gamma: float = 0.10
    eta: float = 0.50
    cap: int = 256
    top_psi: int = 1024
    members: int = 20
    exemplars: int = 8
    exemplar_sim: float = 0.85
    max_step: float = 0.02
    fallback_step: float = 0.02
    min_weight: float = 0.5
    max_weight: float = 3.0
    audit: int = 32


ASSIGNED = "shard long, ord long, unit_id string, cluster_ord long, action string, semantic_sim double, symbolic_jaccard double"
_LISTED = "array<struct<unit_id:string,q:double,sim:double>>"
STATE = f"struct<size:long,n_eff:double,centers:map<string,array<double>>,psi:array<struct<token:string,cnt:long>>,members:{_LISTED},exemplars:{_LISTED},audit:map<string,array<string>>>"


def _unit(v: list[float]) -> list[float]:
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else list(v)


class _Cluster:
    """A prototype while it grows. All that it holds is bounded by the parameters and by the vectors' width."""

    def __init__(self, size: int, mass: float, centers: dict[str, list[float]], counts: dict[str, int], members: list, exemplars: list, audit: dict[str, list[str]], p: Params):
        self.size, self.mass, self.centers, self.counts, self.members, self.exemplars, self.audit = size, mass, centers, Counter(counts), members, exemplars, audit
        self.refresh(p)

    @classmethod
    def first(cls, unit_id: str, views: dict[str, list[float]], psi: list[str], q: float, lists: dict[str, list[str]], p: Params) -> _Cluster:
        own = [[unit_id, q, 1.0]]
        return cls(1, 1.0, {k: list(v) for k, v in views.items()}, dict.fromkeys(psi, 1), own[: p.members], own[: p.exemplars], {k: [str(x) for x in v][: p.audit] for k, v in lists.items()}, p)

    def refresh(self, p: Params) -> None:
        least = p.eta * self.size
        ranked = sorted(((n, t) for t, n in self.counts.items() if n >= least), reverse=True)
        self.frequent = {t for _, t in ranked[: p.cap]}

    def likeness(self, views: dict[str, list[float]], weights: dict[str, float]) -> float:
        both = [(w, _unit(views[k]), self.centers[k]) for k, w in weights.items() if k in views and k in self.centers and len(views[k]) == len(self.centers[k])]
        total = sum(w for w, _, _ in both)
        return sum(w * math.fsum(x * y for x, y in zip(a, b, strict=True)) for w, a, b in both) / total if total > 0 else -1.0

    def take_in(self, unit_id: str, views: dict[str, list[float]], psi: list[str], q: float, sim: float, lists: dict[str, list[str]], p: Params) -> None:
        self.size += 1
        weight = min(max(math.log1p(max(q, 0.0)), p.min_weight), p.max_weight)
        step = min(max(weight / (self.mass + weight) if self.mass > 0 else p.fallback_step, 1e-6), p.max_step)
        for k, v in views.items():
            old = self.centers.get(k)
            self.centers[k] = _unit([(1 - step) * a + step * b for a, b in zip(old, v)]) if old else list(v)  # noqa: B905
        self.mass += weight
        self.counts.update(psi)
        if len(self.counts) > p.top_psi:  # ties by token, so that the outcome is the same each time
            self.counts = Counter(dict(sorted(self.counts.items(), key=lambda x: (-x[1], x[0]))[: p.top_psi]))
        self.refresh(p)
        for k, items in lists.items():
            own = self.audit.setdefault(k, [])
            for x in (str(i).strip() for i in items):
                if len(own) < p.audit and x and x not in own:
                    own.append(x)
        best = lambda xs: sorted(xs, key=lambda x: (-x[2], -x[1]))  # noqa: E731  stable: of equals the one that came first
        self.members = best([*self.members, [unit_id, q, sim]])[: p.members]
        if sim >= p.exemplar_sim:
            seen: dict[str, list] = {}
            for x in best([*self.exemplars, [unit_id, q, sim]]):
                seen.setdefault(x[0], x)
            self.exemplars = list(seen.values())[: p.exemplars]

    def state(self) -> tuple:
        """The fields of STATE; psi by falling count."""
        psi = sorted(self.counts.items(), key=lambda x: (-x[1], x[0]))
        return (self.size, self.mass, self.centers, psi, self.members, self.exemplars, self.audit)


class Pass:
    """The clusters while units pass in order: of candidates with equal scores the one made first wins.

    clusters and holding (token -> numbers of the clusters that hold it often) may be any mappings; changed and moved tell which
    of their entries the units since the last reset changed.
    """

    def __init__(self, p: Params, weights: dict[str, float], clusters: dict[int, _Cluster] | None = None, holding: dict[str, set[int]] | None = None):
        self.p, self.weights = p, weights
        self.clusters = {} if clusters is None else clusters
        self.holding = defaultdict(set) if holding is None else holding
        self.changed: set[int] = set()
        self.moved: set[str] = set()

    def take(self, number: int, unit_id: str, psi: set[str], q: float, views: dict[str, list[float]], lists: dict[str, list[str]]) -> tuple[int, str, float, float]:
        """(cluster, action, semantic_sim, symbolic_jaccard); number is that of the cluster which the unit makes if none takes it in."""
        p, best = self.p, None
        for c in sorted(set().union(*[self.holding[t] for t in psi])):
            sem = self.clusters[c].likeness(views, self.weights)
            if sem < p.tau:
                continue
            freq = self.clusters[c].frequent
            jac = len(psi & freq) / len(psi | freq) if psi | freq else 1.0
            if jac < p.gamma:
                continue
            score = SEMANTIC * sem + SYMBOLIC * jac
            if score > -1.0 and (best is None or score > best[0]):
                best = (score, sem, jac, c)
        if best is None:
            c, sem, jac, action, before = number, 1.0, 1.0, "create", set()
            self.clusters[c] = _Cluster.first(unit_id, views, sorted(psi), q, lists, p)
        else:
            _, sem, jac, c = best
            action, before = "merge", self.clusters[c].frequent
            self.clusters[c].take_in(unit_id, views, sorted(psi), q, sem, lists, p)
        after = self.clusters[c].frequent
        for t in before - after:
            self.holding[t].discard(c)
        for t in after - before:
            self.holding[t].add(c)
        self.changed.add(c)
        self.moved |= before ^ after
        return c, action, round(sem, 6), round(jac, 6)


def unit_views(row, views: list[str]) -> dict[str, list[float]]:
    """The row's vectors that are there and without nulls and NaN."""
    own = {}
    for v in views:
        x = getattr(row, v)
        if x is not None and len(x) and not any(y is None or y != y for y in x):
            own[v] = [float(y) for y in x]
    return own


def _fold(p: Params, weights: dict[str, float], views: list[str], audit: list[str], states: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, now = None, None
        columns = [f.split()[0] for f in ASSIGNED.split(", ")] + ["state"]

        def ended() -> Iterator[pd.DataFrame]:
            made = sorted(now.clusters) if now and states else []
            for at in range(0, len(made), 256):
                part = made[at : at + 256]
                rows = [(shard, None, None, c, None, None, None, _as_dict(now.clusters[c].state())) for c in part]
                yield pd.DataFrame(rows, columns=columns)

        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.shard != shard:
                    if out:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                    yield from ended()
                    shard, now = row.shard, Pass(p, weights)
                lists = {c: [x for x in v] for c in audit if (v := getattr(row, c)) is not None}
                c, *rest = now.take(int(row.ord), row.unit_id, set(row.psi), float(row.q), unit_views(row, views), lists)
                out.append((shard, row.ord, row.unit_id, c, *rest, None))
            if out:
                yield pd.DataFrame(out, columns=columns)
        yield from ended()

    return run


def _as_dict(state: tuple) -> dict:
    size, mass, centers, psi, members, exemplars, audit = state
    listed = lambda xs: [{"unit_id": u, "q": q, "sim": s} for u, q, s in xs]
    return {"size": size, "n_eff": mass, "centers": centers, "psi": [{"token": t, "cnt": n} for t, n in psi], "members": listed(members), "exemplars": listed(exemplars), "audit": audit}


def token_shards(units: DataFrame, rounds: int = 30) -> DataFrame:
    """units with shard: the smallest ord of the component of units and tokens that a unit belongs to.

    Labels spread from units to tokens and back until none falls; every round is checkpointed.
    """
    pairs = cut(units.select("ord", F.explode("psi").alias("token")))
    label = units.select("ord", F.col("ord").alias("shard"))
    for _ in range(rounds):
        low = pairs.join(label, "ord").groupBy("token").agg(F.min("shard").alias("low"))
        new = pairs.join(low, "token").groupBy("ord").agg(F.min("low").alias("shard"))
        jumped = new.join(label.select(F.col("ord").alias("shard"), F.col("shard").alias("up")), "shard").select("ord", F.least("shard", "up").alias("shard"))
        jumped = cut(jumped)
        same = jumped.join(label.withColumnRenamed("shard", "old"), "ord").where("shard <> old").isEmpty()
        label = jumped
        if same:
            return units.join(label, "ord")
    raise RuntimeError(f"units' shards did not settle in {rounds} rounds: raise rounds")


def _folded(units: DataFrame, params: Params, weights: dict[str, float], shards: bool, audit: list[str], states: bool) -> DataFrame:
    """ASSIGNED rows in which each unit has one, and each cluster one with its state where these are wanted.

    A shard's units stream through one task sorted by ord, batch by batch: it holds the clusters, never the units.
    """
    views = [v for v in weights if v in units.columns]
    live = units.where(F.size("psi") > 0).withColumn("ord", F.col("ord").cast("long"))
    live = token_shards(live) if shards else live.withColumn("shard", F.lit(0).cast("long"))
    rows = live.select("shard", "ord", "unit_id", "psi", F.col("q").cast("double").alias("q"), *views, *audit)
    return rows.repartition("shard").sortWithinPartitions("shard", "ord").mapInPandas(_fold(params, weights, views, list(audit), states), f"{ASSIGNED}, state {STATE}")


def _numbered(done: DataFrame) -> DataFrame:
    """(cluster_ord, cluster_id): creations numbered by ord: ranks within ranges of ord, plus the counts of the ranges before."""
    made = done.where("action = 'create'").select("cluster_ord", "ord")
    return rank_in_ranges(made, "ord", 10_000).select("cluster_ord", F.format_string("p_%06d", "rank").alias("cluster_id"))


def leader_clusters(units: DataFrame, params: Params = Params(), weights: dict[str, float] = VIEWS, shards: bool = True) -> DataFrame:  # noqa: B008
    """(ord, unit_id, cluster_id, action, semantic_sim, symbolic_jaccard), one row a unit with tokens.

    units: (ord, unit_id, psi, q, views...), ord being the order of the pass. Cluster ids p_%06d count creations in that order. Of candidates
    with equal scores the one made first wins. P9: units without tokens are left out.
    """
    done = cut(_folded(units, params, weights, shards, [], False).drop("state"))
    return done.join(_numbered(done), "cluster_ord").select("ord", "unit_id", "cluster_id", "action", "semantic_sim", "symbolic_jaccard")


def leader_prototypes(units: DataFrame, params: Params = Params(), weights: dict[str, float] = VIEWS, shards: bool = True, audit: list[str] = ()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """What leader_clusters gives, and (cluster_id, size, n_eff, centers, psi, members, exemplars, audit) as the pass left them.

    The best members, exemplars, audit lists and centers are kept while units pass, as bounded parts of a cluster's state; members and
    exemplars of equal likeness and quality stand in the order of their coming. audit names columns of units with lists of texts: those
    of a cluster's first unit are taken as they are, later ones stripped and once each, up to params.audit.
    """
    done = cut(_folded(units, params, weights, shards, audit, True))
    ids = cut(_numbered(done))
    assigned = done.where("unit_id is not null").join(ids, "cluster_ord").select("ord", "unit_id", "cluster_id", "action", "semantic_sim", "symbolic_jaccard")
    return assigned, done.where("state is not null").select("cluster_ord", "state.*").join(ids, "cluster_ord").drop("cluster_ord")


def rank_in_ranges(df: DataFrame, order: str, width: int) -> DataFrame:
    """Append rank: position by a unique long column over all rows, without sorting them in one task."""
    df = df.withColumn("_range", F.floor(F.col(order) / width))
    sizes = df.groupBy("_range").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    starts = sizes.select("_range", before.alias("_before"))
    return df.join(starts, "_range").withColumn("rank", F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(order))).drop("_range", "_before")


def psi_counts(units: DataFrame, assigned: DataFrame, top: int = 1024) -> DataFrame:
    """(cluster_id, token, cnt): how many members hold a token, the most frequent `top` of each cluster, ties by token."""
    rows = units.select("unit_id", F.explode("psi").alias("token")).join(assigned.select("unit_id", "cluster_id"), "unit_id")
    counts = rows.groupBy("cluster_id", "token").agg(F.count("*").alias("cnt"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("cnt"), "token"))).where(F.col("r") <= top).drop("r")


def frequent_psi(counts: DataFrame, sizes: DataFrame, eta: float = 0.5, cap: int = 256) -> DataFrame:
    """(cluster_id, token, cnt) held by at least eta of a cluster's members, the first `cap` by falling count and token."""
    rows = counts.join(sizes, "cluster_id").where((F.col("size") > 0) & (F.col("cnt") >= eta * F.col("size")))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("cnt"), F.desc("token"))
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap).select("cluster_id", "token", "cnt")


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster_id").agg(F.count("*").alias("size"))


def centers(units: DataFrame, assigned: DataFrame, params: Params = Params(), view: str = "unit_emb") -> DataFrame:  # noqa: B008
    """(cluster_id, center, n_eff) of given assignments after all members in their order.

    A cluster's members stream through one task sorted by ord; it holds a center, not the members.
    """
    import numpy as np

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, center, mass = None, None, 0.0
        for pdf in batches:
            done = []
            for c, v, w in zip(pdf["cluster_id"], pdf["v"], pdf["w"], strict=True):
                if c != own:
                    if own is not None:
                        done.append((own, center, mass))
                    own, center, mass, first = c, None, 1.0, True
                else:
                    first = False
                step = min(max(w / (mass + w), 1e-6), params.max_step)
                if v is not None and len(v):
                    v = np.asarray(v, float)
                    if center is None:
                        center = v
                    elif not first:
                        moved = (1 - step) * center + step * v
                        center = moved / (math.sqrt(float((moved * moved).sum())) or 1.0)
                mass += 0.0 if first else w
            if done:
                yield pd.DataFrame(done, columns=["cluster_id", "center", "n_eff"])
        if own is not None:
            yield pd.DataFrame([(own, center, mass)], columns=["cluster_id", "center", "n_eff"])

    w = F.least(F.greatest(F.log1p(F.greatest("q", F.lit(0.0))), F.lit(params.min_weight)), F.lit(params.max_weight))
    rows = units.select(F.col("ord").cast("long").alias("ord"), "unit_id", w.alias("w"), F.col(view).cast("array<double>").alias("v")).join(assigned.select("ord", "unit_id", "cluster_id"), ["ord", "unit_id"])
    rows = rows.select("cluster_id", "ord", "v", "w").repartition("cluster_id").sortWithinPartitions("cluster_id", "ord")
    return rows.mapInPandas(fold, "cluster_id string, center array<double>, n_eff double")


def top_members(assigned: DataFrame, quality: DataFrame, k: int = 20) -> DataFrame:
    """(cluster_id, rank, unit_id, sim, q): members by falling similarity and quality, ties by arrival."""
    rows = assigned.join(quality.select("unit_id", "q"), "unit_id").withColumn("sim", F.when(F.col("action") == "create", 1.0).otherwise(F.col("semantic_sim")))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("sim"), F.desc("q"), "ord")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("cluster_id", "rank", "unit_id", "sim", "q")


def exemplars(assigned: DataFrame, quality: DataFrame, least: float = 0.85, m: int = 8) -> DataFrame:
    """Of members with at least that similarity the best row of each unit, then the best m."""
    rows = assigned.join(quality.select("unit_id", "q"), "unit_id").withColumn("sim", F.when(F.col("action") == "create", 1.0).otherwise(F.col("semantic_sim"))).where(F.col("sim") >= least)
    order = [F.desc("sim"), F.desc("q"), F.col("ord")]
    one = rows.withColumn("_o", F.row_number().over(Window.partitionBy("cluster_id", "unit_id").orderBy(*order))).where("_o = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))).where(F.col("rank") <= m).select("cluster_id", "rank", "unit_id", "sim", "q")


def labelled(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """Assigned with l, the label (family, behaviors) by apk_id, else by the bare sha; null where there is neither."""
    full, bare = labels.select("apk_id", F.struct("family", "behaviors").alias("l1")), labels.select(F.col("apk_id").alias("sha"), F.struct("family", "behaviors").alias("l2"))
    return assigned.withColumn("sha", F.element_at(F.split("apk_id", "/"), -1)).join(full, "apk_id", "left").join(bare, "sha", "left").withColumn("l", F.coalesce("l1", "l2"))


def label_counts(assigned: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cluster_id, family, cnt) and (cluster_id, behavior, cnt), a count for every unit."""
    rows = labelled(assigned, labels)
    family = rows.withColumn("family", F.trim("l.family")).where("family <> '' and lower(family) <> 'unknown'").groupBy("cluster_id", "family").agg(F.count("*").alias("cnt"))
    behavior = rows.select("cluster_id", F.explode("l.behaviors").alias("b")).withColumn("behavior", F.trim("b")).where("behavior <> ''").groupBy("cluster_id", "behavior").agg(F.count("*").alias("cnt"))
    return family, behavior


def role_counts(units: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster_id, role, cnt): sums of the members' role counts; what is no number counts as zero."""
    rows = units.select("unit_id", F.explode("role_count").alias("role", "n")).join(assigned.select("unit_id", "cluster_id"), "unit_id")
    return rows.groupBy("cluster_id", "role").agg(F.sum(F.coalesce(F.col("n").try_cast("long"), F.lit(0))).alias("cnt"))


def audit_lists(units: DataFrame, assigned: DataFrame, column: str, cap: int = 32) -> DataFrame:
    """(cluster_id, <column>): distinct stripped items of the members in their order, the first `cap`."""
    rows = assigned.join(units.select("unit_id", F.posexplode(column).alias("pos", "item")), "unit_id").withColumn("item", F.trim("item")).where("item <> ''")
    first = rows.groupBy("cluster_id", "item").agg(F.min(F.struct("ord", "pos")).alias("at"))
    kept = first.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("at", "item"))).where(F.col("r") <= cap)
    return kept.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "item"))), lambda s: s["item"]).alias(column))


def build_summary(assigned: DataFrame) -> DataFrame:
    """Applications, units, clusters made, merges."""
    return assigned.agg(F.countDistinct("apk_id").alias("apks"), F.count("*").alias("bus"), F.count_if(F.col("action") == "create").alias("created"), F.count_if(F.col("action") == "merge").alias("merged"))


def prototype_store(units: DataFrame, assigned: DataFrame, labels: DataFrame, audit: list[str] = (), params: Params = Params()) -> dict[str, DataFrame]:  # noqa: B008
    """The tables of a prototype store: clusters with members, exemplars, labels, roles and audit lists; the inverted index of
    their frequent tokens; the summary of the build.

    units: (unit_id, psi, q, role_count, <audit lists>); assigned: (ord, unit_id, apk_id, cluster_id, action, semantic_sim).
    """
    sizes = cluster_sizes(assigned)
    index = frequent_psi(psi_counts(units, assigned, params.top_psi), sizes, params.eta, params.cap)
    listed = lambda df, name, *cols: df.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    families, behaviors = label_counts(assigned, labels)
    parts = [
        listed(top_members(assigned, units, params.members), "members", "rank", "unit_id", "sim", "q"),
        listed(exemplars(assigned, units, params.exemplar_sim, params.exemplars), "exemplars", "rank", "unit_id", "sim", "q"),
        listed(families, "families", "family", "cnt"), listed(behaviors, "behaviors", "behavior", "cnt"), listed(role_counts(units, assigned), "roles", "role", "cnt"),
        *[audit_lists(units, assigned, c) for c in audit],
    ]
    clusters = sizes
    for part in parts:
        clusters = clusters.join(part, "cluster_id", "left")
    return {"clusters": clusters, "inverted_index": index.select("token", "cluster_id", "cnt"), "build_summary": build_summary(assigned)}
