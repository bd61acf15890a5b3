"""Streams: retrieval of prototypes for arriving units, windowed indicator counts, states carried between batches."""

from __future__ import annotations

from collections.abc import Iterator

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..functions.vectors import VIEWS
from ..operators import cluster, decide, retrieve


def read_units(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def retrieve_stream(units: DataFrame, clusters: DataFrame, index: DataFrame, out: str, checkpoint: str, **options) -> DataStreamWriter:
    """C5 on a stream: every micro-batch joins the frozen prototypes; each unit's result depends on that unit alone."""

    def each(batch: DataFrame, number: int) -> None:
        retrieve.rank_clusters(batch, clusters, index, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return units.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def indicator_counts(events: DataFrame, time: str, text: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling counts of domains in arriving texts; rows later than the watermark are dropped and state is bounded by it."""
    hits = events.withWatermark(time, late).select(time, F.explode(T.domains(F.col(text))).alias("value"))
    return hits.groupBy(F.window(time, width), "value").agg(F.count("*").alias("n")).select("window.start", "window.end", "value", "n")


STATE_SCHEMA = "state string"
OUT_SCHEMA = "apk_id string, verdict string, confidence double, processed array<string>"


def fold_stream(summaries: DataFrame, llm: decide.LlmFn = decide.stub_llm, batch_size: int = 2) -> DataFrame:
    """L8 on a stream of (apk_id, bu_id, rank, summary): an application's state is kept between batches and updated with what arrives.

    What arrives together is folded by rank and bu_id as decide.fold_states does, in batches of its own; a stream has no end at which
    the state could be reconciled.
    """
    def update(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else decide.new_state(key[0])
        rows = pd.concat(list(parts)).sort_values(["rank", "bu_id"])
        state, _ = decide.fold_units(state, rows, llm, batch_size)
        held.update((json.dumps(state),))
        yield pd.DataFrame([(key[0], state["verdict"], state["confidence"], state["processed_bu_ids"])], columns=["apk_id", "verdict", "confidence", "processed"])

    return summaries.groupBy("apk_id").applyInPandasWithState(update, OUT_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout)


ASSIGNMENTS = "store string, ord long, unit_id string, cluster_id string, action string, semantic_sim double, symbolic_jaccard double"


class _Loaded(dict):
    """Entries of a map state, read when they are first asked for."""

    def __init__(self, load):
        super().__init__()
        self.load = load

    def __missing__(self, key):
        self[key] = self.load(key)
        return self[key]


class LeaderProcessor(StatefulProcessor):
    """Ordered clustering with its state in the state store: a map of clusters, a map from tokens to the clusters that hold them often, a count.

    A batch reads the clusters that its units' tokens lead to and writes back what changed, so it costs what arrives and not what is stored.
    """

    def __init__(self, params: cluster.Params, weights: dict[str, float], views: list[str]):
        self.params, self.weights, self.views = params, weights, views

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clusters = handle.getMapState("clusters", "number long", "state string")
        self.holding = handle.getMapState("holding", "token string", "numbers string")
        self.count = handle.getValueState("count", "n long")

    def _cluster(self, number: int):
        size, mass, centers, psi, members, exemplars, audit = json.loads(self.clusters.getValue((number,))[0])
        return cluster._Cluster(size, mass, centers, dict(psi), members, exemplars, audit, self.params)

    def _numbers(self, token: str) -> set[int]:
        held = self.holding.getValue((token,)) if self.holding.containsKey((token,)) else None
        return set(json.loads(held[0])) if held else set()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        made = self.count.get()[0] if self.count.exists() else 0
        now = cluster.Pass(self.params, self.weights, _Loaded(self._cluster), _Loaded(self._numbers))
        out = []
        for row in pd.concat(list(rows)).sort_values("ord").itertuples(index=False):
            c, action, sem, jac = now.take(made + 1, row.unit_id, set(row.psi), float(row.q), cluster.unit_views(row, self.views), {})
            made += action == "create"
            out.append((key[0], row.ord, row.unit_id, f"p_{c:06d}", action, sem, jac))
        for c in now.changed:
            self.clusters.updateValue((c,), (json.dumps(now.clusters[c].state()),))
        for t in now.moved:
            if now.holding[t]:
                self.holding.updateValue((t,), (json.dumps(sorted(now.holding[t])),))
            else:
                self.holding.removeKey((t,))
        self.count.update((made,))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in ASSIGNMENTS.split(", ")])

    def close(self) -> None:
        pass


def leader_stream(units: DataFrame, params: cluster.Params = cluster.Params(), weights: dict[str, float] = VIEWS) -> DataFrame:  # noqa: B008
    """C1, C4 on a stream of (store, ord, unit_id, psi, q, views...): each unit's assignment, appended once; a store's clusters stay in the state.

    Units must arrive by rising ord from batch to batch; within a batch they are sorted. However the input is cut into batches, the outcome
    is that of cluster.leader_clusters. A batch's units of one store are held together, so the source's batch size bounds them.
    Needs the RocksDB state store.
    """
    views = [v for v in weights if v in units.columns]
    live = units.where(F.size("psi") > 0).select("store", F.col("ord").cast("long").alias("ord"), "unit_id", "psi", F.col("q").cast("double").alias("q"), *views)
    return live.groupBy("store").transformWithStateInPandas(LeaderProcessor(params, weights, views), ASSIGNMENTS, "append", "none")
