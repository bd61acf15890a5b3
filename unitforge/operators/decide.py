"""Decision stage: prompts, injected language model, normalised states, folded per application."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import state as S

LlmFn = Callable[[str], str]

INSTRUCTION_LOCAL = (
    "Judge one behaviour unit of an Android application from the fields below and its closest prototypes. Answer with one JSON object: "
    "bu_id, risk_signal (malicious, suspicious, benign or unknown), confidence (0 to 100), local_intents, best_clusters, summary. "
    "Cite only bu_id, cluster_id and node_id that are given. Draw no conclusion on the application as a whole."
)
INSTRUCTION_STATE = (
    "Update the application's state with the unit summaries below. Answer with one JSON object: verdict (malicious, benign or unknown), confidence (0 to 100), "
    "family, family_candidates, behaviors, mechanisms, processed_bu_ids, changed_fields, note. Keep what the new evidence does not change."
)
INSTRUCTION_RECONCILE = "Review the state below for contradictions between verdict, behaviours and evidence. Answer with the corrected state as one JSON object of the same fields."


def local_prompt(pack: Column) -> Column:
    """L2."""
    return F.concat(F.lit(INSTRUCTION_LOCAL + "\n"), F.to_json(pack))


def state_prompt(state: dict, batch: list[dict]) -> str:
    """L3."""
    return f"{INSTRUCTION_STATE}\nstate: {json.dumps(state, ensure_ascii=False)}\nunits: {json.dumps(batch, ensure_ascii=False)}"


def reconcile_prompt(state: dict) -> str:
    """L4."""
    return f"{INSTRUCTION_RECONCILE}\nstate: {json.dumps(state, ensure_ascii=False)}"


def stub_llm(prompt: str) -> str:
    """Offline stand-in: a reply that depends on the prompt alone."""
    low = prompt.lower()
    hits = [k for k in S.STRONG if k in low]
    return json.dumps({"verdict": "malicious" if hits else "unknown", "confidence": 80.0 if hits else 20.0, "risk_signal": "malicious" if hits else "unknown", "behaviors": hits[:4], "mechanisms": [], "summary": f"{len(hits)} strong signals"})


def with_retries(call: LlmFn, retries: int = 6, retryable: tuple[type[Exception], ...] = (TimeoutError, ConnectionError), longest: float = 20.0, pause: Callable[[float], None] = time.sleep) -> LlmFn:
    """L1: repeat a call on the errors that may pass, waiting twice as long each time up to `longest` seconds; others are raised at once."""

    def run(prompt: str) -> str:
        for i in range(retries):
            try:
                return call(prompt)
            except retryable:
                if i == retries - 1:
                    raise
                pause(min(longest, 2.0**i))
        raise AssertionError("no try at all")

    return run


def ask(rows: DataFrame, prompt: str, llm: LlmFn = stub_llm, out: str = "reply") -> DataFrame:
    """Append the model's reply and error to each row; a failed call leaves reply null and says why."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            replies, errors = [], []
            for p in pdf[prompt]:
                try:
                    replies.append(llm(p))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  any failure of the service is data here
                    replies.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(**{out: replies, "error": errors})

    return rows.mapInPandas(run, schema)


def local_summary(bu_id: Column, reply: Column) -> Column:
    """Struct (bu_id, risk_signal, confidence, local_intents, best_clusters, summary) out of a reply; defaults for what it lacks."""
    obj = S.safe_json(S.reply_text(reply))
    at = lambda p: F.get_json_object(obj, p)
    listed = lambda p: F.when(at(p).startswith("["), at(p)).otherwise("[]")
    return F.struct(
        bu_id.alias("bu_id"), F.coalesce(at("$.risk_signal"), F.lit("unknown")).alias("risk_signal"), S.number(at("$.confidence")).alias("confidence"),
        listed("$.local_intents").alias("local_intents"), listed("$.best_clusters").alias("best_clusters"), F.substring(F.coalesce(at("$.summary"), F.lit("")), 1, S.SUMMARY_CHARS).alias("summary"),
    )


def _json_object(text: str) -> dict:
    a, b = text.find("{"), text.rfind("}")
    for part in (text, text[a : b + 1] if 0 <= a < b else ""):
        try:
            if isinstance(found := json.loads(part), dict):
                return found
        except ValueError:
            continue
    return {}


def _float(x, default: float) -> float:
    try:
        return float(x)
    except (TypeError, ValueError):
        return default


def new_state(apk_id: str) -> dict:
    return {"apk_id": apk_id, "verdict": "unknown", "confidence": 0.0, "family": "unknown", "family_candidates": [], "behaviors": [], "mechanisms": [], "processed_bu_ids": [], "changed_fields": [], "note": ""}


def normalize_state(reply: dict, before: dict) -> dict:
    """L6 on one state of a fold; the columns of functions.state do the same for tables."""
    out = dict(before)
    verdicts = [str(x).strip().lower() for x in (reply.get("verdict", before["verdict"]), before["verdict"])]
    out["verdict"] = next((v for v in verdicts if v in S.VERDICTS), "unknown")
    value = _float(reply.get("confidence"), _float(before["confidence"], 0.0))
    out["confidence"] = 100.0 if value != value else max(0.0, min(100.0, value))
    out["family"] = (str(reply.get("family", before["family"])).strip() or "unknown") if out["verdict"] == "malicious" else "unknown"
    for field in ("family_candidates", "behaviors", "mechanisms", "processed_bu_ids"):
        out[field] = reply[field] if isinstance(reply.get(field), list) else before[field]
    out["changed_fields"] = reply["changed_fields"] if isinstance(reply.get("changed_fields"), list) else []
    out["note"] = str(reply.get("note", before["note"]))[: S.NOTE_CHARS]
    return out


def _texts(items: list, key: str) -> list[str]:
    found = (str(x.get(key, "") if isinstance(x, dict) else x).strip().lower() for x in items)
    return [x for x in found if x]


def gate_state(state: dict, min_confidence: float = S.MIN_CONFIDENCE, min_strong: int = S.MIN_STRONG, min_behaviors: int = S.MIN_BEHAVIORS, weak_to: str = "unknown") -> dict:
    """L7 on one state of a fold."""
    if state["verdict"] != "malicious":
        return state | {"family": "unknown"}
    behaviors = _texts(state["behaviors"], "label")
    text = "\n".join([*behaviors, *_texts(state["mechanisms"], "claim")])
    hits = sum(k in text for k in S.STRONG)
    if state["confidence"] >= min_confidence and hits >= (min_strong or 1) and len(behaviors) >= (min_behaviors or 1):
        return state
    said = S.GATE_NOTE % (weak_to, state["confidence"], hits, len(behaviors))
    return state | {"verdict": weak_to, "family": "unknown", "note": f"{state['note'].strip()} | {said}" if state["note"].strip() else said}


def fold_units(state: dict, rows: pd.DataFrame, llm: LlmFn, batch_size: int) -> tuple[dict, int]:
    """The state after rows (bu_id, summary) in their order, a batch a call, and the number of calls; the gate runs after each."""
    calls = 0
    for a in range(0, len(rows), max(batch_size, 1)):
        part = rows.iloc[a : a + max(batch_size, 1)]
        units = [{"bu_id": b, "summary": s} for b, s in zip(part["bu_id"], part["summary"], strict=True)]
        reply = _json_object(llm(state_prompt(state, units)))
        done = [*state["processed_bu_ids"], *part["bu_id"]]
        state = gate_state(normalize_state(reply, state) | {"processed_bu_ids": done})
        calls += 1
    return state, calls


FOLD_SCHEMA = "apk_id string, verdict string, confidence double, family string, behaviors array<string>, processed array<string>, calls int, note string"


def fold_states(summaries: DataFrame, llm: LlmFn = stub_llm, batch_size: int = 2, reconcile: bool = True, order: str = "rank") -> DataFrame:
    """One state per application, folded over its unit summaries in batches; the gate runs after every step.

    summaries: (apk_id, bu_id, <order>, summary). An application's few ranked units (rank_packs bounds them) fit one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, "bu_id"])
        state, calls = fold_units(new_state(pdf["apk_id"].iloc[0]), pdf, llm, batch_size)
        if reconcile:
            state = gate_state(normalize_state(_json_object(llm(reconcile_prompt(state))), state))
            calls += 1
        state = gate_state(state)
        texts = [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in state["behaviors"]]
        return pd.DataFrame([(state["apk_id"], state["verdict"], state["confidence"], state["family"], texts, [str(x) for x in state["processed_bu_ids"]], calls, state["note"])], columns=["apk_id", "verdict", "confidence", "family", "behaviors", "processed", "calls", "note"])

    return summaries.groupBy("apk_id").applyInPandas(run, FOLD_SCHEMA)


def results(apks: DataFrame, states: DataFrame, loaded: DataFrame) -> DataFrame:
    """A row for every application: its state, or unknown with the reason: no_units_loaded, or no_bu_packs where units were loaded."""
    out = apks.select("apk_id").join(states, "apk_id", "left").join(loaded.select("apk_id").distinct().withColumn("_loaded", F.lit(True)), "apk_id", "left")
    why = F.when(F.col("_loaded"), "no_bu_packs").otherwise("no_units_loaded")
    return out.select("apk_id", F.coalesce("verdict", F.lit("unknown")).alias("verdict"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("family", F.lit("unknown")).alias("family"), F.coalesce("note", why).alias("note"))
