"""Tolerant JSON and the rules on verdict states as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# --- fixed values: whitelist, keywords, limits ---
VERDICTS = ("malicious", "benign", "unknown")
STRONG = (
    "credential theft", "account theft", "exfiltration", "data exfiltration", "spyware", "overlay abuse", "overlay attack", "banker", "ransomware",
    "sms fraud", "premium sms", "botnet", "dropper", "payload download", "accessibility abuse", "keylogging", "steal", "stolen",
)
MIN_CONFIDENCE, MIN_STRONG, MIN_BEHAVIORS = 70.0, 1, 1
NOTE_CHARS, SUMMARY_CHARS = 2000, 1200
GATE_NOTE = "verdict_gate: weaken malicious->%s (conf=%.1f, strong_hits=%d, behaviors=%d)"
# --- end of fixed values ---


def reply_text(raw: Column) -> Column:
    """the text of a model's reply given as JSON: chat message (whole or in parts), output text, output parts, text or content.

    Only strings count as texts, in parts too; of parts those with a text. A reply that has none of these is its own text.
    """
    doc = F.try_parse_json(raw)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    at = lambda path: F.when(kind(path) == "STRING", F.try_variant_get(doc, path, "string"))
    content = "$.choices[0].message.content"
    listed = F.when(kind(content).startswith("ARRAY"), _parts(F.from_json(F.get_json_object(raw, content), "array<struct<text:string>>")))
    outputs = F.from_json(F.get_json_object(raw, "$.output"), "array<struct<content:array<struct<text:string>>>>")
    joined = F.array_join(F.filter(F.transform(outputs, lambda o: _parts(o["content"])), lambda x: x.isNotNull()), "\n")
    return F.coalesce(listed, at(content), at("$.output_text"), F.nullif(joined, F.lit("")), at("$.text"), at("$.content"), raw, F.lit(""))


def _parts(items: Column) -> Column:
    """Texts of parts, a line each; null where no part has any."""
    texts = F.filter(F.transform(items, lambda x: x["text"]), lambda t: t.isNotNull() & (t != ""))
    return F.nullif(F.array_join(texts, "\n"), F.lit(""))


def safe_json(text: Column) -> Column:
    """the text if it is a JSON object, else what stands between its first and last brace if that is one, else {}."""
    inner = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.ltrim(c).startswith("{"), c)
    return F.coalesce(valid(text), valid(F.nullif(inner, F.lit(""))), F.lit("{}"))


def number(c: Column, default: float = 0.0) -> Column:
    """F32."""
    return F.coalesce(c.try_cast("double"), F.lit(default))


def labels(items: Column) -> Column:
    """stripped lower-case items without empty ones."""
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.lower(strip(x))), lambda x: x != "")


def strong_signals(behaviors: Column, claims: Column) -> Column:
    """How many of the keywords the labels and claims hold; a keyword within another counts for both."""
    text = F.array_join(F.concat(labels(behaviors), labels(claims)), "\n")
    return sum((text.contains(k).cast("int") for k in STRONG), F.lit(0))


def normalized_verdict(verdict: Column, fallback: Column | None = None) -> Column:
    """A verdict of the whitelist, else the fallback if it is one, else unknown."""
    known = lambda c: F.when(F.lower(strip(c)).isin(*VERDICTS), F.lower(strip(c)))
    return F.coalesce(known(verdict), *([known(fallback)] if fallback is not None else []), F.lit("unknown"))


def confidence(c: Column, default: float = 0.0) -> Column:
    """A number within 0 and 100; what is no number at all takes the default, NaN the upper end."""
    x = number(c, default)
    return F.greatest(F.lit(0.0), F.when(F.isnan(x), F.lit(100.0)).otherwise(F.least(F.lit(100.0), x)))


def gate(verdict: Column, conf: Column, family: Column, behaviors: Column, claims: Column, note: Column, weak_to: str = "unknown", min_confidence: float = MIN_CONFIDENCE, min_strong: int = MIN_STRONG, min_behaviors: int = MIN_BEHAVIORS) -> Column:
    """Struct (verdict, confidence, family, note, strong_hits): malicious stays only with enough confidence, signals and behaviours."""
    v, c, hits, n = normalized_verdict(verdict), confidence(conf), strong_signals(behaviors, claims), F.size(labels(behaviors))
    weak_to = weak_to.strip().lower() if weak_to.strip().lower() in ("unknown", "benign") else "unknown"
    weak = (v == "malicious") & ((c < min_confidence) | (hits < (min_strong or 1)) | (n < (min_behaviors or 1)))
    old = strip(note)
    said = F.format_string(GATE_NOTE, F.lit(weak_to), c, hits, n)
    return F.struct(
        F.when(weak, F.lit(weak_to)).otherwise(v).alias("verdict"), c.alias("confidence"), F.when(weak | (v != "malicious"), "unknown").otherwise(F.coalesce(family, F.lit("unknown"))).alias("family"),
        F.when(weak, F.when(old == "", said).otherwise(F.concat(old, F.lit(" | "), said))).otherwise(F.coalesce(note, F.lit(""))).alias("note"), hits.alias("strong_hits"),
    )
