"""Vectors and scores as Column expressions over ARRAY<DOUBLE> (V1-V9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: views and their weights, score constants ---
VIEWS = {"unit_emb": 0.25, "unit_emb_internal": 0.25, "unit_emb_sensitive": 0.25, "unit_emb_anchor": 0.20, "unit_emb_max": 0.05}
SEMANTIC, SYMBOLIC = 0.85, 0.15
QUALITY = {"sapi": 0.6, "perms": 0.5, "hints": 0.4, "lexical": 0.3, "edges": 0.2, "anchors": 0.2}
# --- end of fixed values ---


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """V1: to unit length; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def unit_cosine(a: Column, b: Column) -> Column:
    """V2: dot product of unit vectors; -1 where one is empty or null or the lengths differ."""
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(F.coalesce(ok, F.lit(False)), dot(a, b)).otherwise(F.lit(-1.0))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """V3: cosine with a floor under the norms."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def multi_view_similarity(unit: dict[str, Column], center: dict[str, Column], weights: dict[str, float] = VIEWS) -> Column:
    """V5: weighted mean of cosines over the views that both sides have in equal length; -1 where there is none."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for view, w in weights.items():
        if view in unit and view in center:
            a, b = unit[view], center[view]
            ok = F.coalesce((F.size(a) > 0) & (F.size(a) == F.size(b)), F.lit(False))
            total = total + F.when(ok, F.lit(w) * dot(l2_normalize(a), b)).otherwise(0.0)
            weight = weight + F.when(ok, F.lit(w)).otherwise(0.0)
    return F.when(weight > 0, total / weight).otherwise(F.lit(-1.0))


def combined_score(semantic: Column, jaccard: Column) -> Column:
    """V6."""
    return F.lit(SEMANTIC) * semantic + F.lit(SYMBOLIC) * jaccard


def quality(**sizes: Column) -> Column:
    """V8: 1 + weighted log1p of the sizes of a unit's parts; parts not given count as empty."""
    out = F.lit(1.0)
    for part, size in sizes.items():
        out = out + F.lit(QUALITY[part]) * F.log1p(size.cast("double"))
    return out


def update_weight(q: Column, low: float = 0.5, high: float = 3.0) -> Column:
    """V9."""
    return F.least(F.greatest(F.log1p(F.greatest(q, F.lit(0.0))), F.lit(low)), F.lit(high))
