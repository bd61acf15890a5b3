"""Token sets as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def jaccard(a: Column, b: Column) -> Column:
    """Overlap over union; two empty sets are alike, one empty set is unlike any other."""
    both, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def prefixed(items: Column, prefix: str) -> Column:
    kept = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), strip), lambda x: x != "")
    return F.transform(kept, lambda x: F.concat(F.lit(prefix), x))


def symbolic_tokens(sapi: Column, perms: Column, hints: Column, lexical: Column, roles: Column | None = None) -> Column:
    """A unit's sorted token set. perms: names; roles: map of role to count, of which those above zero count."""
    parts = [prefixed(sapi, "SAPI:"), prefixed(perms, "PERM:"), prefixed(hints, "HINT:"), prefixed(lexical, "LIT:")]
    if roles is not None:
        live = F.map_keys(F.map_filter(F.coalesce(roles, F.create_map().cast("map<string,int>")), lambda k, v: F.coalesce(v, F.lit(0)) > 0))
        parts.append(F.transform(live, lambda r: F.concat(F.lit("ROLE:"), strip(r))))
    return F.array_sort(F.array_distinct(F.concat(*parts)))
