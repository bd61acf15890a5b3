"""Methods to features, units to compact knowledge-base units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sets as S
from ..functions import text as T
from ..functions import vectors as V

NONE = "array<string>"


def method_features(methods: DataFrame, calls: DataFrame, api_perms: DataFrame, roles: DataFrame, keys: list[str], limit: int = 16) -> DataFrame:
    """Stage one's record of each method: stats, literals, spans, tags, roles and the symbolic vector."""
    sens = calls.select(*keys, F.col("caller").alias("method_sig"), "callee", "pos").join(api_perms.withColumnRenamed("api_sig", "callee"), "callee")
    sens = sens.groupBy(*keys, "method_sig").agg(F.array_sort(F.collect_list(F.struct("pos", "callee", "perms"))).alias("_sens"))
    out = methods.join(sens, [*keys, "method_sig"], "left").join(roles, [*keys, "class_name"], "left")
    found = F.coalesce("_sens", F.array().cast("array<struct<pos:int,callee:string,perms:array<string>>>"))
    out = out.withColumn("roles", F.coalesce("roles", F.array().cast(NONE))).withColumn("_sens", found)
    unique = F.map_from_entries(F.array_distinct(F.transform("_sens", lambda s: F.struct(s["callee"], s["perms"]))))
    out = out.withColumns({"sensitive_invokes": F.slice(F.transform("_sens", lambda s: F.struct(s["callee"].alias("callee"), s["perms"].alias("perms"))), 1, limit), "_perms": unique})
    out = out.withColumns({
        "method_family_tags": T.family_tags(F.col("method_name"), F.col("invokes")), "audit_strings": T.audit_literals(F.col("strings"), F.col("instructions"), limit),
        "evidence_spans": T.evidence_spans(F.col("instructions"), F.col("_perms"), limit),
        "symbolic_features": T.symbolic_features(F.col("method_name"), F.col("invokes"), F.col("strings"), F.size("_sens") > 0, F.col("roles")),
        "method_stats": F.struct(F.size("invokes").alias("invoke_count"), F.size("strings").alias("strings_count"), F.size("sensitive_invokes").alias("sensitive_invoke_count"), F.size("_sens").alias("sensitive_invoke_count_total")),
    })
    return out.withColumns({"callback_flags": T.callback_flags(F.col("method_family_tags")), "evidence_summary": T.evidence_summary(F.col("evidence_spans"))}).drop("_sens", "_perms")


def call_edges(methods: DataFrame, api_perms: DataFrame, keys: list[str]) -> DataFrame:
    """A row for every call of every method, with the callee's permissions; a bag."""
    calls = methods.select(*keys, F.col("method_sig").alias("caller"), F.posexplode("invokes").alias("pos", "callee"))
    out = calls.join(api_perms.withColumnRenamed("api_sig", "callee"), "callee", "left").withColumn("perms", F.coalesce("perms", F.array().cast(NONE)))
    return out.select(*keys, "caller", "callee", "pos", F.lit("invoke").alias("kind"), (F.size("perms") > 0).cast("int").alias("callee_is_sensitive"), F.col("perms").alias("callee_perms"))


def pool_chunks(chunks: DataFrame, keys: list[str], vector: str = "vector", mode: str = "mean") -> DataFrame:
    """Elementwise mean or maximum of a method's chunk vectors."""
    if mode not in ("mean", "max"):
        raise ValueError(f"unknown pool mode: {mode}")
    parts = chunks.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg((F.avg if mode == "mean" else F.max)("x").alias("x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))


def pool_units(nodes: DataFrame, keys: list[str], order: str = "ord", vector: str = "h", mode: str = "mean") -> DataFrame:
    """Mean of a unit's node vectors; the first valid vector's length counts, others are skipped. mean_norm brings it to unit length.

    Null, empty and incomplete vectors are invalid; a unit without a valid one is absent from the result.
    """
    ok = nodes.where((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull()))
    ok = ok.withColumn("_width", F.first(F.size(vector)).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    pooled = pool_chunks(ok.where(F.size(vector) == F.col("_width")), keys, vector)
    out = pooled.withColumnRenamed(vector, "unit_emb")
    return out.withColumn("unit_emb", V.l2_normalize(F.col("unit_emb"))) if mode == "mean_norm" else out


def build_units(nodes: DataFrame, anchors: DataFrame, keys: list[str], lexical_limit: int = 256, hint_limit: int = 256, pool_mode: str = "mean") -> DataFrame:
    """(keys, sapi, perms, hints, lexical, unit_emb) of each unit.

    nodes: (keys, ord, sig, is_sensitive, perms, lines, h); anchors: (keys, sig, perms), whose signature may be missing.
    """
    sig = T.strip(F.col("sig"))
    apis = nodes.where("is_sensitive = 1").select(*keys, sig.alias("sig"), "perms").where("sig <> ''").union(anchors.select(*keys, sig.alias("sig"), "perms"))
    sapi = apis.where("sig <> ''").groupBy(*keys).agg(F.array_sort(F.collect_set("sig")).alias("sapi"))
    by_perm = apis.select(*keys, F.explode("perms").alias("perm"), F.nullif("sig", F.lit("")).alias("sig")).groupBy(*keys, "perm").agg(F.array_sort(F.collect_set("sig")).alias("sigs"))
    perms = by_perm.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("perm", "sigs")))).alias("perms"))
    own = nodes.select(*keys, "ord", T.hints(F.array_join(F.coalesce("lines", F.array().cast(NONE)), "\n")).alias("hints"), T.const_strings(F.coalesce("lines", F.array().cast(NONE)), lexical_limit).alias("strings"))
    texts = own.groupBy(*keys).agg(F.flatten(F.collect_set("hints")).alias("hints"), F.array_sort(F.collect_list(F.struct("ord", "strings"))).alias("strings"))
    raw = F.slice(F.flatten(F.transform("strings", lambda s: s["strings"])), 1, lexical_limit)
    texts = texts.withColumn("_raw", raw)
    base64 = F.when(T.any_match(F.col("_raw"), lambda s: T.is_base64(s, long=True)), F.array(F.lit("LIT:BASE64_LIKE"))).otherwise(F.array().cast(NONE))
    texts = texts.select(*keys, F.slice(F.array_sort(F.array_distinct(F.concat("hints", base64))), 1, hint_limit).alias("hints"), T.clean_lexical(F.col("_raw"), lexical_limit).alias("lexical"))
    out = texts.join(sapi, keys, "left").join(perms, keys, "left").join(pool_units(nodes, keys, mode=pool_mode), keys, "left")
    return out.withColumns({"sapi": F.coalesce("sapi", F.array().cast(NONE)), "perms": F.coalesce("perms", F.create_map().cast("map<string,array<string>>"))})


def add_tokens(units: DataFrame) -> DataFrame:
    """A unit's token set psi and its quality q."""
    roles = F.col("role_count") if "role_count" in units.columns else None
    psi = S.symbolic_tokens(F.col("sapi"), F.map_keys("perms"), F.col("hints"), F.col("lexical"), roles)
    parts = {"sapi": F.size("sapi"), "perms": F.size(F.map_keys("perms")), "hints": F.size("hints"), "lexical": F.size("lexical")}
    for name, column in (("edges", "edges"), ("anchors", "anchor_sigs")):
        if column in units.columns:
            parts[name] = F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0))
    return units.withColumns({"psi": psi, "q": V.quality(**parts)})
