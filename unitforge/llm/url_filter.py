"""URL filter: address rules, and link-graph propagation of trust and distrust for the addresses that no rule fits.

Personalised PageRank runs from trusted seeds along the host links, reversed PageRank from blocked seeds against them (whoever
links to a blocked host is suspect); a host is blocked where its share of distrust is above a threshold. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host tables up to so many rows (about 100 bytes each) are broadcast, larger ones joined by a shuffle.
BROADCAST_ROWS = 50_000


def url_host(url: Column) -> Column:
    """From after the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (verdict, rule) of the longest rule `host/path` that fits, null if none does; ties go to the first rule given.

    A rule fits its host and all subdomains of it where the path starts with the rule's path.
    """
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda x: len(x[1])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def host_links(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, n): absolute links between different hosts in the pages' markup, counted."""
    links = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]*)"""), F.lit(1))
    found = F.explode(F.array_distinct(F.transform(links, lambda u: url_host(F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u)))))
    return pages.select(F.col(host).alias("src"), found.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, seed: str, damping: float, rounds: int | None, scratch: Scratch, every: int = 5, tolerance: float = 1e-4) -> DataFrame:
    """Personalised PageRank over weighted links (src, dst, n) from seeds (host, <seed> mass): (host, score).

    Mass of hosts without links is lost, not handed back. `moving` is what the last round brought; each round passes it on, lessened by
    the damping. rounds None: until what still moves is under tolerance of the seeds' mass, which damping makes sure of. Each few
    rounds are written, which cuts the lineage.
    """
    out = links.groupBy("src").agg(F.sum("n").alias("total"))
    steps = scratch.keep(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("w")), "links")
    start = seeds.where(F.col(seed) > 0).select("host", (F.col(seed) * (1 - damping)).alias("score"))
    if steps.isEmpty():
        return start
    total = lambda df: df.agg(F.sum("moving")).first()[0] or 0.0
    state = kept = scratch.keep(start.withColumn("moving", F.col("score")), "rank")
    least, done = tolerance * total(state), 0
    while done < rounds if rounds is not None else total(kept) > least:
        for _ in range(every if rounds is None else min(every, rounds - done)):
            moved = state.join(steps, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), (F.col("moving") * F.col("w") * damping).alias("score"))
            held = state.select("host", "score", F.lit(0.0).alias("moving"))
            state = held.union(moved.withColumn("moving", F.col("score"))).groupBy("host").agg(F.sum("score").alias("score"), F.sum("moving").alias("moving"))
            done += 1
        before, kept = kept, scratch.keep(state, "rank")
        state = kept
        scratch.drop(before)
    return state.select("host", "score")


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", html: str = "html", key: str = "page_id", damping: float = 0.85, threshold: float = 0.5) -> DataFrame:
    """Host, path, rule and verdict (allow or block) of every page: (key, host, path, rule, verdict, distrust).

    A host's seed masses are the shares of its pages that allowing and blocking rules fit. With t and d the trust and distrust that
    propagation brings it, its distrust is d / (t + d + open), where open = (1 - damping) * (share of its pages without a rule) *
    (share of its links that lead to hosts without distrust; 1 without links): a host that links to nothing but blocked hosts and that
    no trusted host links to has distrust 1, one blocked neighbour among many clean ones weighs little. Pages without a rule are blocked
    where their host's distrust is above the threshold. Null addresses and such without :// have an empty host, no rule, and are allowed;
    null and empty markup has no links. Repeated rows are judged alike, a null key is kept, an empty table gives an empty result, further
    columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    pages = pages.select(F.col(key).alias("key"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), F.col(html).alias("html"))
    pages = pages.withColumn("hit", match_rules(F.col("host"), F.col("path"), rules))
    links = scratch.keep(host_links(pages, "host", "html"), "edges")
    share = lambda verdict: F.avg(F.when(F.col("hit.verdict") == verdict, 1.0).otherwise(0.0))
    seeds = scratch.keep(pages.where("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked")), "seeds")
    trust = propagate(links, seeds, "trusted", damping, None, scratch).withColumnRenamed("score", "t")
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(back, seeds, "blocked", damping, None, scratch).withColumnRenamed("score", "d")
    reached = links.join(distrust.select(F.col("host").alias("dst"), "d"), "dst", "left")
    clean = reached.groupBy(F.col("src").alias("host")).agg((F.sum(F.when(F.coalesce("d", F.lit(0.0)) > 0, 0).otherwise(F.col("n"))) / F.sum("n")).alias("clean"))
    t, d = F.coalesce("t", F.lit(0.0)), F.coalesce("d", F.lit(0.0))
    unsaid = (1 - damping) * F.greatest(1 - F.col("trusted") - F.col("blocked"), F.lit(0.0)) * F.coalesce("clean", F.lit(1.0))
    mass = t + d + unsaid
    hosts = seeds.join(trust, "host", "left").join(distrust, "host", "left").join(clean, "host", "left")
    hosts = scratch.keep(hosts.select("host", F.when(mass > 0, d / mass).otherwise(0.0).alias("distrust")), "hosts")
    if hosts.count() <= BROADCAST_ROWS:
        hosts = F.broadcast(hosts)
    out = pages.drop("html").join(hosts, "host", "left")
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("distrust") > threshold, "block").otherwise("allow"))
    return out.select(F.col("key").alias(key), "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
