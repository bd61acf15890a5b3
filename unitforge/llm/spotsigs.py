"""SpotSigs document fingerprints: chains of content words that follow common-word anchors.

A spot is a run of common words (the anchor); its signature is the hash of the anchor and of the chain of content words after it.
A document's fingerprint is the set of its signatures. Near duplicates are found among sets of compatible length only, through
signatures of which the corpus' frequent ones come last, and are settled by Jaccard similarity. DataFrame operations only.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, connected_components

#: Common words of English, French, German and Spanish that serve as anchors (fixed values).
ANCHORS = (
    "a an and are as at be been but by can do for from had has have he her his i if in is it its not of on or our she so that the their they this to was we were what when which who will with would you "
    "au aux avec ce ces cette dans de des du elle en est et il la le les leur mais ne par pas plus pour qui que sa se ses son sur un une "
    "auch auf aus bei das dem den der die ein eine einen er es haben ich ist mit nach nicht oder sich sie sind und vom von war wie zu zum zur "
    "como con del el esta lo los las mas no o para pero por si sin su sus y"
).split()


def pieces(text: Column, anchors: list[str] | tuple[str, ...] = ANCHORS) -> Column:
    """One string for each content word, the common words right before it in front; the last has common words or nothing."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    marked = F.transform(words, lambda w: F.when(w.isin(*anchors), F.concat(w, F.lit(" "))).when(w == "", w).otherwise(F.concat(w, F.lit("\n"))))
    return F.split(F.array_join(marked, ""), "\n")


def _chain(p: Column, after: int, parts: Column, i: Column) -> Column:
    return F.substring_index(F.coalesce(F.get(parts, i + after), F.lit("")), " ", -1)


def add_signatures(df: DataFrame, text: str, out: str, chain: int = 2) -> DataFrame:
    """Append the sorted distinct signatures of a text column (array of 64-bit longs).

    A text without any spot has one signature, of all its words; so has the null text, which counts as empty. Equal texts have equal
    sets. At the end of a text, chains are shorter. Very long texts are read whole, rows are independent, an empty table gives an empty
    one, and a column named `out` is replaced.
    """
    value, parts = F.coalesce(F.col(text), F.lit("")), F.col(f"{out}_parts")
    df = df.withColumn(f"{out}_parts", pieces(value))
    spot = lambda p, i: F.when(p.contains(" "), F.xxhash64(p, *[_chain(p, k, parts, i) for k in range(1, chain)]))
    df = df.withColumn(out, F.array_sort(F.array_distinct(F.filter(F.transform(parts, spot), lambda x: x.isNotNull()))))
    whole = F.array(F.xxhash64(F.array_join(parts, "\n"), value))
    return df.withColumn(out, F.when(F.size(out) == 0, whole).otherwise(F.col(out))).drop(f"{out}_parts")


def as_text(signatures: Column) -> Column:
    """The set as a string: its members in hex, in rising order."""
    return F.array_join(F.transform(signatures, lambda x: F.hex(x)), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two non-empty sets."""
    both = F.size(F.array_intersect(a, b))
    return (both / (F.size(a) + F.size(b) - both)).cast("double")


def _table(values: list, kind: str) -> Column:
    """A small list as one constant."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def with_next(df: DataFrame, key: str, columns: list[str], tie: Column, rows_per_bucket: int = 500, most_buckets: int = 1 << 16, derive: Callable[[DataFrame], DataFrame] = lambda df: df, beside: DataFrame | None = None) -> DataFrame:
    """Append next_<column>: values of the row after this one by descending key; the last row's next is the first.

    derive adds columns to the rows where they have arrived, so that what it computes isn't shuffled; `columns` may name them.
    beside: (key, tie, further columns) for some keys and ties, such as a join by these would add, null where there is none: its rows are dealt
    into the same ranges, so that rows of df go one way and are not shuffled again with all that was derived. Of several alike the largest counts.

    Rows are dealt into key ranges by the key's quantiles, which grow in number with the table up to most_buckets; beyond, ranges get
    longer, and a range is sorted by a task that may spill. A key that fills several ranges (or the null key) has a range of its own,
    which is split further by tie, a 64-bit hash. Each range also gets the first row of the range after it. A key's range is found in two
    steps, each over about the root of their number. Equal keys are ordered by tie, rows that also agree in it are alike; null keys come
    last. An empty table gives an empty one; columns named like the new ones are refused by Spark as ambiguous.
    """
    total = df.count()
    n = max(1, min(most_buckets, math.ceil(total / rows_per_bucket)))
    quantiles = [int(x) for x in df.approxQuantile(key, [i / n for i in range(1, n)], 1 / (4 * n))] if n > 1 else []
    often = {b for a, b in zip(quantiles, quantiles[1:], strict=False) if a == b}
    cuts = sorted({*quantiles, *(x + 1 for x in often if x < (1 << 63) - 1)}, reverse=True)
    width = max(1, math.isqrt(len(cuts)))
    groups = [cuts[a : a + width] for a in range(0, len(cuts), width)]
    over = lambda bounds: F.size(F.filter(bounds, lambda b: b > F.col(key)))
    group = over(_table([g[-1] for g in groups], "bigint"))  # groups whose bounds are all above the key
    inside = F.coalesce(over(F.get(_table(groups, "array<bigint>"), group)), F.lit(0))
    bucket = F.when(F.col(key).isNull(), len(cuts) + 1).otherwise(F.least(group * width + F.greatest(inside, F.lit(0)), F.lit(len(cuts)))).cast("int")
    sizes = {r["_r"]: r for r in df.select(key, bucket.alias("_r")).groupBy("_r").agg(F.count("*").alias("rows"), F.min(key).eqNullSafe(F.max(key)).alias("one")).collect()}
    least = max(1, math.ceil(total / most_buckets), rows_per_bucket)
    shares = [max(1, sizes[b]["rows"] // least) if b in sizes and sizes[b]["one"] else 1 for b in range(len(cuts) + 2)]
    starts = list(itertools.accumulate(shares, initial=0))[:-1]
    # Shares of the tie's 2**64 values, in their order.
    share = F.floor((F.col("_tie") / float(1 << 64) + 0.5) * F.get(_table(shares, "int"), F.col("_r")))
    share = F.greatest(F.lit(0), F.least(share, F.get(_table(shares, "int"), F.col("_r")) - 1))
    in_range = lambda rows, t: rows.withColumns({"_r": bucket, "_tie": t}).withColumn("_bucket", (F.get(_table(starts, "int"), F.col("_r")) + share).cast("int")).drop("_r")
    df = in_range(df, tie)
    heads = {r["_bucket"]: r["h"] for r in df.groupBy("_bucket").agg(F.min(F.struct(-F.col(key), "_tie")).alias("h")).collect()}
    order = sorted(heads)
    goes_to = {b: order[i - 1] for i, b in enumerate(order)}
    at = lambda f, kind: F.get(_table([f(b) if b in heads else None for b in range(sum(shares))], kind), F.col("_bucket"))
    first = (-F.col(key)).eqNullSafe(at(lambda b: heads[b][0], "bigint")) & F.col("_tie").eqNullSafe(at(lambda b: heads[b][1], "bigint"))
    own = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("extra"))
    places = F.when(first, F.array(own, F.struct(at(lambda b: goes_to[b], "int").alias("b"), F.lit(1).alias("extra")))).otherwise(F.array(own))
    dealt = df.withColumn("_place", F.explode(places)).drop("_bucket").withColumns({"_range": F.col("_place.b"), "_extra": F.col("_place.extra")}).drop("_place")
    if beside is None:
        dealt = dealt.repartition("_range")
    else:
        added = [c for c in beside.columns if c not in (key, "tie")]
        rows = in_range(beside, F.col("tie")).select(key, "_tie", *added, F.col("_bucket").alias("_range"), F.lit(0).alias("_extra"), F.lit(True).alias("_beside"))
        dealt = dealt.withColumn("_beside", F.lit(False)).unionByName(rows, allowMissingColumns=True).repartition("_range")
        alike = Window.partitionBy("_range", "_extra", key, "_tie")
        dealt = dealt.withColumns({c: F.max(c).over(alike) for c in added}).where(~F.col("_beside")).drop("_beside")
    w = Window.partitionBy("_range").orderBy("_extra", F.col(key).desc_nulls_last(), "_tie")
    out = derive(dealt).select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return out.where("_extra = 0").drop("_range", "_extra", "_tie")


def set_digest(signatures: Column) -> Column:
    """128 bits that name a sorted set."""
    return F.md5(as_text(signatures))


def _marks(signatures: Column, words: int = 4) -> list[Column]:
    """A bit for each member, at a place that the member tells, in `words` longs: equal members set equal bits."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(x, 2), F.lit(64)).cast("int"))
    word = lambda w: F.aggregate(signatures, F.lit(0).cast("long"), lambda a, x: F.when(F.pmod(x, F.lit(words)) == w, a.bitwiseOR(bit(x))).otherwise(a))
    return [word(w).alias(f"m{w}") for w in range(words)]


def _plausible(a: str, b: str, threshold: float, words: int = 4) -> Column:
    """Can two sets reach the threshold, by their lengths and by the marks that one has and the other lacks? No pair that does is refused."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    lacking = lambda p, q: sum((F.bit_count(F.col(f"{p}.m{w}").bitwiseAND(F.bitwise_not(F.col(f"{q}.m{w}")))) for w in range(words)), F.lit(0))
    most = F.least(n - lacking(a, b), m - lacking(b, a))
    return (F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9) & (most * (1 + threshold) >= threshold * (n + m) - 1e-9)


def short_hashes(signatures: Column) -> Column:
    """The set's members hashed to 16 bits, each once: a quarter of its bytes."""
    return F.array_distinct(F.transform(signatures, lambda x: (F.pmod(F.xxhash64(x), F.lit(1 << 16)) - (1 << 15)).cast("short")))


def may_reach(n: Column, m: Column, h: Column, g: Column, threshold: float) -> Column:
    """Can sets of n and m members with short hashes h and g reach the threshold? No pair that does is refused.

    What two sets share has a hash that both hold; members beyond the first of a hash are at most those that each set lost to equal hashes.
    """
    most = F.size(F.array_intersect(h, g)) + F.least(n - F.size(h), m - F.size(g))
    return most * (1 + threshold) >= threshold * (n + m) - 1e-9


def near_classes(df: DataFrame, key: str, signatures: str, threshold: float = 0.75, hot: int = 50_000, rare: int = 50, share: int = 1024) -> DataFrame:
    """(digest, component_id): the near-duplicate class of every set that several rows hold or that is linked with another set.

    Sets are linked where their Jaccard similarity reaches threshold; component_id is the smallest key of all rows whose sets are
    joined by links, null if all these keys are null. Equal sets collapse first. A set is entered under its first
    n - ceil(threshold * n) + 1 signatures, in an order in which the corpus' frequent signatures come last, the most frequent at the end: two sets above
    the threshold share one of these. The frequent ones have over `rare` sets and over the hot-th part of all entries, so they number
    `hot` at most. Sets meet in
    cells of a signature and a length class (steps of 1/threshold, neighbouring classes only); lengths and bit marks prune pairs, the
    full sets decide. First all sets of a cell meet its first one and that of the next shorter class, which joins a group of near
    copies without its pairs; then sets outside the largest component under a signature meet all others there, in shares of `share`
    sets. Empty and null sets have no class.
    """
    scratch = Scratch(df.sparkSession, "spots")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(signatures).alias("s"))
    held = rows.groupBy(set_digest(F.col("s")).alias("digest")).agg(F.min("id").alias("least"), F.count("*").alias("rows"), F.first("s").alias("s"))
    # Only after the aggregation: a filter on sets that are still to be computed would be pushed below them and compute them over and over.
    held = held.where(F.size(F.coalesce("s", F.array().cast("array<bigint>"))) > 0)
    step = F.floor(F.log(F.size("s")) / math.log(1 / threshold) + 1e-9).cast("int")
    sets = scratch.keep(held.select(F.monotonically_increasing_id().alias("node"), "digest", "least", "rows", F.size("s").alias("n"), step.alias("part"), "s", *_marks(F.col("s"))), "sets")

    entries = sets.agg(F.sum("n")).first()[0] or 0
    # Written rather than collected at once: the counts of all signatures are a large shuffle, which goes with its job.
    counts = scratch.keep(sets.select(F.explode("s").alias("x")).groupBy("x").count().where(F.col("count") > max(rare, entries // hot + 1)), "frequent")
    often = [r["x"] for r in sorted(counts.collect(), key=lambda r: (r["count"], r["x"]))]
    slots: list[list[int]] = [[] for _ in range(max(1, len(often)))]
    ranks: list[list[int]] = [[] for _ in slots]
    for rank, x in enumerate(often):
        slots[x % len(slots)].append(x)
        ranks[x % len(slots)].append(rank)
    table, rank_table, slot = _table(slots, "array<bigint>"), _table(ranks, "array<int>"), lambda x: F.pmod(x, F.lit(len(slots))).cast("int")
    frequent = lambda x: F.array_contains(F.get(table, slot(x)), x)
    rank = lambda x: F.get(F.get(rank_table, slot(x)), F.array_position(F.get(table, slot(x)), x).cast("int") - 1)
    last = F.transform(F.array_sort(F.transform(F.filter("s", frequent), lambda x: F.struct(rank(x).alias("r"), x.alias("x")))), lambda e: e["x"])
    ordered = F.concat(F.filter("s", lambda x: ~frequent(x)), last)
    need = (F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1).cast("int")
    marks = [f"m{w}" for w in range(4)]
    entries = sets.select("node", "n", "part", *marks, F.explode(F.slice(ordered, F.lit(1), need)).alias("x"))
    entered = scratch.keep(entries.join(entries.groupBy("x").count().where("count > 1").select("x"), "x"), "entered")

    def confirmed(pairs: DataFrame, tag: str) -> DataFrame:
        pairs = scratch.keep(pairs.distinct(), f"{tag}-pairs")
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        asked = scratch.keep(sets.select("node", "n", "s").join(nodes, "node").withColumn("h", short_hashes(F.col("s"))), f"{tag}-sets")
        # A pair's way to its second set carries the first one: short hashes for all pairs, full sets for those that may be linked.
        a, b = (asked.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("h").alias(f"h_{c}")) for c in "ab")
        close = pairs.join(a, "a").join(b, "b").where(may_reach(F.col("n_a"), F.col("n_b"), F.col("h_a"), F.col("h_b"), threshold))
        close = scratch.keep(close.select("a", "b"), f"{tag}-close")
        a, b = (asked.select(F.col("node").alias(c), F.col("s").alias(f"s_{c}")) for c in "ab")
        met = close.join(a, "a").join(b, "b")
        out = scratch.keep(met.where(likeness(F.col("s_a"), F.col("s_b")) >= threshold).select("a", "b"), tag)
        scratch.drop(pairs)
        scratch.drop(close)
        scratch.drop(asked)
        return out

    heads = entered.groupBy("x", "part").agg(F.min(F.struct("node", "n", *marks)).alias("h")).select("x", F.explode(F.array("part", F.col("part") + 1)).alias("part"), "h")
    to_head = entered.select("x", "part", F.struct("node", "n", *marks).alias("e")).join(heads, ["x", "part"]).where((F.col("e.node") != F.col("h.node")) & _plausible("e", "h", threshold))
    links = confirmed(to_head.select(F.col("h.node").alias("a"), F.col("e.node").alias("b")), "to-heads")
    member = scratch.keep(connected_components(links, scratch, thin=False), "first")

    placed = entered.join(member, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    sizes = placed.groupBy("x", "comp").agg(F.count("*").alias("c")).groupBy("x").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("c").alias("all"))
    sizes = sizes.where("comps > 1").select("x", "top", F.ceil(F.col("all") / share).cast("int").alias("shares"))
    placed = scratch.keep(placed.join(sizes, "x"), "placed")
    scratch.drop(entered)
    scratch.drop(member)
    e = F.struct("node", "n", "comp", "part", *marks)
    minors = placed.where("comp <> top").select("x", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("i"), e.alias("e"))
    others = placed.select("x", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("i"), e.alias("h"))
    near = (F.col("e.comp") != F.col("h.comp")) & (F.abs(F.col("e.part") - F.col("h.part")) <= 1)
    apart = minors.join(others, ["x", "i"]).where(near & _plausible("e", "h", threshold))
    more = confirmed(apart.select(F.least("e.node", "h.node").alias("a"), F.greatest("e.node", "h.node").alias("b")), "apart")
    scratch.drop(placed)
    member = connected_components(links.union(more), scratch, thin=False)
    scratch.drop(links)
    scratch.drop(more)

    classes = sets.select("node", "digest", "least", "rows").join(member, "node", "left").where("rows > 1 or component is not null")
    low = classes.groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("least").alias("component_id"))
    out = scratch.keep(classes.select("digest", F.coalesce("component", "node").alias("c")).join(low, "c").select("digest", "component_id"), "classes")
    scratch.drop(sets)
    return out


def near_duplicates(df: DataFrame, key: str, signatures: str, threshold: float = 0.75) -> DataFrame:
    """(key, n_signatures, component_id, kept), a row for each row: its class by near_classes, itself where it has none."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(signatures).alias("s"))
    out = rows.withColumn("digest", set_digest(F.col("s"))).join(near_classes(df, key, signatures, threshold), "digest", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce(F.size("s"), F.lit(0)).cast("long").alias("n_signatures"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
