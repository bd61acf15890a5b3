"""Mixing sources to target weights by soft membership.

A classifier fitted on a labelled table gives every document posteriors over domains; projected-gradient least squares then fits
nonnegative document rates whose expected domain token totals match the targets. DataFrame operations only: a round of the fit is
one aggregation over the documents that returns as many sums as there are domains.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Slots of the classifier's weight tables; of two words in one slot the one that tells more stays.
SLOTS = 1 << 14


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def add_tokens(df: DataFrame, text: str) -> DataFrame:
    """Append n_tokens (words of the whole text) and tokens: distinct words and marks for repetition and symbols."""
    raw = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_words", words(F.col(text))).withColumn("_own", F.array_distinct("_words"))
    bin_ = lambda tag, share: F.concat(F.lit(tag), F.floor(F.least(share, F.lit(1.0)) * 20).cast("string"))
    n, size = F.size("_words"), F.greatest(F.length(raw), F.lit(1))
    symbols = (F.length(raw) - F.length(F.translate(raw, "!#$%&*|@^~+=", ""))) / size
    long = F.when(n < 40, "s").when(n < 400, "m").otherwise("l")
    marks = F.array(F.concat(bin_("#own", F.size("_own") / F.greatest(n, F.lit(1))), long), bin_("#sym", symbols * 5))
    return df.withColumns({"n_tokens": n.cast("long"), "tokens": F.concat("_own", marks)}).drop("_words", "_own")


class Classifier:
    """Naive Bayes on the presence and absence of the words that tell most; tables are bounded by SLOTS whatever the corpus.

    start: log score of a text with none of the words, by domain; table: what each word adds when it is there.
    """

    def __init__(self, domains: list[str], start: list[float], table: dict[str, tuple[int, list[float]]]):
        self.domains, self.start, self.table = domains, start, table

    def add_posterior(self, df: DataFrame, tokens: str, out: str = "posterior") -> DataFrame:
        """Append an array of posteriors, in the order of domains, from a column of tokens."""
        hits = F.filter(F.col(tokens), lambda w: w.isin(*self.table)) if self.table else F.array().cast("array<string>")
        df = df.withColumn("_slots", F.transform(hits, lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int")))

        def total(k: int) -> Column:
            weights = ["0"] * SLOTS
            for slot, w in self.table.values():
                weights[slot] = repr(w[k])
            table = F.split(F.lit(",".join(weights)), ",").cast("array<double>")
            return F.aggregate("_slots", F.lit(self.start[k]), lambda acc, i: acc + F.get(table, i))

        names = [f"_log{k}" for k in range(len(self.domains))]
        df = df.withColumns({name: total(k) for k, name in enumerate(names)})
        df = df.withColumns({name: F.exp(F.col(name) - F.greatest(*names) if len(names) > 1 else F.lit(0.0)) for name in names})
        whole = sum((F.col(name) for name in names[1:]), F.col(names[0]))
        return df.withColumn(out, F.array(*[F.col(name) / whole for name in names])).drop("_slots", *names)


def fit_classifier(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", domain: str = "domain", rows: int = 20_000, features: int = 100, least: float = 25.0, lift: float = 3.0) -> Classifier:
    """Fit on the labelled rows, a hash sample of about `rows` of them at most (a bound in rows, documented here).

    labelled: (key, domain); null keys and domains teach nothing, a key labelled twice counts with each label, and every domain of the
    sample is learned. At most `features` words of each domain are kept, those with a G-statistic over `least` that are `lift` times as
    common there as elsewhere. Without labelled rows, as with an empty table, there is one domain, named "".
    """
    labelled = labelled.select(F.col(key).alias("key"), F.col(domain).alias("domain")).where("key is not null and domain is not null")
    total = labelled.count()
    if not total:
        return Classifier([""], [0.0], {})
    if total > rows:
        labelled = labelled.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int((1 << 20) * rows / total))
    known = labelled.join(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key")
    own = add_tokens(known, "text").select("domain", "tokens")
    counts = {r[0]: r[1] for r in own.groupBy("domain").count().collect()}
    if not counts:
        return Classifier([""], [0.0], {})
    domains, n = sorted(counts), sum(counts.values())
    seen = own.select("domain", F.explode("tokens").alias("w")).groupBy("w")
    seen = seen.agg(F.count("*").alias("all"), *[F.count(F.when(F.col("domain") == d, 1)).alias(f"c{i}") for i, d in enumerate(domains)]).where("all >= 5")
    seen = Scratch(docs.sparkSession, "mix").keep(seen, "words")
    table: dict[str, tuple[int, list[float]]] = {}
    taken: dict[int, float] = {}
    for i, d in enumerate(domains):
        a, b, na, nb = F.col(f"c{i}"), F.col("all") - F.col(f"c{i}"), counts[d], n - counts[d]
        p = F.col("all") / F.lit(float(n))
        part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
        g = 2 * (part(a, na * p) + part(b, nb * p) + part(na - a, na * (1 - p)) + part(nb - b, nb * (1 - p)))
        for r in seen.withColumns({"g": g, "slot": F.pmod(F.xxhash64("w"), F.lit(SLOTS))}).where((F.col("g") > least) & (a * nb > lift * b * na)).orderBy(F.desc("g"), "w").limit(features).collect():
            if taken.get(r["slot"], -1.0) < r["g"]:
                table = {w: x for w, x in table.items() if x[0] != r["slot"]}
                taken[r["slot"]] = r["g"]
                table[r["w"]] = r["slot"], [(r[f"c{j}"] + (r["all"] + 1) / (n + 2)) / (counts[e] + 1) for j, e in enumerate(domains)]
    start = [math.log((counts[d] + 1) / (n + len(domains))) + sum(math.log1p(-x[1][k]) for x in table.values()) for k, d in enumerate(domains)]
    return Classifier(domains, start, {w: (slot, [math.log(q) - math.log1p(-q) for q in odds]) for w, (slot, odds) in table.items()})


def fit_rates(docs: DataFrame, targets: list[float], scratch: Scratch, tokens: str = "n_tokens", posterior: str = "posterior", budget: float | None = None, rounds: int = 20, tolerance: float = 1e-5, gain: float = 0.01) -> tuple[DataFrame, list[float]]:
    """Append rate, and give the expected tokens of each domain as shares of the budget.

    The rate is nonnegative, so that the sum of n * p_k * rate over documents comes to targets_k * budget, by projected gradient.

    A document's rate starts at one and moves against the gradient n * p . residual of the squared residual, then is cut at zero.
    Scaled by 1/n (so that a rate depends on what a text is, not on how long it is) and whitened by the domains' Gram matrix, a
    step of one is safe. A round's residual comes from one aggregation; each fifth round the rates are written, which cuts the
    lineage. It ends within tolerance of the budget, when a round lessens the squared residual by less than gain, or after the
    rounds. budget None: as many tokens as there are; 0: the most that asks no domain for more than it has.
    """
    k, p = len(targets), [F.get(F.col(posterior), i) for i in range(len(targets))]
    n = F.col(tokens).cast("double")
    first = docs.agg(*[F.sum(n * x) for x in p], *[F.sum(n * p[i] * p[j]) for i in range(k) for j in range(k)]).first()
    have = np.array([x or 0.0 for x in first[:k]])
    gram = np.array([x or 0.0 for x in first[k:]]).reshape(k, k)
    goal = np.array(targets, dtype=float) / max(sum(targets), 1e-300)
    if budget == 0:
        budget = min((h / g for h, g in zip(have, goal, strict=True) if g > 0), default=0.0)
    want = goal * (have.sum() if budget is None else budget)
    docs = docs.withColumn("rate", F.lit(1.0))
    if have.sum() == 0 or want.sum() == 0:
        return docs, [0.0] * k
    inverse = np.linalg.inv(gram + 1e-9 * np.trace(gram) * np.eye(k))
    before = math.inf
    for i in range(rounds):
        off = have - want
        now = float(off @ inverse @ off)
        if np.abs(off).max() <= tolerance * max(want.sum(), 1.0) or now > (1 - gain) * before:
            break
        before = now
        moved = F.col("rate")
        for x, step in zip(p, (inverse @ off).tolist(), strict=True):
            moved = moved - x * F.lit(step)
        docs = docs.withColumn("rate", F.greatest(moved, F.lit(0.0)))
        if i % 5 == 4:
            docs = scratch.keep(docs, "rates")
        have = np.array([x or 0.0 for x in docs.agg(*[F.sum(n * x * F.col("rate")) for x in p]).first()])
    return docs, (have / want.sum()).tolist()


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", budget: float | None = None, seed: int = 0) -> DataFrame:
    """(key, n_tokens, domain, posterior, rate, copies, residual) of every row of docs.

    domain has the largest posterior (the first of equal ones by name). copies is the rate rounded up or down at random by a hash of
    the key, so that its expectation is the rate. residual, the same in all rows, is by how much the expected share of any domain is off
    its target at most; the target of a domain without a labelled row can't be met, and counts in it whole. Domains without a target
    weigh nothing. A null or empty text has no tokens and the posteriors of its marks; very long texts are read whole; repeated and null
    keys stay and get equal results for equal texts; an empty table gives none; further columns are ignored.
    """
    model = fit_classifier(docs, labelled, key, text)
    slim = add_tokens(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text")
    slim = model.add_posterior(slim, "tokens")
    scratch = Scratch(docs.sparkSession, "mix")
    slim = scratch.keep(slim.select("key", "n_tokens", "posterior"), "posteriors")
    weights = [targets.get(d, 0.0) for d in model.domains]
    out, shares = fit_rates(slim, weights if sum(weights) else [1.0] * len(weights), scratch, budget=budget)
    got, aim = dict(zip(model.domains, shares, strict=True)), max(sum(targets.values()), 1e-300)
    residual = max((abs(got.get(d, 0.0) - targets.get(d, 0.0) / aim) for d in {*got, *targets}), default=0.0)
    chance = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    best = F.get(F.array(*[F.lit(d) for d in model.domains]), (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int"))
    return out.select(F.col("key").alias(key), "n_tokens", best.alias("domain"), "posterior", "rate", F.floor(F.col("rate") + chance).cast("long").alias("copies"), F.lit(residual).alias("residual"))
