"""Soft-membership mixing, with DataFrame expressions only.

A table of hashed-word weights, counted from labelled documents, gives each document a posterior
over domains. Nonnegative rates are then fitted so that the expected tokens of each domain match
its share of the whole: projected steps on the weighted least squares of the domain totals. The
weights are the inverse of the Gram matrix of the rows that aren't at the floor, for which a step of
one is exact as long as the same rows stay there. Where rates have a floor above 0, the whole grows
until no domain has to come down. Only domain totals (a handful of numbers) reach the driver.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import SPACE, bounded_sample, cut, redeal

DOMAINS = ("good", "rough", "toxic")
#: Shares of all tokens that the domains shall have.
TARGETS = {"good": 0.75, "rough": 0.17, "toxic": 0.08}
BUCKETS = 4096
#: Labelled documents of each domain that the table is counted from, about.
PER_DOMAIN = 3000
#: How many words' evidence a document's mean evidence counts as.
STRENGTH = 40.0
#: With a floor on rates: the totals tried, as multiples of the least at which no domain is above its target.
SCALES = (1.1, 1.25, 1.5, 2.0, 3.0, 4.0, 6.0)


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the rows with labels: toxic, else good or rough by quality."""
    named = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "rough")
    return labels.select("doc_id", named.alias("domain")).where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.max("domain").alias("domain"))


def words(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, bucket): a row for each different lower-cased word of a document, and one with bucket null without words."""
    trimmed = F.btrim(F.lower(F.coalesce("text", F.lit(""))), F.lit(" \t\n\u000b\f\r"))
    split = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))
    listed = docs.select("doc_id", split.alias("words")).select("doc_id", F.size("words").alias("n_tokens"), F.array_distinct("words").alias("words"))
    return listed.select("doc_id", "n_tokens", F.explode_outer("words").alias("word")).select("doc_id", "n_tokens", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("bucket"), F.col("word").isNotNull().alias("real"))


def word_table(docs: DataFrame, labels: DataFrame, per_domain: int = PER_DOMAIN) -> DataFrame:
    """(bucket, w_good, w_rough, w_toxic): log-probabilities of a document's word falling in the bucket."""
    sample = F.broadcast(bounded_sample(domains(labels), "domain", per_domain))  # per_domain bounds it
    known = docs.join(sample.select("doc_id"), "doc_id", "left_semi")
    counted = words(known).where("real").join(sample, "doc_id")
    table = cut(counted.groupBy("bucket").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(d) for d in DOMAINS]))
    total = table.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DOMAINS]).first()
    return table.select("bucket", *[F.log((F.col(d) + 0.5) / (total[d] + 0.5 * BUCKETS)).alias(f"w_{d}") for d in DOMAINS])


def priors(labels: DataFrame) -> dict[str, float]:
    """Each domain's share of the labelled documents (of counts with one added)."""
    n = {d: 1.0 for d in DOMAINS} | {r["domain"]: r["n"] + 1.0 for r in domains(labels).groupBy("domain").agg(F.count("*").alias("n")).collect()}
    return {d: n[d] / sum(n.values()) for d in DOMAINS}


def posteriors(docs: DataFrame, table: DataFrame, prior: dict[str, float], strength: float = STRENGTH) -> DataFrame:
    """(doc_id, n_tokens, p_good, p_rough, p_toxic), one row for each doc_id; without words the prior holds."""
    weights = F.broadcast(table)  # BUCKETS rows at most
    met = words(docs).join(weights, "bucket", "left")
    agg = met.groupBy("doc_id").agg(F.max("n_tokens").cast("long").alias("n_tokens"), F.count("w_good").alias("n"), *[F.sum(f"w_{d}").alias(f"s_{d}") for d in DOMAINS])
    mean = agg.select("doc_id", "n_tokens", *[F.coalesce(F.try_divide(f"s_{d}", "n"), F.lit(0.0)).alias(f"s_{d}") for d in DOMAINS])
    mean = mean.select("doc_id", "n_tokens", *[(strength * F.col(f"s_{d}") + float(np.log(prior[d]))).alias(f"s_{d}") for d in DOMAINS])
    top = F.greatest(*[f"s_{d}" for d in DOMAINS])
    raw = mean.select("doc_id", "n_tokens", *[F.exp(F.col(f"s_{d}") - top).alias(f"e_{d}") for d in DOMAINS])
    total = sum((F.col(f"e_{d}") for d in DOMAINS), F.lit(0.0))
    return raw.select("doc_id", "n_tokens", *[(F.col(f"e_{d}") / total).alias(f"p_{d}") for d in DOMAINS])


def fit(members: DataFrame, targets: dict[str, float], lowest: float = 0.0, rounds: int = 25, tolerance: float = 1e-3) -> Column:
    """The rate of each row of members (posteriors()), as a column: nonnegative, at least `lowest`.

    Rounds end when no domain's expected total is off by more than `tolerance` of all goals, or when
    a round changes nothing more. The goals add up to all tokens. With a `lowest` above 0 a domain
    above its target can't come down, so they add up to more, the next of SCALES being tried where a
    fit ends outside the tolerance. If none ends inside, the rates with the closest shares are taken
    (of alike ones the smallest total), and a warning names what was reached.
    """
    p = [F.col(f"p_{d}") for d in DOMAINS]
    n = F.col("n_tokens").cast("double")
    names = [(i, j) for i in range(len(p)) for j in range(i, len(p))]

    def sums(rate: Column, moves: Column) -> tuple[np.ndarray, np.ndarray]:
        """(total of each domain at these rates, Gram matrix of the rows that move)."""
        zero = F.lit(0.0)
        row = members.agg(*[F.coalesce(F.sum(n * x * rate), zero) for x in p], *[F.coalesce(F.sum(F.when(moves, n * p[i] * p[j])), zero) for i, j in names]).first()
        gram = np.zeros((len(p), len(p)))
        for value, (i, j) in zip(row[len(p) :], names, strict=True):
            gram[i, j] = gram[j, i] = value
        return np.array(row[: len(p)], float), gram

    even = F.lit(max(1.0, lowest))
    start, gram = sums(even, F.lit(True))
    if start.sum() == 0:
        return even
    ridge = 1e-9 * np.trace(gram) * np.eye(len(p))
    share = np.array([targets[d] for d in DOMAINS], float)
    share /= share.sum()
    base = gram.sum(axis=1)  # each domain's tokens at rate 1: a row's posteriors add up to 1
    whole, scales = float(base.sum()), (1.0,)
    if lowest > 0:
        whole, scales = max(whole, float((lowest * base[share > 0] / share[share > 0]).max())), SCALES
    missed = lambda totals: float(np.abs(totals / totals.sum() - share).max())
    best, least, reached = even, missed(start), start
    for scale in scales:
        goal = share * whole * scale
        rate, totals, own, slope, last = even, start, gram, np.zeros(len(p)), np.inf
        for k in range(rounds):
            if k:
                totals, own = sums(rate, rate > lowest)
            off = np.abs(totals - goal).max()
            if off <= tolerance * goal.sum():
                return rate
            if lowest == 0 or totals.sum() <= 1.5 * goal.sum():
                if totals.sum() > 0 and (miss := missed(totals)) < least - tolerance / 10:
                    best, least, reached = rate, miss, totals
            if abs(last - off) <= 1e-6 * goal.sum():
                break
            last = off
            slope = slope - np.linalg.solve(own + ridge, totals - goal)
            rate = F.greatest(F.lit(float(lowest)), even + sum((float(s) * x for s, x in zip(slope, p, strict=True)), F.lit(0.0)))
    if least > tolerance:
        got = dict(zip(DOMAINS, (reached / reached.sum()).round(4).tolist(), strict=True))
        warnings.warn(f"mixing: targets {dict(zip(DOMAINS, share.round(4).tolist(), strict=True))} not reached with rates of at least {lowest}: {got}", stacklevel=2)
    return best


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, lowest: float = 0.0, per_domain: int = PER_DOMAIN, seed: int = 0) -> DataFrame:
    """(doc_id, n_tokens, p_good, p_rough, p_toxic, rate, copies): one row for each doc_id.

    copies is the rate rounded up or down by a hash of doc_id, its mean being the rate. Rows that
    repeat a doc_id are one document (the longest counts; their words together). A null doc_id is one
    document of its own. Null and empty texts have no tokens and alike posteriors. Without usable labels
    all posteriors are alike. Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    members = cut(posteriors(docs, word_table(docs, labels, per_domain), priors(labels)))
    rate = fit(members, targets or TARGETS, lowest)
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    return members.withColumn("rate", rate.cast("double")).withColumn("copies", (F.floor("rate") + (part < F.col("rate") - F.floor("rate")).cast("int")).cast("long"))


def mix(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Each row of docs as often as its document's copies say; columns of any name pass through as they are."""
    found = redeal(rates(docs, labels, **options).select(F.col("doc_id").alias("id"), "copies"), "id")
    whole = docs.select("doc_id", F.struct("*").alias("row"))
    joined = whole.join(found, whole["doc_id"].eqNullSafe(found["id"])).where("copies > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
