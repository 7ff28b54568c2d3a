"""Evaluation: pools, ranking metrics, paired differences, bootstrap intervals, agreement scores."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class SealedQuery(RuntimeError):
    """A query of the sealed split was asked for."""


def assert_unsealed(queries: DataFrame, split: str = "split") -> None:
    if queries.where(F.col(split) == "sealed").limit(1).count():
        raise SealedQuery("sealed queries must not be pooled")


def pool(rankings: DataFrame, depth: int = 10) -> DataFrame:
    """(query_id, doc_id): what any arm has in its first `depth`, with a positive score; the arm isn't kept."""
    return rankings.where((F.col("rank") <= depth) & (F.col("score") > 0)).select("query_id", "doc_id").distinct()


def overlap(rankings: DataFrame, a: str, b: str, k: int = 10) -> DataFrame:
    """(query_id, both): documents that two arms' first k share."""
    top = rankings.where(F.col("rank") <= k).where(F.col("arm").isin(a, b))
    met = top.groupBy("query_id", "doc_id").agg(F.count_distinct("arm").alias("arms"))
    return met.groupBy("query_id").agg(F.count(F.when(F.col("arms") == 2, 1)).alias("both"))


def metrics(rankings: DataFrame, judgments: DataFrame, k: int = 10, relevant: int = 2) -> DataFrame:
    """(arm, query_id, cvr, ndcg, mrr, judged) from rankings (arm, query_id, doc_id, rank) and judgments (query_id, doc_id, grade, violates).

    A judgment belongs to a query and a document. cvr divides by the number of ranked documents, at
    most k. Unjudged documents don't violate and gain nothing. The ideal order is that of the query's judged pool.
    """
    top = rankings.where(F.col("rank") <= k).join(judgments, ["query_id", "doc_id"], "left")
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade")))
    ideal = judgments.withColumn("place", place).where(F.col("place") <= k).groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("place"))).alias("idcg"))
    hit = F.min(F.when(F.col("grade") >= relevant, F.col("rank")))
    per = top.groupBy("arm", "query_id").agg(
        F.avg(F.coalesce(F.col("violates").cast("double"), F.lit(0.0))).alias("cvr"),
        F.sum(F.coalesce(gain(F.col("grade"), F.col("rank")), F.lit(0.0))).alias("dcg"),
        F.coalesce(1.0 / hit, F.lit(0.0)).alias("mrr"),
        F.avg(F.col("grade").isNotNull().cast("double")).alias("judged"),
    )
    ndcg = F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)
    return per.join(ideal, "query_id", "left").select("arm", "query_id", "cvr", ndcg.alias("ndcg"), "mrr", "judged")


def macro(per_query: DataFrame) -> DataFrame:
    """(arm, n, cvr, ndcg, mrr, judged): each query counts once."""
    return per_query.groupBy("arm").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("cvr", "ndcg", "mrr", "judged")])


def paired_delta(values: DataFrame, pair: str, side: str, left: str, right: str, value: str) -> DataFrame:
    """(pair, delta = right - left) of pairs that have both sides."""
    one = lambda s: F.avg(F.when(F.col(side) == s, F.col(value)))
    return values.groupBy(pair).agg(one(left).alias("l"), one(right).alias("r")).where("l is not null and r is not null").select(pair, (F.col("r") - F.col("l")).alias("delta"))


def ladder(per_query: DataFrame, arms: list[str], metric: str) -> DataFrame:
    """(from_arm, to_arm, n, delta): the mean difference of each rung from the one below, over queries that both have."""
    steps = [(a, b) for a, b in zip(arms, arms[1:], strict=False)]
    pairs = per_query.sparkSession.createDataFrame(steps, "from_arm string, to_arm string")
    lo = per_query.select(F.col("arm").alias("from_arm"), "query_id", F.col(metric).alias("lo"))
    hi = per_query.select(F.col("arm").alias("to_arm"), "query_id", F.col(metric).alias("hi"))
    met = F.broadcast(pairs).join(lo, "from_arm").join(hi, ["to_arm", "query_id"])
    return met.groupBy("from_arm", "to_arm").agg(F.count("*").alias("n"), F.avg(F.col("hi") - F.col("lo")).alias("delta"))


def resample(differences: list[float], n: int = 10_000, seed: int = 0, alpha: float = 0.05) -> tuple:
    """(units, mean, low, high, excludes_zero) by the percentile bootstrap; fewer than two units give nulls."""
    units = len(differences)
    if units < 2:
        return units, None, None, None, None
    draw = random.Random(seed).randrange
    means = sorted(sum([differences[draw(units)] for _ in range(units)]) / units for _ in range(n))
    low, high = means[int(alpha / 2 * n)], means[min(int((1 - alpha / 2) * n), n - 1)]
    return units, sum(differences) / units, low, high, low > 0 or high < 0


def bootstrap(per_query: DataFrame, arms: list[str], metric: str, n: int = 10_000, seed: int = 0) -> DataFrame:
    """(from_arm, to_arm, n_units, delta, lo, hi, excludes_zero) for adjacent rungs; one small group each."""
    wide = per_query.groupBy("query_id").pivot("arm", arms).agg(F.first(metric))
    steps = F.array(*[F.struct(F.lit(a).alias("from_arm"), F.lit(b).alias("to_arm"), (F.col(b) - F.col(a)).alias("d")) for a, b in zip(arms, arms[1:], strict=False)])
    rows = wide.select("query_id", F.explode(steps).alias("s")).select("query_id", "s.*").where("d is not null")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values("query_id")
        return pd.DataFrame([(own.from_arm.iloc[0], own.to_arm.iloc[0], *resample(own.d.tolist(), n, seed))], columns=["from_arm", "to_arm", "n_units", "delta", "lo", "hi", "excludes_zero"])

    return rows.groupBy("from_arm", "to_arm").applyInPandas(run, "from_arm string, to_arm string, n_units long, delta double, lo double, hi double, excludes_zero boolean")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of k out of n, inside [0, 1]; null if n is 0."""
    p = F.try_divide(k.cast("double"), n.cast("double"))
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), middle - half)), F.when(some, F.least(F.lit(1.0), middle + half))


def auc(rows: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """(by, n_pos, n_neg, auc): how often a positive scores above a negative; ties count nothing. Running counts, no pairs."""
    tied = rows.groupBy(*by, score).agg(F.count(F.when(F.col(positive), 1)).alias("p"), F.count(F.when(~F.col(positive), 1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = tied.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return below.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum(F.col("p") * F.col("below")).alias("wins")).select(*by, "n_pos", "n_neg", F.try_divide(F.col("wins").cast("double"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"))


def rank_agreement(rows: DataFrame, by: str, x: str, y: str, width: int = 1 << 14) -> DataFrame:
    """(by, n, spearman, kendall) of the ranks by x and by y, all rows counting that have all three values.

    Ranks are running counts: of equal values of x, and of buckets of about `width` values of y. Two rows'
    ranks by y differ first in one binary digit, so each pair is met once: among the rows that share the digits
    before, running counts along x tell how many pairs agree. Their windows are no longer than x has values.
    Ties of x lower the first ranking's pairs.
    """
    known = rows.select(F.col(by), F.col(x).alias("x"), F.col(y).alias("y")).dropna()
    low, high, n = known.agg(F.min("y"), F.max("y"), F.count("*")).first()
    step = max(1.0, (float(high) - float(low) + 1) * width / n) if n else 1.0
    kept = known.withColumn("k", F.floor((F.col("y").cast("double") - F.lit(float(low or 0))) / step))
    first = kept.groupBy(by, "k").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.partitionBy(by).orderBy("k")) - F.col("c")).drop("c")
    same = known.groupBy(by, "x").agg(F.count("*").alias("c")).withColumn("a", F.sum("c").over(Window.partitionBy(by).orderBy("x")) - F.col("c") + 1)
    placed = kept.join(first, [by, "k"]).withColumn("b", F.col("before") + F.rank().over(Window.partitionBy(by, "k").orderBy("y")))
    ranked = placed.join(same.select(by, "x", "a"), [by, "x"]).select(by, "a", "b")
    digits = ranked.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(n.bit_length())))).select(by, "l", "a", F.expr("shiftright(b, l + 1)").alias("prefix"), F.expr("shiftright(b, l) & 1").alias("bit"))
    cells = digits.groupBy(by, "l", "prefix", "a").agg(F.sum("bit").alias("up"), (F.count("*") - F.sum("bit")).alias("down"))
    w = Window.partitionBy(by, "l", "prefix").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    net = F.col("up") * F.coalesce(F.sum("down").over(w), F.lit(0)) - F.col("down") * F.coalesce(F.sum("up").over(w), F.lit(0))
    agree = cells.select(by, net.alias("net")).groupBy(by).agg(F.sum("net").alias("s"))
    ties = same.groupBy(by).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2.0).alias("ties"))
    pairs = F.col("n") * (F.col("n") - 1) / 2.0
    met = ranked.groupBy(by).agg(F.count("*").alias("n"), F.corr("a", "b").alias("spearman")).join(agree, by).join(ties, by)
    return met.select(by, "n", "spearman", F.try_divide(F.col("s").cast("double"), F.sqrt((pairs - F.col("ties")) * pairs)).alias("kendall"))


def precision_recall(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1; null, not 0, where nothing can be divided by."""
    d = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return [d(tp, tp + fp).alias("precision"), d(tp, tp + fn).alias("recall"), d(2 * tp, 2 * tp + fp + fn).alias("f1")]


AGREEMENTS = ("strict", "trailing_punct_only", "containment")


def pair_greedily(golden: list[str], predicted: list[str]) -> list[tuple[int, int, str]]:
    """One-to-one pairs (golden, predicted, agreement): best agreement first, then the longer prediction."""
    found = []
    for i, g in enumerate(golden):
        for j, p in enumerate(predicted):
            if (kind := phrase_agreement(g, p)) != "disjoint":
                found.append((AGREEMENTS.index(kind), -len(p), i, j))
    out, used_g, used_p = [], set(), set()
    for kind, _, i, j in sorted(found):
        if i not in used_g and j not in used_p:
            used_g.add(i)
            used_p.add(j)
            out.append((i, j, AGREEMENTS[kind]))
    return out


def phrase_agreement(a: str, b: str, least: int = 15, trail: str = " .,;:") -> str:
    from tidewell.functions.text import fold

    raw = [fold(x).casefold() for x in (a, b)]
    key = [x.strip("-*•· ").strip(trail) for x in raw]
    if not all(key):
        return "disjoint"
    if key[0] == key[1]:
        return "strict" if raw[0] == raw[1] or all(x.strip(trail) == x for x in raw) else "trailing_punct_only"
    inside = key[0] in key[1] or key[1] in key[0]
    return "containment" if inside and min(map(len, key)) >= least else "disjoint"


def pair_phrases(golden: DataFrame, predicted: DataFrame) -> DataFrame:
    """(item, golden, predicted, agreement): greedy pairing of each item's phrases (item, phrase); unpaired ones have nulls."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        g, p = sorted(left["phrase"]), sorted(right["phrase"])
        pairs = pair_greedily(g, p)
        rows = [(key[0], g[i], p[j], kind) for i, j, kind in pairs]
        rows += [(key[0], g[i], None, "missed") for i in range(len(g)) if i not in {x[0] for x in pairs}]
        rows += [(key[0], None, p[j], "extra") for j in range(len(p)) if j not in {x[1] for x in pairs}]
        return pd.DataFrame(rows, columns=["item", "golden", "predicted", "agreement"])

    return golden.groupBy("item").cogroup(predicted.groupBy("item")).applyInPandas(run, "item long, golden string, predicted string, agreement string")
