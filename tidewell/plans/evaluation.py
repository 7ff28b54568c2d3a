"""Evaluation queries. labels holds judgments: quality and source give the grade, toxic says that a constraint is violated."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import evaluation as V
from tidewell.operators import retrieval as T
from tidewell.plans.registry import Registry
from tidewell.plans.retrieval import _BM25, _SEV, constrained_pairs, severity
from tidewell.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.query
ARMS = ["raw", "soft", "hard"]

_ARMS = _BM25 + "," + _SEV + """,
a AS (SELECT 'raw' AS arm, query_id, doc_id, score FROM s UNION ALL SELECT 'soft', query_id, doc_id, score * (1 - 0.7 * severity) FROM s JOIN sev USING (query_id, doc_id) UNION ALL SELECT 'hard', query_id, doc_id, score * (1 - severity) FROM s JOIN sev USING (query_id, doc_id)),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arm, query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM a WHERE score > 0) WHERE rank <= 10),
j AS (SELECT query_id, doc_id, quality * 2 + (doc_id + query_id) % 2 AS grade, toxic = 1 AS violates FROM (SELECT DISTINCT query_id, doc_id FROM r) JOIN labels USING (doc_id)),
i AS (SELECT query_id, sum((pow(2.0, grade) - 1) / log2(rk + 1)) AS idcg FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS rk FROM j) WHERE rk <= 10 GROUP BY 1),
m0 AS (SELECT arm, query_id, avg(CASE WHEN violates THEN 1.0 ELSE 0.0 END) AS cvr, sum(coalesce((pow(2.0, grade) - 1) / log2(rank + 1), 0)) / max(CASE WHEN idcg > 0 THEN idcg END) AS ndcg0, coalesce(1.0 / min(CASE WHEN grade >= 2 THEN rank END), 0) AS mrr, avg(CASE WHEN grade IS NULL THEN 0.0 ELSE 1.0 END) AS judged FROM r LEFT JOIN j USING (query_id, doc_id) LEFT JOIN i USING (query_id) GROUP BY 1, 2),
m AS (SELECT arm, query_id, cvr, coalesce(ndcg0, 0.0) AS ndcg, mrr, judged FROM m0)
"""


def rankings(spark, d):
    """The arms' first tens. One scoring pass feeds all arms: a stage only changes the score."""
    stated = F.col("speaker").isNotNull()
    arms = {a: T.penalise(F.col("score"), severity(), stated, s) for a, s in (("raw", 0), ("soft", 0.7), ("hard", 1.0))}
    return T.ranked(T.leading(constrained_pairs(spark, d), arms), 10, ["arm", "query_id"])


def judgments(spark, d, ranks):
    """Judged pairs of the pool: a label's document, with a grade that depends on the query too."""
    grade = (F.col("quality") * 2 + (F.col("doc_id") + F.col("query_id")) % 2).alias("grade")
    return V.pool(ranks).join(table(spark, d, "labels"), "doc_id").select("query_id", "doc_id", grade, (F.col("toxic") == 1).alias("violates"))


def per_query(spark, d):
    ranks = rankings(spark, d).persist()  # ten rows for each arm and query
    return V.metrics(ranks, judgments(spark, d, ranks))


@query(_ARMS + "SELECT arm, query_id, doc_id, rank, round(score, 6) AS score FROM r")
def arm_ladder(spark, d):
    return rankings(spark, d).select("arm", "query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(_ARMS + "SELECT DISTINCT query_id, doc_id FROM r")
def pool_depth10(spark, d):
    return V.pool(rankings(spark, d))


@query(_ARMS + "SELECT x.query_id, count(y.doc_id) AS both FROM (SELECT DISTINCT query_id, doc_id FROM r WHERE arm IN ('raw', 'hard')) x LEFT JOIN (SELECT a.query_id, a.doc_id FROM r a JOIN r b ON a.query_id = b.query_id AND a.doc_id = b.doc_id WHERE a.arm = 'raw' AND b.arm = 'hard') y ON x.query_id = y.query_id AND x.doc_id = y.doc_id GROUP BY 1")
def overlap_at_k(spark, d):
    return V.overlap(rankings(spark, d), "raw", "hard")


@query(_ARMS + "SELECT arm, query_id, round(cvr, 6) AS cvr FROM m")
def cvr_at_10(spark, d):
    return per_query(spark, d).select("arm", "query_id", F.round("cvr", 6).alias("cvr"))


@query(_ARMS + "SELECT arm, query_id, round(ndcg, 6) AS ndcg FROM m")
def ndcg_at_10(spark, d):
    return per_query(spark, d).select("arm", "query_id", F.round("ndcg", 6).alias("ndcg"))


@query(_ARMS + "SELECT arm, query_id, round(mrr, 6) AS mrr FROM m")
def mrr_at_10(spark, d):
    return per_query(spark, d).select("arm", "query_id", F.round("mrr", 6).alias("mrr"))


@query(_ARMS + "SELECT arm, query_id, round(judged, 6) AS judged FROM m")
def judged_share(spark, d):
    return per_query(spark, d).select("arm", "query_id", F.round("judged", 6).alias("judged"))


@query(_ARMS + "SELECT arm, count(*) AS n, round(avg(cvr), 6) AS cvr, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr, round(avg(judged), 6) AS judged FROM m GROUP BY 1")
def arm_macro(spark, d):
    return V.macro(per_query(spark, d)).withColumns({c: F.round(c, 6) for c in ("cvr", "ndcg", "mrr", "judged")})


@query("""WITH v AS (SELECT conv_id, role, length(text) AS n FROM conversations) SELECT conv_id, round(a - u, 6) AS delta FROM (SELECT conv_id, avg(CASE WHEN role = 'user' THEN n END) AS u, avg(CASE WHEN role = 'assistant' THEN n END) AS a FROM v GROUP BY 1) WHERE a IS NOT NULL AND u IS NOT NULL""")
def paired_delta(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "role", F.length("text").alias("n"))
    return V.paired_delta(rows, "conv_id", "role", "user", "assistant", "n").withColumn("delta", F.round("delta", 6))


@query(_ARMS + "SELECT x.arm AS from_arm, y.arm AS to_arm, count(*) AS n, round(avg(y.ndcg - x.ndcg), 6) AS delta FROM m x JOIN m y USING (query_id) WHERE (x.arm = 'raw' AND y.arm = 'soft') OR (x.arm = 'soft' AND y.arm = 'hard') GROUP BY 1, 2")
def ladder_deltas(spark, d):
    return V.ladder(per_query(spark, d), ARMS, "ndcg").withColumn("delta", F.round("delta", 6))


@query()
def bootstrap_ci(spark, d):
    """AGG17: 10,000 seeded resamples; tested against the plain loop."""
    return V.bootstrap(per_query(spark, d), ARMS, "ndcg")


@query("""WITH g AS (SELECT source, count(*) AS n, sum(toxic) AS k FROM labels JOIN documents USING (doc_id) GROUP BY 1), p AS (SELECT *, k::DOUBLE / n AS p FROM g)
SELECT source, n, k::BIGINT AS k, round(greatest(0, (p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS lo, round(least(1, (p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS hi FROM p""")
def wilson_interval(spark, d):
    g = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    lo, hi = V.wilson(F.col("k"), F.col("n"))
    return g.select("source", "n", "k", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


_PRED = "CASE WHEN n_chars % 7 = 0 THEN 1 - quality ELSE quality END"


@query(f"SELECT want, got, n, n::DOUBLE / sum(n) OVER (PARTITION BY want) AS share FROM (SELECT quality AS want, {_PRED} AS got, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2)")
def confusion_matrix(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("quality").alias("want"), F.expr(_PRED).alias("got"))
    return rows.groupBy("want", "got").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("want")))


@query(f"""WITH c AS (SELECT lang, count(*) FILTER (quality = 0 AND {_PRED} = 0) AS tp, count(*) FILTER (quality = 1 AND {_PRED} = 0) AS fp, count(*) FILTER (quality = 0 AND {_PRED} = 1) AS fn FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT lang, tp, fp, fn, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def prf_null_safe(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").withColumn("got", F.expr(_PRED))
    n = lambda c: F.count(F.when(F.expr(c), 1))
    c = rows.groupBy("lang").agg(n("quality = 0 and got = 0").alias("tp"), n("quality = 1 and got = 0").alias("fp"), n("quality = 0 and got = 1").alias("fn"))
    out = c.select("lang", "tp", "fp", "fn", *V.precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))
    return out.withColumns({k: F.round(k, 6) for k in ("precision", "recall", "f1")})


@query("""WITH x AS (SELECT lang, n_chars, toxic = 1 AS p FROM labels JOIN documents USING (doc_id)), t AS (SELECT lang, n_chars, count(*) FILTER (p) AS a, count(*) FILTER (NOT p) AS b FROM x GROUP BY 1, 2),
w AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY lang ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t) SELECT lang, sum(a)::BIGINT AS n_pos, sum(b)::BIGINT AS n_neg, round(sum(a * below)::DOUBLE / nullif(sum(a) * sum(b), 0), 6) AS auc FROM w GROUP BY 1""")
def auc_signal(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("lang", "n_chars", (F.col("toxic") == 1).alias("p"))
    return V.auc(rows, ["lang"], "n_chars", "p").withColumn("auc", F.round("auc", 6))


@query("""SELECT lang, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'middle' ELSE 'long' END AS bin, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(avg(quality), 6) END AS mean FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2""")
def binned_means(spark, d):
    """Means of bins, null where a bin has too few rows to say anything."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "middle").otherwise("long")
    return rows.groupBy("lang", size.alias("bin")).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.round(F.avg("quality"), 6)).alias("mean"))


@query("""WITH b AS (SELECT avg(toxic) AS base FROM labels) SELECT source, count(*) AS n, round(avg(toxic) / nullif(max(base), 0), 6) AS enrichment FROM labels JOIN documents USING (doc_id), b GROUP BY 1""")
def enrichment(spark, d):
    labels = table(spark, d, "labels")
    base = labels.agg(F.avg("toxic").alias("base"))
    return labels.join(table(spark, d, "documents"), "doc_id").join(F.broadcast(base)).groupBy("source").agg(F.count("*").alias("n"), F.round(F.try_divide(F.avg("toxic"), F.max("base")), 6).alias("enrichment"))


@query("""WITH u AS (SELECT 'quality' AS facet, quality AS v FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'toxic', toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT facet, count(*) AS n, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 6) AS silent, round(avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END), 6) AS absent FROM u GROUP BY 1""")
def silence_census(spark, d):
    """How often a facet says nothing, and how often it says no: never the same thing."""
    met = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    long = met.unpivot(["doc_id"], ["quality", "toxic"], "facet", "v")
    return long.groupBy("facet").agg(F.count("*").alias("n"), F.round(F.avg(F.col("v").isNull().cast("double")), 6).alias("silent"), F.round(F.avg(F.coalesce((F.col("v") == 0).cast("double"), F.lit(0.0))), 6).alias("absent"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(CASE WHEN i = floor(n * 0.5) THEN value END) AS p50, max(CASE WHEN i = floor(n * 0.95) THEN value END) AS p95, max(CASE WHEN i = floor(n * 0.99) THEN value END) AS p99 FROM r GROUP BY 1""")
def percentile_pick(spark, d):
    """The value at index floor(n p) of the sorted list, found from counts of equal values: no group is sorted whole."""
    counted = table(spark, d, "events").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type")
    run = counted.withColumn("upto", F.sum("n").over(w.orderBy("value"))).withColumn("total", F.sum("n").over(w))
    pick = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("total") * p), F.col("value")))
    return run.groupBy("event_type").agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"), pick(0.99).alias("p99"))


def correlations(ranked):
    """AGG19 on two rankings a language; ties lower the first ranking's denominator."""
    found = V.rank_agreement(ranked, "lang", "n_chars", "doc_id").where("n > 2")
    return found.select("lang", "n", F.round("spearman", 6).alias("spearman"), F.round("kendall", 6).alias("kendall"))


@query("""WITH r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) AS a, rank() OVER (PARTITION BY lang ORDER BY doc_id) AS b FROM documents),
k AS (SELECT x.lang, sum(sign((x.a - y.a) * (x.b - y.b))) / 2 AS s FROM r x JOIN r y ON x.lang = y.lang GROUP BY 1), t AS (SELECT lang, count(*) AS n, corr(a, b) AS rho, sum(ties) AS ties FROM (SELECT *, (count(*) OVER (PARTITION BY lang, a) - 1) / 2.0 AS ties FROM r) GROUP BY 1)
SELECT lang, n, round(rho, 6) AS spearman, round(s / sqrt((n * (n - 1) / 2.0 - ties) * (n * (n - 1) / 2.0)), 6) AS kendall FROM k JOIN t USING (lang) WHERE n > 2""")
def rank_correlation(spark, d):
    return correlations(table(spark, d, "documents"))


@query("SELECT event_type, round(sum(value * 0.5 + event_id % 100 * 2.5) / 1e6, 9) AS cost, sum(event_id % 100)::BIGINT AS tokens, round(sum(event_id % 100)::DOUBLE / greatest(1, sum(event_id % 100) + sum(user_id % 10)), 6) AS cache_hit FROM events GROUP BY 1")
def spend_totals(spark, d):
    e = table(spark, d, "events")
    read, write = F.sum(F.col("event_id") % 100), F.sum(F.col("user_id") % 10)
    return e.groupBy("event_type").agg(F.round(F.sum(F.col("value") * 0.5 + F.col("event_id") % 100 * 2.5) / 1e6, 9).alias("cost"), read.alias("tokens"), F.round(read.cast("double") / F.greatest(F.lit(1), read + write), 6).alias("cache_hit"))


@query("""WITH s AS (SELECT lang, count(*) AS hits, avg(toxic) AS precision, count(toxic) AS audited FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1) SELECT count(*) AS strata, round(sum(hits * precision), 6) AS estimate, sum(hits)::BIGINT AS hits FROM s WHERE audited > 0""")
def stratified_estimate(spark, d):
    met = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    s = met.groupBy("lang").agg(F.count("*").alias("hits"), F.avg("toxic").alias("precision"), F.count("toxic").alias("audited")).where("audited > 0")
    return s.agg(F.count("*").alias("strata"), F.round(F.sum(F.col("hits") * F.col("precision")), 6).alias("estimate"), F.sum("hits").alias("hits"))


@query()
def skill_pairing(spark, d):
    """Greedy one-to-one pairing of benchmark sentences with their shortened forms; tested against the plain loop."""
    one = table(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.explode(F.split("text", "(?<=[.!?])\\s+")).alias("phrase"))
    other = one.select("item", F.when(F.length("phrase") % 3 == 0, F.regexp_replace("phrase", "[.]+$", "")).when(F.length("phrase") % 3 == 1, F.expr("substr(phrase, 5)")).otherwise(F.col("phrase")).alias("phrase"))
    return V.pair_phrases(one, other)
