"""Queries of what seekers state: parses, resolution tiers, the full ladder of arms and its measures. Codes and places are derived from ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import evaluation as V
from tidewell.operators import records as K
from tidewell.operators import retrieval as T
from tidewell.plans.evaluation import _ARMS, rankings
from tidewell.plans.records import case, picked
from tidewell.plans.registry import Registry
from tidewell.plans.retrieval import _BM25, _LT, _NOISE, _SEV, _TOP, _VEC, _W, constrained_pairs, docs, facets, rounded, seekers, severity, speakers, vectors
from tidewell.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.query

_PARTS = "SELECT item_id AS query_id, k AS place, CASE k WHEN 0 THEN 'nurse' WHEN 1 THEN substr(text, 1, 12) ELSE 'excel' END AS value, CASE WHEN (item_id + k) % 2 = 0 THEN 'hard' ELSE 'soft' END AS priority FROM benchmark, (VALUES (0), (1), (2)) v(k) WHERE (item_id + k) % 5 > 0"


def parts(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("place")).where((F.col("query_id") + F.col("place")) % 5 > 0)
    return picked(rows, value="CASE place WHEN 0 THEN 'nurse' WHEN 1 THEN substr(text, 1, 12) ELSE 'excel' END", priority="CASE WHEN (query_id + place) % 2 = 0 THEN 'hard' ELSE 'soft' END").drop("text")


@query(f"SELECT query_id, string_agg(CASE priority WHEN 'hard' THEN value || ' ' || value || ' ' || value ELSE value END, ' ' ORDER BY place) AS text FROM ({_PARTS}) GROUP BY 1")
def weighted_parse(spark, d):
    """RET19, ARR5: what was stated, repeated by priority. Scores don't change by it: a query's term counts once."""
    return T.weighted_query(parts(spark, d))


_CONS = "SELECT item_id AS query_id, k AS place, CASE (item_id + k) % 4 WHEN 0 THEN 'language.norwegian' WHEN 1 THEN 'occupation' ELSE 'skill' END AS facet, 'v' || (item_id * 3 + k) AS value FROM benchmark, (VALUES (0), (1), (2)) v(k) WHERE item_id % 3 <> 0"


@query(f"WITH c AS ({_CONS}), f AS (SELECT query_id, facet, arg_min(value, place) AS value FROM c GROUP BY 1, 2) SELECT item_id AS query_id, l.value AS language, o.value AS occupation FROM benchmark LEFT JOIN f l ON l.query_id = item_id AND l.facet = 'language.norwegian' LEFT JOIN f o ON o.query_id = item_id AND o.facet = 'occupation'")
def profile_bridge(spark, d):
    """X1, X2: no row of a facet is no constraint, never a default; of several rows the first counts."""
    rows = table(spark, d, "benchmark").where("item_id % 3 <> 0").select(F.col("item_id").alias("query_id"), F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("place"))
    rows = picked(rows, facet="CASE (query_id + place) % 4 WHEN 0 THEN 'language.norwegian' WHEN 1 THEN 'occupation' ELSE 'skill' END", value="concat('v', query_id * 3 + place)")
    out = seekers(spark, d).select("query_id")
    for facet, name in (("language.norwegian", "language"), ("occupation", "occupation")):
        out = out.join(K.first_value(rows, "query_id", facet).withColumnRenamed("value", name), "query_id", "left")
    return out


_TOLD = case("item_id", 5, "'I do not speak any Norwegian'", "'nurse, fluent Norwegian'", "'no night shifts please, but after many years of practice here I have good norsk'", "text", "'uten norsk'")


@query(f"SELECT item_id, CASE WHEN regexp_matches(t, '(?i)\\b(no|not|don''t|without|ikke|uten|ingen)\\b.{{0,42}}(norwegian|norsk)') THEN 'none' WHEN regexp_matches(t, '(?i)(norwegian|norsk)') THEN 'fluent' END AS level FROM (SELECT item_id, {_TOLD} AS t FROM benchmark)")
def negation_level(spark, d):
    """RET25"""
    return picked(table(spark, d, "benchmark"), t=_TOLD).select("item_id", T.stated_level(F.col("t")).alias("level"))


_ASK = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'the ' || p_name || ' of' WHEN 2 THEN p_name || ' extra' ELSE 'Gizmo' END"
_STAGED = f"""p AS (SELECT p_partkey AS phrase_id, {_ASK} AS phrase FROM part), l AS (SELECT DISTINCT p_name AS label FROM part), pk AS (SELECT phrase_id, array_to_string({_W.format('phrase')}, ' ') AS k, {_LT.format(_W.format('phrase'), _NOISE)} AS pt FROM p), lk AS (SELECT label, array_to_string({_W.format('label')}, ' ') AS k, {_LT.format(_W.format('label'), _NOISE)} AS lt FROM l),
ex AS (SELECT phrase_id, label, 'exact' AS tier FROM pk JOIN lk USING (k) WHERE k <> ''), p2 AS (SELECT * FROM pk WHERE phrase_id NOT IN (SELECT phrase_id FROM ex)), st AS (SELECT phrase_id, label, 'tokens' AS tier FROM p2 JOIN lk ON list_sort(pt) = list_sort(lt) WHERE len(pt) > 0), p3 AS (SELECT DISTINCT pt FROM p2 WHERE phrase_id NOT IN (SELECT phrase_id FROM st)),
sc AS (SELECT pt, label, len(list_intersect(pt, lt))::DOUBLE / (len(pt) + len(lt) - len(list_intersect(pt, lt))) AS s FROM p3, lk WHERE len(list_intersect(pt, lt)) > 0), rk AS (SELECT *, rank() OVER (PARTITION BY pt ORDER BY s DESC) AS r FROM sc WHERE s >= 0.30),
staged AS (SELECT * FROM ex UNION ALL SELECT * FROM st UNION ALL SELECT phrase_id, label, 'similar' FROM p2 JOIN rk USING (pt) WHERE r = 1 AND phrase_id NOT IN (SELECT phrase_id FROM st))"""


def staged(spark, d):
    part = table(spark, d, "part")
    return T.staged_labels(part.select(F.col("p_partkey").alias("phrase_id"), F.expr(_ASK).alias("phrase")), part.select(F.col("p_name").alias("label")).distinct())


@query(f"WITH {_STAGED} SELECT phrase_id, label, tier FROM staged")
def staged_resolve(spark, d):
    """RET4: exact, then token set, then similarity."""
    return staged(spark, d)


@query(f"""WITH {_STAGED}, n AS (SELECT phrase_id, count(DISTINCT label) AS n_codes, bool_or(tier = 'exact') AS exact FROM staged GROUP BY 1), q AS (SELECT p_partkey, p_retailprice AS score, (p_partkey % 5)::DOUBLE / 4 AS prox, coalesce(n_codes, 0) AS n_codes, coalesce(exact, false) AS exact FROM part LEFT JOIN n ON phrase_id = p_partkey)
SELECT p_partkey, round(CASE WHEN n_codes = 0 THEN score WHEN exact THEN score * 0.22 + score * 0.78 * prox WHEN n_codes <= 2 THEN score * 0.38 + score * 0.62 * prox ELSE score * (1 + 0.18 * prox) END, 4) AS score FROM q""")
def occupation_trust(spark, d):
    """RET22: how far a resolution is trusted depends on its tier and on how many codes it gave."""
    n = staged(spark, d).groupBy("phrase_id").agg(F.count_distinct("label").alias("n_codes"), F.bool_or(F.col("tier") == "exact").alias("exact"))
    q = table(spark, d, "part").join(n, F.col("phrase_id") == F.col("p_partkey"), "left")
    score = T.trusted(F.col("p_retailprice"), (F.col("p_partkey") % 5).cast("double") / 4, F.coalesce("exact", F.lit(False)), F.coalesce("n_codes", F.lit(0)))
    return q.select("p_partkey", F.round(score, 4).alias("score"))


@query(_BM25 + "," + _SEV + """, o AS (SELECT query_id, s.doc_id, score, speaker, lang, coalesce(contains(lower(text), 'the'), false) AS hit FROM s JOIN sev USING (query_id, doc_id) JOIN (SELECT doc_id, lang, text FROM documents) d ON d.doc_id = s.doc_id),
l AS (SELECT query_id, doc_id, CASE WHEN lang = 'en' AND speaker IN ('none', 'basic') THEN score * (1 + 0.22 * 0.7) ELSE score END + CASE WHEN hit THEN 0.02 ELSE 0.0 END AS score FROM o)""" + _TOP.format("l"))
def lift_and_tie(spark, d):
    """RET23, RET24: what is open is lifted for those who speak little; a label match breaks ties."""
    own = docs(spark, d).withColumn("hit", F.contains(F.lower("text"), F.lit("the")))
    met = T.bm25(own, seekers(spark, d), keep=("lang", "hit")).join(F.broadcast(speakers(spark, d)), "query_id")  # the stated queries
    score = T.open_lift(F.col("score"), F.coalesce(F.col("lang") == "en", F.lit(False)), F.col("speaker"), 0.7) + F.when(F.coalesce("hit", F.lit(False)), T.TIE).otherwise(0.0)
    return rounded(T.first_ranked(met.select("query_id", "doc_id", score.alias("score"))))


_PREFIX = "CASE WHEN substr({0}, 1, 4) = substr({1}, 1, 4) THEN 1.0 WHEN substr({0}, 1, 3) = substr({1}, 1, 3) THEN 0.7 WHEN substr({0}, 1, 2) = substr({1}, 1, 2) THEN 0.4 WHEN substr({0}, 1, 1) = substr({1}, 1, 1) THEN 0.15 ELSE 0.0 END"
_CODE = "(1000 + {0} * 37 % 9000)::VARCHAR"


@query(f"""WITH i AS (SELECT doc_id, 'u' || doc_id % 50 AS uri, {_CODE.format('doc_id')} AS code FROM documents), s AS (SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 0 THEN 0 ELSE 1 END AS got, 'u' || n_nationkey AS u, {_CODE.format('n_nationkey * 11')} AS c1, {_CODE.format('n_nationkey * 5')} AS c2 FROM nation),
x AS (SELECT n_nationkey, CASE WHEN got = 0 THEN 0.0 WHEN uri = u THEN 1.0 ELSE greatest({_PREFIX.format('c1', 'code')}, {_PREFIX.format('c2', 'code')}) END AS p FROM i, s) SELECT n_nationkey, round(p, 2)::DOUBLE AS proximity, count(*) AS n FROM x GROUP BY 1, 2""")
def identity_proximity(spark, d):
    """RET9, RET8, RET6: one concept is identity, else the best prefix of its codes; who isn't resolved changes nothing. Nations stand for stated occupations."""
    code = lambda c: (1000 + c * 37 % 9000).cast("string")
    items = docs(spark, d).select(F.concat(F.lit("u"), (F.col("doc_id") % 50).cast("string")).alias("uri"), code(F.col("doc_id")).alias("code"))
    k = F.col("n_nationkey")
    some = lambda c: F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(c)
    asked = table(spark, d, "nation").select("n_nationkey", some(F.array(F.concat(F.lit("u"), k.cast("string")))).alias("uris"), some(F.array(code(k * 11), code(k * 5))).alias("codes"))
    met = items.groupBy("uri", "code").agg(F.count("*").alias("m")).join(F.broadcast(asked))  # 25 stated occupations
    return met.groupBy("n_nationkey", F.round(T.identity_or_prefix(F.col("uri"), F.col("code"), F.col("uris"), F.col("codes")), 2).alias("proximity")).agg(F.sum("m").alias("n"))


@query("""WITH g AS (SELECT lower(n_name) AS municipal, arg_min(lower(r_name), c_custkey) AS county FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = (n_regionkey + c_custkey % 2) % 5 GROUP BY 1),
l AS (SELECT c_custkey, c_acctbal, lower(n_name) AS m, c_custkey % 3 AS k FROM customer JOIN nation ON c_nationkey = n_nationkey), w AS (SELECT county FROM g WHERE municipal = 'nation_3')
SELECT c_custkey, round(CASE WHEN k = 0 THEN c_acctbal WHEN m = 'nation_3' THEN c_acctbal WHEN county = (SELECT county FROM w) THEN c_acctbal * (0.35 + 0.65 * (0.3 + 0.7 * 0.55)) ELSE c_acctbal * (0.35 + 0.65 * 0.3) END, 8) AS score FROM l JOIN g ON municipal = m""")
def place_apply(spark, d):
    """RET10, RET12, JOIN14: places learned from rows (the first county wins), applied to scores; a seeker without a place changes nothing."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    rows = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # nations and regions are fixed dimensions
    seen = rows.join(F.broadcast(region), F.col("r_regionkey") == (F.col("n_regionkey") + F.col("c_custkey") % 2) % 5)
    known = T.gazetteer(seen.select(F.col("n_name").alias("municipal"), F.col("r_name").alias("county"), "c_custkey"), "c_custkey")
    wanted = F.broadcast(known.where("municipal = 'nation_3'").select(F.col("municipal").alias("asked"), F.col("county").alias("asked_county")))
    met = rows.withColumn("municipal", X.place_key(F.col("n_name"))).join(F.broadcast(known), "municipal").join(wanted)
    near = F.when(F.col("municipal") == F.col("asked"), 1.0).when(F.col("county") == F.col("asked_county"), 0.55).otherwise(0.0)
    return met.select("c_custkey", F.round(T.lift(F.col("c_acctbal"), near, F.col("c_custkey") % 3 != 0), 8).alias("score"))


_QCODE, _DCODE = _CODE.format("query_id * 11"), _CODE.format("doc_id")
_EIGHT = _BM25 + "," + _SEV + f""", e AS (SELECT query_id, doc_id, list_inner_product(q.v, u.v) AS score FROM (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: x::DOUBLE) AS w, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) AS v FROM embeddings) u, (SELECT item_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS w, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) AS v FROM benchmark JOIN embeddings ON vec_id = item_id) q),
p AS (SELECT query_id, doc_id, score AS raw, score * CASE WHEN query_id % 2 = 0 THEN 1.0 ELSE 1.1 END AS parse, severity, {_PREFIX.format(_QCODE, _DCODE)} AS prox, CASE WHEN doc_id % 50 = query_id % 50 THEN 1.0 ELSE {_PREFIX.format(_QCODE, _DCODE)} END AS same, (doc_id % 4)::DOUBLE / 3 AS skills FROM s JOIN sev USING (query_id, doc_id)),
a AS (SELECT 'bm25_raw' AS arm, query_id, doc_id, raw AS score FROM p UNION ALL SELECT 'bm25_parse', query_id, doc_id, parse FROM p UNION ALL SELECT 'styrk', query_id, doc_id, parse * (0.35 + 0.65 * (0.3 + 0.7 * prox)) FROM p UNION ALL SELECT 'esco', query_id, doc_id, parse * (0.35 + 0.65 * (0.3 + 0.7 * same)) FROM p
UNION ALL SELECT 'constr_soft', query_id, doc_id, parse * (0.35 + 0.65 * (0.3 + 0.7 * same)) * (1 - 0.7 * severity) FROM p UNION ALL SELECT 'constr_hard', query_id, doc_id, parse * (0.35 + 0.65 * (0.3 + 0.7 * same)) * (1 - severity) FROM p
UNION ALL SELECT 'skills_esco', query_id, doc_id, parse * (0.35 + 0.65 * (0.3 + 0.7 * same)) * (1 + 0.45 * skills) FROM p UNION ALL SELECT 'dense', query_id, doc_id, score FROM e),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arm, query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM a WHERE score > 0) WHERE rank <= 10)
"""


def eight_arms(spark, d):
    """One lexical pass feeds seven arms, each a stage more; the dense arm stands apart."""
    met = constrained_pairs(spark, d)
    q, i = F.col("query_id"), F.col("doc_id")
    code = lambda c: (1000 + c * 37 % 9000).cast("string")
    prox = T.prefix_proximity(code(q * 11), code(i))
    same = F.when(i % 50 == q % 50, 1.0).otherwise(prox)
    parse = F.col("score") * F.when(q % 2 == 0, 1.0).otherwise(1.1)  # what parsing a query adds, for want of real parses
    yes, stated = F.lit(True), F.col("speaker").isNotNull()
    esco = T.lift(parse, same, yes)
    scores = {"bm25_raw": F.col("score"), "bm25_parse": parse, "styrk": T.lift(parse, prox, yes), "esco": esco, "constr_soft": T.penalise(esco, severity(), stated, 0.7), "constr_hard": T.penalise(esco, severity(), stated, 1.0), "skills_esco": esco * (1 + 0.45 * (i % 4).cast("double") / 3)}
    e, _ = vectors(spark, d)
    asked = seekers(spark, d).select("query_id").join(e.withColumnRenamed("doc_id", "query_id"), "query_id")
    return T.ranked(T.leading(met, scores).unionByName(T.nearest(e, asked).select(F.lit("dense").alias("arm"), "query_id", "doc_id", "score")), 10, ["arm", "query_id"])


@query(_EIGHT + "SELECT arm, query_id, doc_id, rank, round(score, 5) AS score FROM r")
def full_ladder(spark, d):
    """RET18: all eight arms."""
    return eight_arms(spark, d).select("arm", "query_id", "doc_id", "rank", F.round("score", 5).alias("score"))


@query(_EIGHT + f"SELECT arm, count(*) FILTER (rank <= 5) AS n, round(avg(CASE WHEN {_PREFIX.format(_QCODE, _DCODE)} >= 0.7 THEN 1.0 ELSE 0.0 END) FILTER (rank <= 5), 6) AS precision5 FROM r GROUP BY 1")
def occupation_precision(spark, d):
    """MET9: the share of the first five whose code is near the stated one."""
    code = lambda c: (1000 + c * 37 % 9000).cast("string")
    near = T.prefix_proximity(code(F.col("query_id") * 11), code(F.col("doc_id"))) >= 0.7
    return eight_arms(spark, d).where("rank <= 5").groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg(near.cast("int")), 6).alias("precision5"))


@query(_ARMS + ", b AS (SELECT r.arm, r.query_id, r.rank, f.level IN ('certified', 'conversational') AS blocking, f.lang FROM r JOIN f USING (doc_id)) SELECT arm, query_id, count(*) FILTER (blocking) AS n_blocking, count(*) FILTER (lang = 'en') AS recovered, count(*) FILTER (rank <= 5 AND lang = 'en') > 0 AND count(*) FILTER (rank <= 5 AND blocking) = 0 AS discriminates FROM b GROUP BY 1, 2")
def top_ten_counts(spark, d):
    """MET10, MET11, MET15: blocking items in the first ten, members of a signal set found there, and whether the first five hold a wanted and no unwanted one."""
    met = rankings(spark, d).join(facets(spark, d), "doc_id")
    blocking, wanted = F.coalesce(F.col("level").isin(T.BLOCKING), F.lit(False)), F.coalesce(F.col("lang") == "en", F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    first = F.col("rank") <= 5
    return met.groupBy("arm", "query_id").agg(n(blocking).alias("n_blocking"), n(wanted).alias("recovered"), ((n(first & wanted) > 0) & (n(first & blocking) == 0)).alias("discriminates"))


@query(_VEC + """, x AS (SELECT query_id, label >= 5 AS p, round(score, 9) AS score, CASE WHEN query_id % 100 = 0 THEN 'negated' ELSE 'positive' END AS side FROM s), t AS (SELECT side, score, count(*) FILTER (p) AS a, count(*) FILTER (NOT p) AS b FROM x GROUP BY 1, 2), c AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY side ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t),
w AS (SELECT side, sum(a * below)::DOUBLE / nullif(sum(a) * sum(b), 0) AS auc FROM c GROUP BY 1) SELECT round(max(auc) FILTER (side = 'negated') - max(auc) FILTER (side = 'positive'), 6) AS delta FROM w""")
def polarity_delta(spark, d):
    """MET12: what denying does to how well scores separate: the difference of two AUCs."""
    e, asked = vectors(spark, d)
    side = F.when(F.col("query_id") % 100 == 0, 1).otherwise(0)
    u = T.cosine_auc(e.withColumn("p", F.col("label") >= 5), asked.withColumn("side", side))
    one = lambda s: F.max(F.when(F.col("side") == s, F.col("auc")))
    return u.agg(F.round(one(1) - one(0), 6).alias("delta"))
