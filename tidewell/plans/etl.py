"""Feed, state, taxonomy and clustering queries. events stands for the feed's revision log, part for occupations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import relational as R
from tidewell.plans.registry import Registry
from tidewell.sources.tables import table
from tidewell.streaming.latest import replay_latest

REGISTRY = Registry()
query = REGISTRY.query
ACTIVE, VERSION = "purchase", "v2"

_LATEST = "SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"
#: DuckDB's regular expressions have no lookbehind: words that state a level keep their number by a capture.
_CANON = r"""
WITH n AS (SELECT doc_id, lower(trim(regexp_replace(regexp_replace(translate(coalesce(text, ''), '‘’“”' || chr(160) || chr(8201) || chr(8239) || '–—', '''''""   --'), chr(173), '', 'g'), '\s+', ' ', 'g'), ' ')) AS low FROM documents),
m AS (SELECT doc_id, regexp_replace(regexp_replace(low, '((?:niv[åa]|norskpr[øo]ve|trinn|spr[åa]kniv[åa]|level|grade)[^\p{L}\p{N}_]{0,3}\d{1,9}|[abcABC]\d)|\d+', '\1#', 'g'), '((?:niv[åa]|norskpr[øo]ve|trinn|spr[åa]kniv[åa]|level|grade)[^\p{L}\p{N}_]{0,3}\d{1,9}|[abcABC]\d)#', '\1', 'g') AS masked FROM n),
c AS (SELECT doc_id, sha256(trim(regexp_replace(masked, '[^\p{L}\p{N}_#]+', ' ', 'g'), ' ')) AS signature FROM m)
"""


@query(_LATEST)
def latest_revision(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return R.latest_state(rows, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "ts")


@query(f"SELECT * FROM ({_LATEST}) WHERE event_type = '{ACTIVE}'")
def latest_active(spark, d):
    return latest_revision(spark, d).where(F.col("event_type") == ACTIVE)


@query("SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def stream_latest(spark, d):
    """The same state kept by a stream in event time, whatever the order of arrival."""
    return replay_latest(spark, f"{d}/events.parquet").select("user_id", "event_id", "event_type", "ts")


@query(f"SELECT user_id FROM ({_LATEST}) WHERE event_type = '{ACTIVE}' AND user_id NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 400000)")
def unfetched_ids(spark, d):
    done = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("user_id")).where("user_id is not null")
    return R.unfinished(latest_active(spark, d), done, ["user_id"]).select("user_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def uncached_ids(spark, d):
    return R.unfinished(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query(f"SELECT d.doc_id FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN '{VERSION}' WHEN toxic = 1 THEN 'v1' END AS version FROM labels) l USING (doc_id) WHERE l.version IS DISTINCT FROM '{VERSION}'")
def stale_or_missing(spark, d):
    done = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, VERSION).when(F.col("toxic") == 1, "v1").alias("version"))
    return R.stale_or_missing(table(spark, d, "documents").select("doc_id"), done, "doc_id", "version", VERSION)


@query("""
WITH styrk AS (SELECT l_orderkey AS uuid, min(p_brand) AS code, min(p_name) AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand LIKE 'Brand#1%' GROUP BY 1),
esco AS (SELECT l_orderkey AS uuid, min(CASE WHEN p_size % 2 = 0 THEN p_name END) AS title_no, min(CASE WHEN p_size % 2 = 1 THEN p_name END) AS title_en FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type LIKE '%O%' GROUP BY 1),
nav AS (SELECT l_orderkey AS uuid, max(l_shipmode_) AS category FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem) GROUP BY 1)
SELECT o_orderkey AS uuid, coalesce(title_no, name) AS title, title_en, CASE WHEN title_no IS NOT NULL THEN 'esco' WHEN name IS NOT NULL THEN 'styrk' END AS title_source,
    replace(code, 'Brand#', '') AS code, CASE WHEN regexp_matches(replace(code, 'Brand#', ''), '^\\d{2}$') THEN substr(replace(code, 'Brand#', ''), 1, 1) END AS family, category
FROM orders LEFT JOIN styrk ON o_orderkey = styrk.uuid LEFT JOIN esco ON o_orderkey = esco.uuid LEFT JOIN nav ON o_orderkey = nav.uuid
""".replace("\\\\d", "\\d"))
def taxonomy_build(spark, d):
    """Title by source priority, code, family: four left-joined aggregates of one line table."""
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    met = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("l_orderkey", "uuid")
    brand, kind = F.col("p_brand").like("Brand#1%"), F.col("p_type").like("%O%")
    # one pass over the join: each source's minima are conditional
    found = met.groupBy("uuid").agg(
        F.min(F.when(brand, F.col("p_brand"))).alias("code"),
        F.min(F.when(brand, F.col("p_name"))).alias("name"),
        F.min(F.when(kind & (F.col("p_size") % 2 == 0), F.col("p_name"))).alias("title_no"),
        F.min(F.when(kind & (F.col("p_size") % 2 == 1), F.col("p_name"))).alias("title_en"),
    )
    category = lines.groupBy(F.col("l_orderkey").alias("uuid")).agg(F.max(F.concat("l_returnflag", "l_linestatus")).alias("category"))
    code = F.replace("code", F.lit("Brand#"), F.lit(""))
    return (
        table(spark, d, "orders").select(F.col("o_orderkey").alias("uuid")).join(found, "uuid", "left").join(category, "uuid", "left")
        .select("uuid", F.coalesce("title_no", "name").alias("title"), "title_en", F.when(F.col("title_no").isNotNull(), "esco").when(F.col("name").isNotNull(), "styrk").alias("title_source"), code.alias("code"), F.when(code.rlike("^\\d{2}$"), F.substring(code, 1, 1)).alias("family"), "category")
    )


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS n_users, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS n_active, sum(CASE WHEN value > 10 THEN 1 ELSE 0 END)::BIGINT AS n_high, count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) AS n_failing FROM events")
def coverage_stats(spark, d):
    return table(spark, d, "events").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.sum(F.when(F.col("event_type") == ACTIVE, 1).otherwise(0)).alias("n_active"),
        F.sum(F.when(F.col("value") > 10, 1).otherwise(0)).alias("n_high"), F.count_distinct(F.when(F.col("event_type") == "error", F.col("user_id"))).alias("n_failing"),
    )


@query("SELECT source, lang, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY source) AS share FROM documents GROUP BY source, lang")
def value_histogram(spark, d):
    return R.value_shares(table(spark, d, "documents"), ["source"], "lang")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') AS missing, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) > 50 THEN 'high' ELSE 'low' END AS tier FROM events")
def json_project(spark, d):
    parsed = table(spark, d, "events").select("event_id", F.from_json("props", "k int, missing string").alias("p"))
    return parsed.select("event_id", F.col("p.k").alias("k"), F.col("p.missing").alias("missing"), F.when(F.col("p.k") > 50, "high").otherwise("low").alias("tier"))


@query("SELECT doc_id, nullif(CASE WHEN lang = 'de' THEN '' ELSE lang END, '') AS lang, nullif(trim(CASE WHEN n_chars < 500 THEN '  ' ELSE source END), '') AS source FROM documents")
def null_if_empty(spark, d):
    lang = F.when(F.col("lang") == "de", "").otherwise(F.col("lang"))
    source = F.trim(F.when(F.col("n_chars") < 500, "  ").otherwise(F.col("source")))
    return table(spark, d, "documents").select("doc_id", F.nullif(lang, F.lit("")).alias("lang"), F.nullif(source, F.lit("")).alias("source"))


@query("SELECT doc_id, sha256(coalesce(text, '') || coalesce(source, '')) AS content_sha256 FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text"), F.col("source")).alias("content_sha256"))


@query("SELECT event_id, sha256('model-1' || chr(0) || 'v2' || chr(0) || trim(regexp_replace(event_type || '  ' || props, '\\s+', ' ', 'g'))) AS key FROM events".replace("\\\\", "\\"))
def cache_key(spark, d):
    return table(spark, d, "events").select("event_id", X.cache_key("model-1", "v2", F.concat("event_type", F.lit("  "), "props")).alias("key"))


@query(_CANON + "SELECT doc_id, signature FROM c")
def dedup_signature(spark, d):
    return table(spark, d, "documents").select("doc_id", X.signature(F.col("text")).alias("signature"))


@query(_CANON + "SELECT signature, min(doc_id) AS rep, count(*) AS n FROM c GROUP BY signature")
def dedup_clusters(spark, d):
    return R.clusters(table(spark, d, "documents").select("doc_id", "text"), "doc_id", X.signature(F.col("text")))


@query(_CANON + "SELECT min(doc_id) AS rep FROM c GROUP BY signature HAVING count(*) > 1")
def dedup_representatives(spark, d):
    return dedup_clusters(spark, d).where("n > 1").select("rep")


@query(_CANON + ", r AS (SELECT signature, min(doc_id) AS rep FROM c GROUP BY signature) SELECT c.doc_id, r.rep, b.lang AS rep_lang FROM c JOIN r USING (signature) JOIN documents b ON b.doc_id = r.rep")
def dedup_fan_out(spark, d):
    docs = table(spark, d, "documents")
    results = docs.select(F.col("doc_id").alias("rep"), F.col("lang").alias("rep_lang"))
    return R.fan_out(docs.select("doc_id", "text"), "doc_id", X.signature(F.col("text")), results).select("doc_id", "rep", "rep_lang")


@query("""WITH l AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'error'), r AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'purchase' AND value > 20),
f AS (SELECT l.k AS a, r.k AS b FROM l FULL JOIN r ON l.k = r.k)
SELECT count(a) AS n_left, count(b) AS n_right, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_both, count(*) FILTER (b IS NULL) AS n_left_only, count(*) FILTER (a IS NULL) AS n_right_only,
count(*) FILTER (a IS NOT NULL AND b IS NOT NULL)::DOUBLE / nullif(count(*), 0) AS jaccard FROM f""")
def set_agreement(spark, d):
    e = table(spark, d, "events")
    return R.agreement(e.where("event_type = 'error'"), e.where("event_type = 'purchase' and value > 20"), "user_id")


@query("SELECT c_custkey, c_mktsegment, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0")
def star_join(spark, d):
    """JOIN1: facts with their small dimensions; statistics decide that those are broadcast."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.where("c_acctbal > 0").join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("c_custkey", "c_mktsegment", "n_name", "r_name")


@query("SELECT doc_id, coalesce(quality, -1) AS quality FROM documents JOIN labels USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 OR toxic = 1)")
def completed_join(spark, d):
    labels = table(spark, d, "labels")
    chosen = labels.where("quality = 1 or toxic = 1").select("doc_id")
    found = R.complete(chosen, labels.select("doc_id", "quality"), ["doc_id"])
    return found.join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("SELECT user_id, event_id, value, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 3")
def top_per_group(spark, d):
    return R.top_n(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], 3, F.desc("value"), F.asc("event_id")).select("user_id", "event_id", "value", "rank")


@query("SELECT p_name AS uri, max(CASE WHEN p_size % 2 = 0 THEN p_brand END) AS en, max(CASE WHEN p_size % 2 = 1 THEN p_brand END) AS no FROM part GROUP BY p_name")
def label_merge(spark, d):
    """JOIN19: both languages' labels of each key, either of which may be absent."""
    part = table(spark, d, "part").select(F.col("p_name").alias("uri"), F.when(F.col("p_size") % 2 == 0, "en").otherwise("no").alias("lang"), "p_brand")
    return part.groupBy("uri").pivot("lang", ["en", "no"]).agg(F.max("p_brand"))


@query("SELECT user_id, event_id, ts FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> value")
def changed_revisions(spark, d):
    """STR4: revisions whose content differs from the one before."""
    from pyspark.sql import Window

    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("user_id", "event_id", "ts", "value", before.alias("before")).where("before is null or before <> value").select("user_id", "event_id", "ts")
