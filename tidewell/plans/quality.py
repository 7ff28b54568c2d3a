"""Text and data-quality queries. Facets of documents are derived from their ids, for want of extracted ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import quality as Q
from tidewell.plans.registry import Registry
from tidewell.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.query
_CTRL = "CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'fluentish' ELSE ['certified', 'fluent', 'desirable', 'either_norwegian_or_english', 'unstated'][(doc_id % 5 + 1)::INT] END"
_FACETS = f"""f AS (SELECT doc_id, lang, (doc_id % 3)::INT AS n_spans, ['explicit_statement', 'no_mention', 'implicit'][(doc_id % 3 + 1)::INT] AS basis, ['none', 'explicit_but_hedged', 'explicit_and_unambiguous'][(doc_id % 4 % 3 + 1)::INT] AS strength,
{_CTRL} AS level, ['norwegian', 'english', 'both', 'unstated'][(doc_id % 4 + 1)::INT] AS working, CASE WHEN doc_id % 2 = 0 THEN 'senior' ELSE 'junior' END AS seniority, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id % 4)::INT END AS years FROM documents)"""


def docs(spark, d):
    return table(spark, d, "documents")


def facets(spark, d):
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), k.cast("int"))
    i = F.col("doc_id")
    level = F.when(i % 11 == 0, F.lit(None).cast("string")).when(i % 7 == 0, "fluentish").otherwise(pick(["certified", "fluent", "desirable", "either_norwegian_or_english", "unstated"], i % 5 + 1))
    return docs(spark, d).select(
        "doc_id", "lang", (i % 3).cast("int").alias("n_spans"), pick(["explicit_statement", "no_mention", "implicit"], i % 3 + 1).alias("basis"), pick(["none", "explicit_but_hedged", "explicit_and_unambiguous"], i % 4 % 3 + 1).alias("strength"),
        level.alias("level"), pick(["norwegian", "english", "both", "unstated"], i % 4 + 1).alias("working"), F.when(i % 2 == 0, "senior").otherwise("junior").alias("seniority"), F.when(i % 5 != 0, (i % 4).cast("int")).alias("years"),
    )


@query("WITH " + _FACETS + """, e AS (SELECT doc_id, unnest([CASE WHEN basis = 'explicit_statement' AND n_spans = 0 THEN 'explicit_statement_without_span' END, CASE WHEN basis = 'no_mention' AND n_spans > 0 THEN 'no_mention_with_span' END, CASE WHEN strength = 'none' AND n_spans > 0 THEN 'strength_none_with_span' END,
CASE WHEN strength <> 'none' AND n_spans = 0 THEN 'explicit_strength_without_span' END, CASE WHEN level = 'either_norwegian_or_english' AND basis <> 'explicit_statement' THEN 'disjunction_without_explicit_evidence' END, CASE WHEN level IS DISTINCT FROM 'unstated' AND basis = 'no_mention' THEN 'verdict_without_evidence' END, CASE WHEN seniority = 'senior' AND years = 0 THEN 'senior_with_zero_years' END]) AS reason FROM f)
SELECT doc_id, reason FROM e WHERE reason IS NOT NULL""")
def coherence_reasons(spark, d):
    c = F.col
    return facets(spark, d).select("doc_id", F.explode(Q.coherence(c("n_spans"), c("basis"), c("strength"), c("level"), c("seniority"), c("years"))).alias("reason"))


@query("WITH " + _FACETS + "SELECT doc_id, CASE WHEN level IS NULL THEN 'enum:level=None' ELSE 'enum:level=''' || level || '''' END AS error FROM f WHERE level IS NULL OR level = 'fluentish'")
def enum_errors(spark, d):
    checks = {"level": (F.col("level"), Q.LEVELS), "working": (F.col("working"), Q.WORKING)}
    return facets(spark, d).select("doc_id", F.explode(Q.enum_errors(checks)).alias("error"))


@query("""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l, (doc_id % 70 - 3)::INT AS years FROM documents), e AS (SELECT doc_id, CASE WHEN len(l) > 4 THEN 'shape:evidence_spans:maxItems_4_got_' || len(l) END AS error FROM s UNION ALL SELECT doc_id, CASE WHEN years < 0 OR years > 60 THEN 'shape:min_years_experience:range' END FROM s
UNION ALL SELECT doc_id, CASE WHEN length(x) > 300 THEN 'shape:evidence_spans[' || i || '].span:maxLength_300_got_' || length(x) END FROM (SELECT doc_id, unnest(l) AS x, unnest(range(0, len(l))) AS i FROM s)) SELECT doc_id, error FROM e WHERE error IS NOT NULL""")
def shape_errors(spark, d):
    return docs(spark, d).select("doc_id", F.explode(Q.shape_errors(F.split("text", "\n"), (F.col("doc_id") % 70 - 3).cast("int"))).alias("error"))


@query("WITH " + _FACETS + """SELECT doc_id, CASE WHEN n_spans = 0 AND level <> 'unstated' AND basis = 'explicit_statement' THEN 'unstated' ELSE level END AS level, CASE WHEN n_spans = 0 AND level <> 'unstated' AND basis = 'explicit_statement' THEN 'no_mention' ELSE basis END AS basis,
CASE WHEN n_spans = 0 AND level <> 'unstated' AND basis = 'explicit_statement' THEN 'none' ELSE strength END AS strength, coalesce(n_spans = 0 AND level <> 'unstated' AND basis = 'explicit_statement', false) AS demoted FROM f""")
def verdict_repair(spark, d):
    spans = F.array_repeat(F.lit("x"), F.col("n_spans"))
    return Q.repair(facets(spark, d).withColumn("kept_spans", spans)).select("doc_id", "level", "basis", "strength", "demoted")


@query("WITH " + _FACETS + """SELECT doc_id, CASE WHEN level IN ('either_norwegian_or_english', 'desirable') THEN true WHEN level IN ('certified', 'fluent') THEN false WHEN working IN ('english', 'both') THEN true WHEN working = 'norwegian' THEN false ELSE coalesce(lang = 'en', false) END AS accessible FROM f WHERE level IS NOT NULL""")
def derived_accessible(spark, d):
    return facets(spark, d).where("level is not null").select("doc_id", Q.accessible(F.col("level"), F.col("working"), F.col("lang")).alias("accessible"))


@query("WITH " + _FACETS + """SELECT lang, count(*) AS n, round(avg(CASE WHEN n_spans = 0 AND level <> 'unstated' AND basis = 'explicit_statement' THEN 1.0 ELSE 0.0 END), 6) AS demoted FROM f GROUP BY 1""")
def demotion_rates(spark, d):
    return verdict_repair(spark, d).join(docs(spark, d).select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.col("demoted").cast("double")), 6).alias("demoted"))


@query("""WITH b AS (SELECT source, CASE lang WHEN 'en' THEN 'en' WHEN 'de' THEN 'no' ELSE 'other' END AS cls, n_chars FROM documents), m AS (SELECT source, coalesce(sum(n_chars) FILTER (cls = 'no'), 0) AS no, coalesce(sum(n_chars) FILTER (cls = 'en'), 0) AS en, coalesce(sum(n_chars) FILTER (cls = 'other'), 0) AS oth, count(*) AS n_scored FROM b GROUP BY 1),
v AS (SELECT source, n_scored, CASE WHEN oth / (no + en + oth) > 0.5 THEN 'other' WHEN oth / (no + en + oth) >= 0.2 THEN 'mixed' WHEN en / (no + en) >= 0.8 THEN 'en' WHEN en / (no + en) <= 0.2 THEN 'no' ELSE 'mixed' END AS doc_lang FROM m) SELECT source, doc_lang, doc_lang = 'mixed' AS is_bilingual, n_scored FROM v""")
def language_mass(spark, d):
    cls = F.when(F.col("lang") == "en", "en").when(F.col("lang") == "de", "no").otherwise("other")
    return Q.language_mass(docs(spark, d).select("source", cls.alias("cls"), "n_chars"), "source")


@query("SELECT doc_id, CASE WHEN length(text) > 6000 THEN substr(text, 1, 3500) || chr(10) || '[...]' || chr(10) || right(text, 2500) ELSE text END AS sent_text, length(text) > 6000 AS truncated FROM documents")
def truncate_head_tail(spark, d):
    return docs(spark, d).select("doc_id", X.head_tail(F.col("text")).alias("sent_text"), (F.length("text") > 6000).alias("truncated"))


@query("WITH s AS (SELECT item_id, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS sentence FROM benchmark) SELECT item_id, sentence, count(*) AS n FROM s GROUP BY 1, 2".replace("\\\\", "\\"))
def sentence_split(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(X.sentences(F.col("text"))).alias("sentence")).groupBy("item_id", "sentence").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM documents), h AS (SELECT *, regexp_matches(line, '(?i)license|disgusting') AS hit FROM l),
n AS (SELECT *, lead(hit) OVER (PARTITION BY doc_id ORDER BY k) AS next_hit FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS rn FROM n WHERE hit OR next_hit) SELECT doc_id, k, line FROM r WHERE rn <= 14""")
def context_blocks(spark, d):
    """Lines with a signal and the line before each, fourteen at most; inside the row, so no window is needed."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("k"), x.alias("line"), x.rlike("(?i)license|disgusting").alias("hit")))
    held = docs(spark, d).select("doc_id", lines.alias("ls"))
    near = F.filter("ls", lambda x, i: x["hit"] | F.coalesce(F.get(F.col("ls"), i + 1)["hit"], F.lit(False)))
    return held.select("doc_id", near.alias("near"), F.size("ls").alias("n")).select("doc_id", F.explode(F.slice("near", 1, 14)).alias("x")).select("doc_id", "x.k", "x.line")


_A, _B = "(the|der|las)", "(and|und|que|et)"


@query(f"SELECT doc_id, regexp_matches(text, '(?is){_A}.{{0,30}} or .{{0,30}}{_B}') AS disjunction, regexp_matches(text, '(?i){_A} {_B}') AS adjacent, regexp_matches(text, '(?is)pathetic.{{0,90}}trash|trash.{{0,90}}pathetic') AS within FROM documents")
def connective_class(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", t.rlike(f"(?is){_A}.{{0,30}} or .{{0,30}}{_B}").alias("disjunction"), t.rlike(f"(?i){_A} {_B}").alias("adjacent"), t.rlike("(?is)pathetic.{0,90}trash|trash.{0,90}pathetic").alias("within"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '\\b[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+\\b')".replace("\\\\", "\\"))
def pii_mail_flag(spark, d):
    return docs(spark, d).where(F.col("text").rlike(X.EMAIL)).select("doc_id")


@query()
def pii_scrub(spark, d):
    """TXT20, every text; RE2 has no lookbehind, so this is tested against the contact-scoped function."""
    return docs(spark, d).select("doc_id", X.scrub_patterns(F.col("text")).alias("text"))


@query()
def normalise_text(spark, d):
    """TXT1 with NFKC, for which neither engine has an expression."""
    return X.nfkc(docs(spark, d).select("doc_id", "text"))


@query("SELECT doc_id, trim(regexp_replace(translate(text, '‘’“”' || chr(160) || chr(8201) || chr(8239) || '–—' || chr(173), '''''\"\"   --'), '[\\t\\f\\v\\r ]+', ' ', 'g'), E' \\t\\n\\r') AS text FROM documents".replace("\\\\", "\\"))
def keep_blocks(spark, d):
    return docs(spark, d).select("doc_id", X.keep_blocks(F.col("text")).alias("text"))


@query()
def html_blocks(spark, d):
    """TXT18: a parser of our own; tested on cases."""
    return X.html_blocks(table(spark, d, "pages").select("page_id", "html"))


@query()
def html_text(spark, d):
    return X.html_text(table(spark, d, "pages").select("page_id", "html"))


@query()
def span_check(spark, d):
    """DQ1: each document's first and middle sentences as evidence of themselves."""
    said = docs(spark, d).select("doc_id", "text", F.explode(F.array(F.substr("text", F.lit(1), F.lit(40)), F.substr("text", F.lit(20), F.lit(60)))).alias("span"))
    return said.select("doc_id", "span", Q.span_check("span", "text").alias("v")).select("doc_id", "span", "v.ok", "v.reason")


@query()
def byte_batches(spark, d):
    """SNK8: greedy batches of 100 kB in order, inside shards of a thousand ids."""
    rows = docs(spark, d).select(F.floor(F.col("doc_id") / 1000).alias("shard"), "doc_id", F.octet_length("text").alias("size"))
    return Q.batch_by_bytes(rows, "shard", "doc_id", "size", 100_000)


@query("SELECT want, got, n FROM (SELECT 'fluent' AS want, CASE WHEN n_chars % 3 = 0 THEN 'fluent' WHEN n_chars % 3 = 1 THEN 'desirable' END AS got, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)")
def golden_score(spark, d):
    got = F.when(F.col("n_chars") % 3 == 0, "fluent").when(F.col("n_chars") % 3 == 1, "desirable")
    golden = table(spark, d, "labels").select("doc_id", F.lit("fluent").alias("want"))
    return docs(spark, d).select("doc_id", got.alias("got")).join(golden, "doc_id").groupBy("want", "got").agg(F.count("*").alias("n"))
