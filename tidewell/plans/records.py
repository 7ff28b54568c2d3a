"""Queries over records of models, reviewers and seekers. Their fields are derived from ids and texts, for want of real ones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import facets as C
from tidewell.operators import quality as Q
from tidewell.operators import records as K
from tidewell.operators.relational import value_shares
from tidewell.plans.registry import Registry
from tidewell.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.query


def docs(spark, d):
    return table(spark, d, "documents")


def picked(df, **columns: str):
    """df with columns given as SQL that both engines read alike."""
    return df.withColumns({k: F.expr(v) for k, v in columns.items()})


def case(by: str, n: int, *values: str) -> str:
    return f"CASE {by} % {n} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


_PHRASE = case("doc_id", 5, "substr(text, 3, 12)", "'not in the text at all'", "'   '", "substr(text, 1, 5)", "substr(text, 8, 30)")
_GLOSS = "CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'gloss' END"
_LEVEL = "CASE WHEN doc_id % 11 = 0 THEN 'expert' WHEN doc_id % 2 = 0 THEN 'required' ELSE 'preferred' END"
#: keep_blocks() and squeeze() as DuckDB writes them
_CHARS = "translate({}, '‘’“”' || chr(160) || chr(8201) || chr(8239) || '–—' || chr(173), '''''\"\"   --')"
_KEEP = "trim(regexp_replace(" + _CHARS.format("coalesce(text, '')") + ", '[\\t\\f\\v\\r ]+', ' ', 'g'), E' \\t\\n\\r')"
_SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'), ' ')"


@query(f"""WITH s AS (SELECT doc_id, text, {_PHRASE} AS phrase, {_GLOSS} AS gloss, {_LEVEL} AS level FROM documents)
SELECT doc_id, phrase, CASE WHEN level = 'expert' THEN 'level' WHEN gloss = '' THEN 'empty_gloss' WHEN trim(phrase, E' \\t\\n\\r') = '' THEN 'empty_phrase' WHEN NOT contains({_KEEP}, {_SQUEEZE.format(_CHARS.format('phrase'))}) THEN 'phrase_not_found' END AS reason FROM s""")
def skill_validation(spark, d):
    """DQ7"""
    s = picked(docs(spark, d), phrase=_PHRASE, gloss=_GLOSS, level=_LEVEL)
    return s.select("doc_id", "phrase", K.skill_reason(F.col("phrase"), F.col("gloss"), F.col("level"), F.col("text")).alias("reason"))


@query(f"""WITH s AS (SELECT doc_id, lang, CASE WHEN {_LEVEL} = 'expert' OR {_GLOSS} = '' OR trim({_PHRASE}, E' \\t\\n\\r') = '' THEN 1 ELSE 0 END AS bad FROM documents)
SELECT lang, count(*) AS n, round(avg(bad), 6) AS rejected, round(avg(CASE WHEN doc_id % 6 = 0 THEN 1.0 ELSE 0.0 END), 6) AS without_any FROM s GROUP BY 1""")
def skill_rates(spark, d):
    """DQ18: the share of refused skills, and of items with none."""
    s = picked(docs(spark, d), phrase=_PHRASE, gloss=_GLOSS, level=_LEVEL)
    bad = ~F.col("level").isin(K.SKILL_LEVELS) | K.blank(F.col("gloss")) | K.blank(F.col("phrase"))
    return s.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(bad.cast("int")), 6).alias("rejected"), F.round(F.avg((F.col("doc_id") % 6 == 0).cast("int")), 6).alias("without_any"))


_J = f"""SELECT l.doc_id, text, quality * 4 + l.doc_id % 4 - 1 AS grade, toxic = 1 AS violates, {case('l.doc_id', 6, "'language'", "'authorisation'", "'salary'", 'NULL', "'language'", "'other'")} AS facet,
{case('l.doc_id', 4, "substr(text, 5, 40)", "'authorisation as a nurse'", "''", "'>>  ' || upper(substr(text, 1, 20))")} AS evidence FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""
_EV = "lower(array_to_string(list_filter(list_transform(string_split(translate(translate(coalesce({0}, ''), chr(160), ' '), chr(8203) || chr(8288) || chr(65279) || chr(173), ''), chr(10)), lambda x: " + _SQUEEZE.format("CASE WHEN regexp_matches(" + _SQUEEZE.format("x") + ", '[\\p{{L}}\\p{{N}}]') THEN regexp_replace(" + _SQUEEZE.format("x") + ", '^[^\\p{{L}}\\p{{N}}]+', '') ELSE " + _SQUEEZE.format("x") + " END") + "), lambda x: x <> ''), ' '))"


def judged(spark, d):
    met = table(spark, d, "labels").withColumnRenamed("doc_id", "id").join(docs(spark, d), F.col("id") == F.col("doc_id"))
    met = picked(met, grade="quality * 4 + doc_id % 4 - 1", violates="toxic = 1", facet=case("doc_id", 6, "'language'", "'authorisation'", "'salary'", "NULL", "'language'", "'other'"), evidence=case("doc_id", 4, "substr(text, 5, 40)", "'authorisation as a nurse'", "''"))
    shouted = F.concat(F.lit(">>  "), X.upper_letters(F.substring("text", 1, 20)))
    return met.withColumn("evidence", F.when(F.col("doc_id") % 4 == 3, shouted).otherwise(F.col("evidence")))


@query(f"""WITH j AS ({_J}) SELECT doc_id, CASE WHEN grade < 0 OR grade > 3 THEN 'grade' WHEN facet = 'salary' THEN 'facet' WHEN violates AND evidence = '' THEN 'no_evidence'
WHEN violates AND NOT contains({_EV.format('text')}, {_EV.format('evidence')}) THEN 'evidence_not_found' WHEN violates AND facet = 'language' AND regexp_matches(evidence, '(?i)autoris|authoris|authoriz') THEN 'authorisation_as_language' END AS reason FROM j""")
def judgment_validation(spark, d):
    """DQ8, X6"""
    j = judged(spark, d)
    return j.select("doc_id", K.judgment_reason(F.col("grade"), F.col("violates"), F.col("facet"), F.col("evidence"), F.col("text")).alias("reason"))


@query(f"SELECT doc_id, {_EV.format('text')} AS key FROM documents")
def evidence_keys(spark, d):
    """TXT23"""
    return docs(spark, d).select("doc_id", X.evidence_key(F.col("text")).alias("key"))


@query("SELECT item_id, doc_id, 'p' || item_id || '-' || doc_id AS pair_id FROM benchmark JOIN labels ON doc_id % 40 = item_id % 40")
def pair_ids(spark, d):
    """X5"""
    b = table(spark, d, "benchmark").withColumn("k", F.col("item_id") % 40)
    met = b.join(table(spark, d, "labels").withColumn("k", F.col("doc_id") % 40), "k")
    return met.select("item_id", "doc_id", K.pair_id(F.concat(F.lit("p"), F.col("item_id").cast("string")), F.col("doc_id")).alias("pair_id"))


_FACET = case("item_id", 6, "'occupation'", "'language.norwegian'", "'work.remot'", "'skill'", "'language.english'", "'work.remote'")
_PRIO = "CASE WHEN item_id % 13 = 0 THEN 'maybe' WHEN item_id % 3 = 0 THEN 'hard' ELSE 'soft' END"
_SAID = case("item_id", 5, "substr(text, 4, 20)", "substr(text, 1, 9)", "'never said'", "' '", "substr(text, 11, 7)")
_SPOKEN = case("item_id", 4, "'basic'", "'none'", "'perfect'", "'fluent'")
_PARSE = f"SELECT item_id, text, {_FACET} AS facet, {_PRIO} AS priority, {_SAID} AS evidence, {_SPOKEN} AS value, item_id % 17 <> 0 AS known, CASE WHEN item_id % 19 = 0 THEN 2 ELSE 1 END AS nth FROM benchmark"


def parses(spark, d):
    return picked(table(spark, d, "benchmark"), facet=_FACET, priority=_PRIO, evidence=_SAID, value=_SPOKEN, known="item_id % 17 <> 0", nth="CASE WHEN item_id % 19 = 0 THEN 2 ELSE 1 END")


@query(f"""WITH p AS ({_PARSE}) SELECT item_id, CASE WHEN NOT known THEN 'unknown_persona' WHEN nth > 1 THEN 'duplicate_parse' WHEN facet = 'work.remot' THEN 'unknown_facet' WHEN priority = 'maybe' THEN 'priority' WHEN trim(evidence, E' \\t\\n\\r') = '' THEN 'no_evidence'
WHEN NOT contains({_SQUEEZE.format('text')}, {_SQUEEZE.format('evidence')}) THEN 'evidence_not_in_query' WHEN facet LIKE 'language.%' AND value = 'perfect' THEN 'level' END AS reason FROM p""")
def parse_validation(spark, d):
    """DQ9"""
    c = F.col
    return parses(spark, d).select("item_id", K.parse_reason(c("known"), c("nth"), c("facet"), c("priority"), c("evidence"), c("text"), c("value")).alias("reason"))


_POP = "SELECT 'occupation' AS facet, avg(CASE WHEN lang IS NOT NULL AND lang NOT IN ('', 'unstated', 'de') THEN 1.0 ELSE 0.0 END) AS share FROM documents UNION ALL SELECT 'skill', avg(CASE WHEN n_chars > 800 THEN 1.0 ELSE 0.0 END) FROM documents UNION ALL SELECT 'language.norwegian', 1.0"


@query(f"""WITH p AS ({_PARSE}), o AS ({_POP}), m AS (SELECT CASE WHEN item_id % 3 = 0 THEN 'sealed' ELSE 'dev' END AS split, priority = 'hard' AS hard, share FROM p LEFT JOIN o USING (facet))
SELECT split, count(*) AS n, round(avg(CASE WHEN share IS NULL THEN 0.0 ELSE 1.0 END), 6) AS schema, round(avg(coalesce(share, 0)), 6) AS weighted, count(*) FILTER (hard) AS n_hard, round(avg(CASE WHEN share IS NULL THEN 0.0 ELSE 1.0 END) FILTER (hard), 6) AS schema_hard, round(avg(coalesce(share, 0)) FILTER (hard), 6) AS weighted_hard FROM m GROUP BY 1""")
def oracle_coverage(spark, d):
    """AGG22: what of the stated constraints a catalogue with such fields could answer."""
    own = docs(spark, d)
    rate = lambda c: F.avg(c.cast("int"))
    pop = own.agg(rate(F.coalesce(K.usable(F.col("lang")) & (F.col("lang") != "de"), F.lit(False))).alias("occupation"), rate(F.col("n_chars") > 800).alias("skill"), F.lit(1.0).alias("language.norwegian"))
    pop = pop.unpivot([], ["occupation", "skill", "`language.norwegian`"], "facet", "share")
    out = K.coverage(parses(spark, d).withColumn("split", F.expr("CASE WHEN item_id % 3 = 0 THEN 'sealed' ELSE 'dev' END")), pop)
    return out.select("split", "n", "n_hard", *[F.round(c, 6).alias(c) for c in ("schema", "weighted", "schema_hard", "weighted_hard")])


_RAW = case("doc_id", 5, "lang", "''", "'unstated'", "NULL", "'Ikke oppgitt'")


@query(f"SELECT doc_id, coalesce({_RAW} NOT IN ('', 'unstated', 'null', 'Ikke oppgitt'), false) AS usable FROM documents")
def usable_values(spark, d):
    """FLT7"""
    return picked(docs(spark, d), v=_RAW).select("doc_id", F.coalesce(K.usable(F.col("v")), F.lit(False)).alias("usable"))


_WANT = case("doc_id", 4, "'norsk autorisasjon som sykepleier'", "NULL", "'autorisasjon'", "'autorisasjon som lege'")
_GOT = case("doc_id", 7, "'Norsk autorisasjon som lege'", "NULL", "'autorisasjon som sykepleier'", "'authorisation'", "''", "'norsk autorisasjon'", "'Autorisasjon som lege eller sykepleier'")


@query(f"""WITH s AS (SELECT doc_id, {_WANT} AS w, {_GOT} AS g FROM documents), p AS (SELECT *, list_sort(list_distinct(regexp_extract_all(lower(w), '{K.PROFESSIONS}'))) AS e, list_sort(list_distinct(regexp_extract_all(lower(g), '{K.PROFESSIONS}'))) AS f FROM s)
SELECT doc_id, CASE WHEN w IS NULL THEN g IS NULL OR g = '' WHEN g IS NULL OR g = '' THEN false ELSE contains(lower(g), 'autorisasjon') AND (len(e) = 0 OR len(f) = 0 OR e = f) END AS matches FROM p""")
def authorisation_match(spark, d):
    """DQ12: named professions must not contradict."""
    s = picked(docs(spark, d), w=_WANT, g=_GOT)
    return s.select("doc_id", K.authorisation_matches(F.col("w"), F.col("g")).alias("matches"))


_CLAIM = case("doc_id", 3, "substr(text, 2, 15)", "'norsk autorisasjon'", "substr(text, 6, 9)")


@query(f"SELECT doc_id, contains(lower({_SQUEEZE.format(_CHARS.format('text'))}), lower({_SQUEEZE.format(_CHARS.format(_CLAIM))})) AS grounded FROM documents")
def authorisation_grounded(spark, d):
    """X4"""
    s = picked(docs(spark, d), v=_CLAIM)
    return s.select("doc_id", K.grounded(F.col("v"), F.col("text")).alias("grounded"))


_GOTSPAN = case("item_id", 5, "text", "text || '.'", "substr(text, 3, 30)", "'something else entirely'", "' ' || replace(text, ' ', '  ')")


@query(f"""WITH s AS (SELECT item_id, {_SQUEEZE.format(_CHARS.format('text'))} AS w, {_SQUEEZE.format(_CHARS.format(_GOTSPAN))} AS g FROM benchmark) SELECT item_id, CASE WHEN w = g THEN 'strict' WHEN regexp_replace(w, '[.,;:!?]+$', '') = regexp_replace(g, '[.,;:!?]+$', '') THEN 'trailing_punct_only' WHEN contains(w, g) OR contains(g, w) THEN 'containment' ELSE 'disjoint' END AS agreement FROM s""")
def span_agreement(spark, d):
    """DQ11: how a quoted span agrees with the wanted one."""
    s = picked(table(spark, d, "benchmark"), got=_GOTSPAN)
    return s.select("item_id", K.span_agreement(F.col("text"), F.col("got")).alias("agreement"))


_LEVEL_GOT = case("doc_id", 5, "'fluent'", "'desirable'", "'unstated'", "'fluent'", "'certified'")
_LEVEL_WANT = case("doc_id", 3, "'fluent'", "'desirable'", "'certified'")


@query(f"""WITH s AS (SELECT {_LEVEL_WANT} AS want, {_LEVEL_GOT} AS got FROM documents JOIN labels USING (doc_id)), a AS (SELECT want, got, want = 'desirable' AS open_want, got IN ('desirable', 'unstated') AS open_got FROM s)
SELECT want, got, count(*) AS n, count(*) FILTER (open_want AND NOT open_got) AS hidden_wrongly, count(*) FILTER (NOT open_want AND open_got) AS shown_wrongly FROM a GROUP BY 1, 2""")
def golden_flips(spark, d):
    """DQ11: flips of accessibility by direction; a document in English counts as open where nothing is stated."""
    s = picked(docs(spark, d).join(table(spark, d, "labels"), "doc_id"), want=_LEVEL_WANT, got=_LEVEL_GOT)
    opened = lambda c: Q.accessible(F.col(c), F.lit("unstated"), F.lit("en"))
    s = s.select("want", "got", opened("want").alias("w"), opened("got").alias("g"))
    return s.groupBy("want", "got").agg(F.count("*").alias("n"), F.count(F.when(F.col("w") & ~F.col("g"), 1)).alias("hidden_wrongly"), F.count(F.when(~F.col("w") & F.col("g"), 1)).alias("shown_wrongly"))


@query("""SELECT 'r' || event_id AS custom_id, CASE event_id % 6 WHEN 0 THEN 'expired' WHEN 1 THEN 'canceled' WHEN 2 THEN 'errored' WHEN 3 THEN 'errored' WHEN 4 THEN 'errored' ELSE 'succeeded' END AS type,
CASE event_id % 6 WHEN 2 THEN 'overloaded' WHEN 3 THEN 'stop_reason=max_tokens' WHEN 4 THEN 'no record_facets block' END AS error, CASE WHEN event_id % 6 = 5 THEN '{"level":"fluent","n":' || user_id || '}' END AS input FROM events""")
def batch_results(spark, d):
    """DQ14, SRC15: result lines as JSON text, parsed by tool name."""
    e = table(spark, d, "events")
    name = F.when(F.col("event_id") % 6 == 4, "other_tool").otherwise("record_facets")
    call = F.struct(F.lit("tool_use").alias("type"), name.alias("name"), F.struct(F.lit("fluent").alias("level"), F.col("user_id").alias("n")).alias("input"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("expired", "canceled", "errored", "succeeded", "succeeded", "succeeded")]), (F.col("event_id") % 6 + 1).cast("int"))
    stop = F.when(F.col("event_id") % 6 == 3, "max_tokens").otherwise("tool_use")
    message = F.when(kind == "succeeded", F.struct(stop.alias("stop_reason"), F.array(call).alias("content")))
    raw = e.select(F.to_json(F.struct(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("custom_id"), F.struct(kind.alias("type"), F.when(F.col("event_id") % 6 == 2, "overloaded").alias("error"), message.alias("message")).alias("result"))).alias("value"))
    return K.parse_results(raw, "record_facets")


_CACHED = case("doc_id", 4, "NULL", "'{\"level\":\"fluent\"}'", "'{\"level\":\"fluentish\"}'", "'not json'")


@query(f"""WITH c AS (SELECT doc_id, {_CACHED} AS raw FROM documents), r AS (SELECT doc_id, CASE WHEN raw LIKE '{{%' THEN json_extract_string(raw, '$.level') END AS level FROM c)
SELECT doc_id, CASE WHEN level IN ('fluent') THEN level ELSE 'unstated' END AS level, CASE WHEN level = 'fluentish' THEN 'enum:level=''fluentish''' END AS reason FROM r WHERE level IS NOT NULL""")
def revalidated_cache(spark, d):
    """DQ16, X9: stored raw answers judged by today's rules without a call; rows without a raw answer, or a corrupt one, stay as they are."""
    c = picked(docs(spark, d), raw=_CACHED).select("doc_id", F.from_json("raw", "level string")["level"].alias("level")).where("level is not null")
    reason = F.get(Q.enum_errors({"level": (F.col("level"), Q.LEVELS)}), 0)
    return c.select("doc_id", F.when(reason.isNull(), F.col("level")).otherwise("unstated").alias("level"), reason.alias("reason"))


@query("""WITH s AS (SELECT doc_id, quality, toxic, CASE WHEN doc_id % 3 = 0 THEN 'fluent' ELSE 'desirable' END AS judged, CASE WHEN doc_id % 4 = 0 THEN 'fluent' ELSE 'desirable' END AS now, CASE WHEN doc_id % 5 = 0 THEN 'Unstated, I think' ELSE '' END AS note FROM labels),
f AS (SELECT doc_id, unnest([CASE WHEN judged <> now THEN 'value_changed' END, CASE WHEN doc_id % 10 = 7 THEN 'tool_was_wrong' END, CASE WHEN contains(lower(note), 'unstated') AND quality = 1 THEN 'note_disagrees' END]) AS flag FROM s) SELECT doc_id, flag FROM f WHERE flag IS NOT NULL""")
def carried_verdicts(spark, d):
    """DQ17"""
    s = picked(table(spark, d, "labels"), judged="CASE WHEN doc_id % 3 = 0 THEN 'fluent' ELSE 'desirable' END", now="CASE WHEN doc_id % 4 = 0 THEN 'fluent' ELSE 'desirable' END", note="CASE WHEN doc_id % 5 = 0 THEN 'Unstated, I think' ELSE '' END", ok="CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END")
    return s.select("doc_id", F.explode(K.carried_flags(F.col("judged"), F.col("now"), F.col("doc_id") % 10 == 7, F.col("note"), F.col("ok"))).alias("flag"))


@query("""SELECT doc_id, 'req-' || least_doc AS request, old, new, old IS DISTINCT FROM new AS changed FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS least_doc, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS old, lang AS new FROM documents)""")
def re_extraction(spark, d):
    """X17, X8: one request for each different text, its answer joined back to every row."""
    own = docs(spark, d).select("doc_id", F.sha2("text", 256).alias("key"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("old"), F.col("lang").alias("new"))
    requests = own.groupBy("key").agg(F.concat(F.lit("req-"), F.min("doc_id").cast("string")).alias("request"))
    return own.join(requests, "key").select("doc_id", "request", "old", "new", (~F.col("old").eqNullSafe(F.col("new"))).alias("changed"))


@query("""SELECT d.doc_id FROM documents d ANTI JOIN (SELECT DISTINCT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, sha256(text || 'x') FROM documents WHERE doc_id % 3 = 1) c ON d.doc_id = c.doc_id AND sha256(d.text) = c.h""")
def changed_content(spark, d):
    """STR4: only what has a new content hash goes on; unchanged items are skipped."""
    own = docs(spark, d).select("doc_id", F.sha2("text", 256).alias("h"), F.sha2(F.concat("text", F.lit("x")), 256).alias("other"))
    done = own.where("doc_id % 3 < 2").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("h")).otherwise(F.col("other")).alias("h"))
    return own.select("doc_id", "h").join(done, ["doc_id", "h"], "left_anti").select("doc_id")


@query("WITH a AS (SELECT vec_id AS k FROM embeddings WHERE vec_id % 7 <> 0), b AS (SELECT doc_id AS k FROM documents WHERE doc_id % 11 <> 0) SELECT k, 'cache' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'corpus' FROM b WHERE k NOT IN (SELECT k FROM a)")
def cache_keys(spark, d):
    """SRC14: a stored vector table is valid only if its keys are the corpus's; here each lacks some."""
    cache = table(spark, d, "embeddings").where("vec_id % 7 <> 0").select(F.col("vec_id").alias("k"))
    return K.key_sets_differ(cache, docs(spark, d).where("doc_id % 11 <> 0").select(F.col("doc_id").alias("k")), "k")


@query()
def facet_scrub(spark, d):
    """TXT22: phrases lose contact details, spans don't."""
    skills = F.array(F.struct(F.col("text").alias("phrase"), F.lit("required").alias("level")))
    phrases, authorisation = K.scrub_facets(F.col("skills"), F.col("source"))
    own = docs(spark, d).select("doc_id", skills.alias("skills"), "source", F.col("text").alias("span"))
    return own.select("doc_id", F.get(phrases, 0)["phrase"].alias("phrase"), authorisation.alias("authorisation"), "span")


@query("SELECT doc_id, 'TITLE: ' || coalesce(source, '') || chr(10) || chr(10) || CASE WHEN length(text) > 10000 THEN substr(text, 1, 10000) || chr(10) || '[advertisement truncated here]' ELSE coalesce(text, '') END AS prompt FROM documents")
def prompt_render(spark, d):
    """TXT32"""
    return docs(spark, d).select("doc_id", K.prompt_text(F.col("source"), F.col("text")).alias("prompt"))


@query("""WITH b AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT source, lang, length(line) AS n FROM b WHERE length(line) >= 25 AND NOT regexp_matches(line, '(?i)personal data|privacy polic|\\bGDPR\\b|equal opportunit|regardless of (race|gender|age)|applicants? (of all|from all)|powered by|cookie polic|terms of service')),
g AS (SELECT source, lang, sum(n) AS n FROM k GROUP BY 1, 2), o AS (SELECT source, arg_max(lang, (n, lang)) AS other FROM g WHERE lang NOT IN ('en', 'de') GROUP BY 1), m AS (SELECT source, sum(n) AS total, coalesce(sum(n) FILTER (lang = 'de'), 0) AS no, coalesce(sum(n) FILTER (lang = 'en'), 0) AS en FROM g GROUP BY 1)
SELECT source, total::BIGINT AS total, round(no / total, 6) AS share_no, round(en / total, 6) AS share_en, other FROM m LEFT JOIN o USING (source)""".replace("\\\\b", "\\b"))
def language_shares(spark, d):
    """AGG11, TXT25: characters by language without furniture and short blocks, and the commonest other language."""
    line = docs(spark, d).select("source", "lang", F.explode(F.split("text", "\n")).alias("line")).where((F.length("line") >= 25) & ~X.boilerplate(F.col("line")))
    g = line.groupBy("source", "lang").agg(F.sum(F.length("line")).alias("n"))
    share = lambda l: F.round(F.coalesce(F.sum(F.when(F.col("lang") == l, F.col("n"))), F.lit(0)) / F.sum("n"), 6)
    other = ~F.col("lang").isin("en", "de")
    return g.groupBy("source").agg(F.sum("n").alias("total"), share("de").alias("share_no"), share("en").alias("share_en"), F.max_by("lang", F.when(other, F.struct("n", "lang"))).alias("other"))


_TELL = {"en": ["the", "and", "of", "is"], "fr": ["le", "la", "des", "est"], "de": ["der", "und", "die", "ist"], "es": ["el", "los", "que", "del"]}
_COUNT = ", ".join(f"len(list_filter(ws, lambda w: w IN ({', '.join(repr(w) for w in ws)}))) AS n_{l}" for l, ws in _TELL.items())


@query(f"""WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM documents), w AS (SELECT doc_id, k, line, regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+') AS ws FROM b WHERE length(line) >= 25), c AS (SELECT doc_id, k, length(line) AS n_chars, {_COUNT} FROM w)
SELECT doc_id, k, n_chars, CASE WHEN greatest(n_en, n_fr, n_de, n_es) = 0 THEN NULL WHEN n_en >= greatest(n_fr, n_de, n_es) THEN 'en' WHEN n_fr >= greatest(n_de, n_es) THEN 'fr' WHEN n_de >= n_es THEN 'de' ELSE 'es' END AS lang FROM c""")
def block_language(spark, d):
    """DQ21, DQ22: a block's language by the function words it has most of; the detector of the blueprint isn't installed."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("k"), x.alias("line")))
    b = docs(spark, d).select("doc_id", F.explode(lines).alias("b")).select("doc_id", F.col("b.k").cast("long").alias("k"), "b.line").where(F.length("line") >= 25)
    b = b.withColumn("ws", X.words(F.col("line")))
    for l, ws in _TELL.items():
        b = b.withColumn(f"n_{l}", F.size("ws") - F.size(X.without(F.col("ws"), ws)))
    top = F.greatest(*[f"n_{l}" for l in _TELL])
    lang = F.when(top > 0, F.coalesce(*[F.when(F.col(f"n_{l}") == top, l) for l in _TELL]))
    return b.select("doc_id", "k", F.length("line").cast("long").alias("n_chars"), lang.alias("lang"))


_PH, _GL = "list_transform(range(0, (item_id % 4 + 1)::BIGINT), lambda i: 'p' || i)", "list_transform(range(0, (item_id % 3 + 1)::BIGINT), lambda i: 'g' || i)"


@query(f"WITH g AS (SELECT item_id, {_PH} AS p, {_GL} AS g FROM benchmark) SELECT item_id, len(p) = len(g) AS complete, least(16000, 1200 + 120 * len(p)) AS budget, CASE WHEN len(p) = len(g) THEN array_to_string(list_transform(list_zip(p, g), lambda x: x[1] || '=' || x[2]), ';') END AS glossed FROM g")
def gloss_groups(spark, d):
    """DQ25, X19: glosses belong to phrases by position; lists of unequal length are asked for again."""
    make = lambda mark, n: F.transform(F.sequence(F.lit(0), (F.col("item_id") % n).cast("int")), lambda i: F.concat(F.lit(mark), i.cast("string")))
    g = table(spark, d, "benchmark").select("item_id", make("p", 4).alias("p"), make("g", 3).alias("g"))
    same = F.size("p") == F.size("g")
    glossed = F.array_join(F.zip_with("p", "g", lambda a, b: F.concat(a, F.lit("="), b)), ";")
    return g.select("item_id", same.alias("complete"), F.least(F.lit(16000), 1200 + 120 * F.size("p")).cast("long").alias("budget"), F.when(same, glossed).alias("glossed"))


_TIERS = {"required": "(must|shall)", "preferred": "(with|also)", "not_required": "(no|not|without)"}
_ALONE = "(?i)(^|[^\\p{{L}}]){}([^\\p{{L}}]|$)"


@query("WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM documents), t AS (".replace("\\\\", "\\") + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS tier FROM s WHERE regexp_matches(s, '{_ALONE.format(v)}') AND NOT regexp_matches(s, '{_ALONE.format('(is|it)')}')" for k, v in _TIERS.items()) + ") SELECT doc_id, tier, count(*) AS n FROM t GROUP BY 1, 2")
def lexicon_tiers(spark, d):
    """TXT30: sentences by the tier of a pattern table, without those that an exclusion matches. Stand-in words."""
    s = docs(spark, d).select("doc_id", F.explode(X.sentences(F.col("text"))).alias("s")).where(~F.col("s").rlike(_ALONE.format("(is|it)")))
    tiers = F.array_compact(F.array(*[F.when(F.col("s").rlike(_ALONE.format(v)), k) for k, v in _TIERS.items()]))
    return s.select("doc_id", F.explode(tiers).alias("tier")).groupBy("doc_id", "tier").agg(F.count("*").alias("n"))


_SAYS = case("doc_id", 6, "'Søknaden må skrives på engelsk'", "'Norsk autorisasjon: søknaden skal være på norsk'", "'CV must be in English'", "'Politiattest kreves'", "'norsk eller svensk muntlig'", "'norsk autorisasjon som lege, MRSA-test'")
_CLAUSE = "(?i)(?:s[øo]knad[\\p{L}]*|application|dokument[\\p{L}]*|vedlegg|CV)[^.]{0,60}\\b(?:m[åa]|skal|must|be|være|skrives)\\b[^.]{0,60}?(?:\\bp[åa]\\s+|\\bin (?:a )?)(?:norsk|engelsk|english|skandinavisk|scandinavian|norwegian|nordisk)"
_TRAP = "(?i)autorisasjon|HPR|norskpr[øo]ve|Bergenstesten|godkjenning"
_VET = "(?i)politiattest|vandelsattest|plettfri vandel|god vandel|bakgrunnssjekk|sikkerhetsklarer|skjermingsverdig|security clearance"
_LICENCE, _HEALTH = "(?i)autorisasjon som|norsk autorisasjon|HPR-nummer", "(?i)\\bMRSA\\b|tuberkulose"
_NORDIC = "(?i)\\bnorsk[\\p{L}]*\\b[^.]{0,40}\\beller\\b[^.]{0,40}(skandinavisk|nordisk|svensk|dansk)"


@query(f"""WITH s AS (SELECT doc_id, {_SAYS} AS s FROM documents) SELECT doc_id, regexp_matches(s, '{_CLAUSE}') AND NOT regexp_matches(s, '{_TRAP}') AS paperwork, CASE WHEN regexp_matches(s, '{_CLAUSE}') AND NOT regexp_matches(s, '{_TRAP}') THEN CASE WHEN regexp_matches(s, '(?i)engelsk|english') THEN 'english_accepted' ELSE 'norwegian_required' END END AS expected,
regexp_matches(s, '{_VET}') AS vetting, regexp_matches(s, '{_LICENCE}') AS licence, regexp_matches(s, '{_HEALTH}') AS health, regexp_matches(s, '{_NORDIC}') AND NOT regexp_matches(s, '(?i)engelsk|english') AS nordic_only FROM s""")
def clause_classes(spark, d):
    """FLT10, FLT11, FLT12: paperwork language without the licence traps, vetting against licence and health, Nordic-only disjunctions."""
    s = picked(docs(spark, d), s=_SAYS)
    c = F.col("s")
    english = c.rlike("(?i)engelsk|english")
    paper = c.rlike(_CLAUSE) & ~c.rlike(_TRAP)
    expected = F.when(paper, F.when(english, "english_accepted").otherwise("norwegian_required"))
    return s.select("doc_id", paper.alias("paperwork"), expected.alias("expected"), c.rlike(_VET).alias("vetting"), c.rlike(_LICENCE).alias("licence"), c.rlike(_HEALTH).alias("health"), (c.rlike(_NORDIC) & ~english).alias("nordic_only"))


@query("WITH v AS (SELECT source, quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2), s AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY source) AS share FROM v) SELECT doc_id, source, quality FROM labels JOIN documents USING (doc_id) JOIN s USING (source, quality) WHERE share < 0.2")
def rare_values(spark, d):
    """FLT13: rows with a value that is rare in a nearly constant field."""
    met = table(spark, d, "labels").join(docs(spark, d), "doc_id")
    few = value_shares(met, ["source"], "quality").where("share < 0.2").select("source", "quality")
    return met.join(few, ["source", "quality"]).select("doc_id", "source", "quality")


_JSON = """'{"ad_content":{"ad_content":{"title":"' || source || '","occupationCategories":[{"level1":"' || lang || '","level2":"x"},{"level1":"no","level2":"y"}]}}}'"""
_FLAT = """'{"ad_content":{"title":"' || source || '","occupationCategories":[]}}'"""


@query("SELECT doc_id, source AS title, CASE WHEN doc_id % 2 = 0 THEN lang END AS level1 FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def unwrapped_payload(spark, d):
    """JSN2, JSN3: an envelope that is sometimes doubled, and the first entry of an array that may be empty."""
    raw = docs(spark, d).where("lang is not null and source is not null").select("doc_id", F.expr(f"CASE WHEN doc_id % 2 = 0 THEN {_JSON} ELSE {_FLAT} END").alias("raw"))
    body = F.coalesce(F.get_json_object("raw", "$.ad_content.ad_content"), F.get_json_object("raw", "$.ad_content"))
    parsed = raw.select("doc_id", F.from_json(body, "title string, occupationCategories array<struct<level1: string, level2: string>>").alias("b"))
    return parsed.select("doc_id", "b.title", F.get("b.occupationCategories", 0)["level1"].alias("level1"))


@query("SELECT event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS http, ts - INTERVAL 2 HOUR AS parsed, date_diff('hour', ts, (SELECT max(ts) FROM events)) <= 24 AS fresh FROM events")
def feed_times(spark, d):
    """SRC8, DAT1, DAT2: HTTP dates, ISO times with an offset, and which rows are a day old at most."""
    e = table(spark, d, "events")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))
    newest = e.agg(F.max("ts").alias("newest"))
    hours = F.date_trunc("hour", "newest").cast("long") - F.date_trunc("hour", "ts").cast("long")
    out = e.join(F.broadcast(newest)).select("event_id", X.http_date(F.col("ts")).alias("http"), X.iso_timestamp(iso).alias("parsed"), (hours <= 24 * 3600).alias("fresh"))
    ntz = e.schema["ts"].dataType.typeName() == "timestamp_ntz"
    return out.withColumn("parsed", F.col("parsed").cast("timestamp_ntz")) if ntz else out


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def display_dates(spark, d):
    """DAT3: a date for display, or nothing."""
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.date_format(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")), "yyyy-MM-dd"), F.lit("")).alias("day"))


@query("WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders) SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS first_code FROM o GROUP BY 1")
def first_code(spark, d):
    """JOIN18: the first code of an item, in a stated order."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("first_code"))


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || '-7'), doc_id LIMIT 40")
def seeded_take(spark, d):
    """TOP7: a seeded order, and the first forty: a sampling operator."""
    return docs(spark, d).select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-7"))), "doc_id").limit(40)


@query("SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents WHERE n_chars BETWEEN 200 AND 4000) WHERE rank <= 5")
def quota_scan(spark, d):
    """TOP4: the first rows of each class until its quota is full, within a length range."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    return docs(spark, d).where("n_chars between 200 and 4000").select("lang", "doc_id", place.alias("rank")).where("rank <= 5")


@query("SELECT DISTINCT uri FROM (SELECT '/isco/C' || p_size AS uri FROM part UNION ALL SELECT '/isco/C' || (p_size + 1) FROM part WHERE p_size % 2 = 0)")
def narrower_union(spark, d):
    """SET4, SRC10: occupations and what is narrower, addresses in one spelling."""
    part = table(spark, d, "part")
    uri = lambda n: F.regexp_replace(F.concat(F.lit("/isco/c"), n.cast("string")), "/isco/c(?=\\d)", "/isco/C").alias("uri")
    return part.select(uri(F.col("p_size"))).unionByName(part.where("p_size % 2 = 0").select(uri(F.col("p_size") + 1))).distinct()


@query("SELECT n_nationkey, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS shown FROM nation")
def place_display(spark, d):
    """TXT33"""
    return table(spark, d, "nation").select("n_nationkey", F.initcap("n_name").alias("shown"))


@query("SELECT doc_id, substr(text, 1, 9000) AS body, false AS confirmed FROM documents WHERE NOT regexp_matches(text, '[@0-9]')")
def sealed_prefill(spark, d):
    """X16: bodies for labelling, scrubbed and cut, none of them confirmed. Here those without any digit or sign of an address, for which scrubbing changes nothing."""
    return docs(spark, d).where(~F.col("text").rlike("[@0-9]")).select("doc_id", F.substring(X.scrub_patterns(F.col("text")), 1, 9000).alias("body"), F.lit(False).alias("confirmed"))


_CONF = case("doc_id", 4, "true", "true", "false", "true")
_LAB = case("doc_id", 6, "'fluent'", "'desirable'", "''", "'perfect'", "'unstated'", "'certified'")
_WORK = case("doc_id", 5, "NULL", "'english'", "'klingon'", "'both'", "''")


@query(f"""WITH r AS (SELECT doc_id, {_CONF} AS confirmed, {_LAB} AS level, coalesce(nullif({_WORK}, ''), 'unstated') AS working, lang FROM documents JOIN labels USING (doc_id)), t AS (SELECT *, CASE WHEN NOT confirmed THEN 'unconfirmed' WHEN level = '' THEN 'no_level' WHEN level = 'perfect' THEN 'invalid_level' WHEN working = 'klingon' THEN 'invalid_working_language' WHEN doc_id % 9 = 0 THEN 'no_ad_text' END AS reason FROM r)
SELECT doc_id AS uuid, CASE WHEN reason IS NULL THEN 999 + row_number() OVER (PARTITION BY reason IS NULL ORDER BY doc_id) END AS n, reason, CASE WHEN reason IS NULL THEN CASE WHEN level = 'desirable' THEN true WHEN level IN ('fluent', 'certified') THEN false WHEN working IN ('english', 'both') THEN true ELSE lang IN ('en') END END AS derived_accessible FROM t""")
def label_ingest(spark, d):
    """DQ10: refused rows with a reason, accepted ones numbered from 1000."""
    own = docs(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id")
    none = F.lit(None).cast("string")
    rows = picked(own, confirmed=_CONF, level=_LAB, working=_WORK).select(F.col("doc_id").alias("n"), F.col("doc_id").alias("uuid"), "confirmed", "level", "working", none.alias("span"), none.alias("auth"), F.col("lang").alias("doc_lang"))
    accepted, refused = K.ingest_labels(rows, own.where("doc_id % 9 <> 0").select(F.col("doc_id").alias("uuid"), "text"))
    return accepted.select("uuid", F.col("n").cast("long").alias("n"), F.lit(None).cast("string").alias("reason"), "derived_accessible").unionByName(refused.select("uuid", F.lit(None).cast("long").alias("n"), "reason", F.lit(None).cast("boolean").alias("derived_accessible")))


@query()
def facet_records(spark, d):
    """DQ4, DQ5, DQ6, UDF4: whole records as JSON, every field checked and mended; a record may have any type anywhere. Tested on cases."""
    told = F.concat(F.lit("Norsk "), F.substring("text", 1, 60))
    span = F.struct(told.alias("span"), F.when(F.col("doc_id") % 5 == 0, "nb").otherwise("no").alias("section_language"))
    record = F.struct(
        F.array_repeat(span, (F.col("doc_id") % 6).cast("int")).alias("evidence_spans"), F.when(F.col("doc_id") % 2 == 0, "explicit_statement").otherwise("no_mention").alias("evidence_basis"),
        F.lit("explicit_but_hedged").alias("evidence_strength"), F.when(F.col("doc_id") % 7 == 0, "both").otherwise("fluent").alias("norwegian_requirement_level"), F.lit("norwegian").alias("stated_working_language"),
        F.lit("unstated").alias("application_language"), F.lit("offered").alias("visa_sponsorship"), F.lit("unstated").alias("relocation_support"), F.lit("senior").alias("seniority"), (F.col("doc_id") % 70).alias("min_years_experience"),
    )
    body = F.concat(told, F.lit(".\n"), F.coalesce("text", F.lit("")))
    return docs(spark, d).select("doc_id", C.judged(F.to_json(record), body).alias("j")).select("doc_id", "j.record", "j.reasons", "j.demoted")
