"""Records from models and reviewers: validation with a first reason, agreement, repair, batch results, review flags."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import quality as Q

# Fixed values that results depend on.
SKILL_LEVELS = ["required", "preferred"]
VIOLATED = ["language", "authorisation", "licence", "other"]
PRIORITIES = ["hard", "soft"]
SPOKEN = ["none", "basic", "conversational", "fluent", "native"]
#: What a seeker may state, and the column it is compared with; None where the catalogue records nothing.
PARSE_FACETS: dict[str, str | None] = {
    "occupation": "ad_taxonomy.job_title_standardised",
    "skill": "ad_facets.skills",
    "language.norwegian": "ad_facets.norwegian_requirement_level",
    "language.english": "ad_facets.stated_working_language",
    "language.other": None,
    "credential.authorisation": "ad_facets.authorisation_required",
    "credential.licence": None,
    "credential.trade_certificate": None,
    "location.place": "ad_locations.municipal",
    "location.anywhere": "ad_locations.country",
    "work.remote": None,
    "contract.permanence": "ads.engagementtype",
    "contract.extent": "ads.extent",
    "contract.shift": None,
    "experience.years": "ad_facets.min_years_experience",
    "seniority": "ad_facets.seniority",
}
UNUSABLE = ["", "unstated", "null", "Ikke oppgitt"]
AUTHORISATION = "(?i)autoris|authoris|authoriz"
PROFESSIONS = "sykepleier|vernepleier|lege|tannlege|helsefagarbeider|fysioterapeut|ergoterapeut|jordmor|psykolog|farmas[øo]yt|radiograf|bioingeni[øo]r"
TRAILING = ".,;:!?"
PAIR_ID = "^[a-zA-Z0-9_-]{1,64}$"
TEXT_CAP, NOTICE = 10_000, "[advertisement truncated here]"


class BatchFailed(RuntimeError):
    """A batch ended in a state nobody knows, or never ended."""


def first_reason(*rules: tuple[Column, str | Column]) -> Column:
    """The name of the first rule that holds, else null. Rules that are null don't hold."""
    return F.coalesce(*[F.when(rule, F.lit(name) if isinstance(name, str) else name) for rule, name in rules])


def blank(value: Column) -> Column:
    return value.isNull() | (F.btrim(value, F.lit(" \t\n\r")) == "")


def usable(value: Column) -> Column:
    """Is a facet's value more than a placeholder?"""
    return value.isNotNull() & ~value.isin(UNUSABLE)


def skill_reason(phrase: Column, gloss: Column, level: Column, text: Column) -> Column:
    """Why a skill can't be the item's; a phrase may be a fragment, but must be quoted."""
    return first_reason(
        (level.isNull() | ~level.isin(SKILL_LEVELS), "level"),
        (blank(gloss), "empty_gloss"),
        (blank(phrase), "empty_phrase"),
        (~F.contains(X.keep_blocks(text), X.squeeze(X.fold_chars(phrase))), "phrase_not_found"),
    )


def judgment_reason(grade: Column, violates: Column, facet: Column, evidence: Column, text: Column) -> Column:
    """Why a judgment can't be true of its item: grades from 0 to 3, a known facet, and a violation quotes the text."""
    return first_reason(
        (grade.isNull() | (grade < 0) | (grade > 3), "grade"),
        (facet.isNotNull() & ~facet.isin(VIOLATED), "facet"),
        (violates & blank(evidence), "no_evidence"),
        (violates & ~F.contains(X.evidence_key(text), X.evidence_key(evidence)), "evidence_not_found"),
        (violates & (facet == "language") & evidence.rlike(AUTHORISATION), "authorisation_as_language"),
    )


def pair_id(persona: Column, index: Column) -> Column:
    """persona-index; an error if it isn't an id that a batch accepts."""
    made = F.concat_ws("-", persona, index.cast("string"))
    return F.when(made.rlike(PAIR_ID), made).otherwise(F.raise_error(F.concat(F.lit("not a pair id: "), made)))


def parse_reason(known: Column, nth: Column, facet: Column, priority: Column, evidence: Column, query: Column, value: Column) -> Column:
    """Why a seeker's stated constraint is refused. nth counts the parses of its seeker from 1."""
    return first_reason(
        (~known, "unknown_persona"),
        (nth > 1, "duplicate_parse"),
        (facet.isNull() | ~facet.isin(list(PARSE_FACETS)), "unknown_facet"),
        (priority.isNull() | ~priority.isin(PRIORITIES), "priority"),
        (blank(evidence), "no_evidence"),
        (~F.contains(X.squeeze(query), X.squeeze(evidence)), "evidence_not_in_query"),
        (facet.isin("language.norwegian", "language.english") & (value.isNull() | ~value.isin(SPOKEN)), "level"),
    )


def first_value(rows: DataFrame, key: str, facet: str, place: str = "place") -> DataFrame:
    """(key, value) of the first row of a facet; who has no row has none, never a default."""
    return rows.where(F.col("facet") == facet).groupBy(key).agg(F.min_by("value", place).alias("value"))


def coverage(parses: DataFrame, population: DataFrame) -> DataFrame:
    """(split, n, schema, weighted, n_hard, schema_hard, weighted_hard): how much of what seekers state the catalogue could answer.

    parses: split, facet, priority. population: facet, share of items with a usable value (facets without a counterpart have no row).
    """
    met = parses.join(F.broadcast(population), "facet", "left")  # one row for each facet
    hard = F.col("priority") == "hard"
    has, share = F.col("share").isNotNull().cast("double"), F.coalesce("share", F.lit(0.0))
    return met.groupBy("split").agg(F.count("*").alias("n"), F.avg(has).alias("schema"), F.avg(share).alias("weighted"), F.count(F.when(hard, 1)).alias("n_hard"), F.avg(F.when(hard, has)).alias("schema_hard"), F.avg(F.when(hard, share)).alias("weighted_hard"))


def grounded(value: Column, text: Column) -> Column:
    return F.contains(F.lower(X.squeeze(X.fold_chars(text))), F.lower(X.squeeze(X.fold_chars(value))))


def authorisation_matches(expected: Column, got: Column) -> Column:
    """Both silent, or both of an authorisation whose named professions don't contradict."""
    found = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(PROFESSIONS), F.lit(0))))
    e, g = found(expected), found(got)
    named = F.contains(F.lower(got), F.lit("autorisasjon")) & ((F.size(e) == 0) | (F.size(g) == 0) | (e == g))
    return F.when(blank(expected), blank(got)).otherwise(F.when(blank(got), False).otherwise(named))


def span_agreement(want: Column, got: Column) -> Column:
    """strict, trailing_punct_only, containment or disjoint."""
    bare = lambda c: F.regexp_replace(c, f"[{TRAILING}]+$", "")
    w, g = X.squeeze(X.fold_chars(want)), X.squeeze(X.fold_chars(got))
    return F.when(w == g, "strict").when(bare(w) == bare(g), "trailing_punct_only").when(F.contains(g, w) | F.contains(w, g), "containment").otherwise("disjoint")


def ingest_labels(rows: DataFrame, texts: DataFrame, start: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(accepted with a number n, refused with a reason) from rows (n, uuid, confirmed, level, working, span, auth, doc_lang) and texts (uuid, text).

    The derived field is computed, never taken over; accepted rows are numbered without gaps. The
    second of two good rows of one uuid is a duplicate.
    """
    met = rows.withColumn("working", F.when(blank(F.col("working")), "unstated").otherwise(F.col("working"))).join(texts.withColumn("found", F.lit(True)), "uuid", "left")
    sent = X.head_tail(F.col("text"))
    span, auth = F.col("span"), F.col("auth")
    verdict = Q.span_check("span", "sent")
    met = met.withColumn("sent", sent).withColumn("verdict", verdict)
    own = first_reason(
        (~F.coalesce("confirmed", F.lit(False)), "unconfirmed"),
        (blank(F.col("level")), "no_level"),
        (~F.col("level").isin(Q.LEVELS), "invalid_level"),
        (~F.col("working").isin(Q.WORKING), "invalid_working_language"),
        (F.col("found").isNull(), "no_ad_text"),
        (~blank(span) & ~F.col("verdict.ok"), F.concat(F.lit("span:"), F.col("verdict.reason"))),
        (~blank(auth) & ~grounded(auth, F.col("text")), "authorisation_not_in_ad"),
    )
    met = met.withColumn("reason", own)
    order = [F.col("n").asc_nulls_last(), F.col("uuid")]
    earlier = F.count(F.when(F.col("reason").isNull(), 1)).over(Window.partitionBy("uuid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    met = met.withColumn("reason", F.when(F.coalesce(F.col("reason") != "unconfirmed", F.lit(True)) & (earlier > 0), "duplicate_uuid").otherwise(F.col("reason")))
    accepted = met.where("reason is null")
    number = F.row_number().over(Window.orderBy(*order)) + F.lit(start - 1)  # labels that people wrote: few
    level, working = F.col("level"), F.col("working")
    accepted = accepted.select(number.alias("n"), "uuid", "level", "working", Q.accessible(level, working, F.coalesce("doc_lang", F.lit("no"))).alias("derived_accessible"))
    return accepted, met.where("reason is not null").select("n", "uuid", "reason")


def parse_results(raw: DataFrame, tool: str) -> DataFrame:
    """(custom_id, type, error, input) of batch result lines (column value, JSON).

    Only a whole tool call of the given name succeeds; one cut off by the token limit is an error and never salvaged.
    """
    block = "struct<type: string, name: string, input: string>"
    schema = f"custom_id string, result struct<type: string, error: string, message: struct<stop_reason: string, content: array<{block}>>>"
    r = raw.select(F.from_json("value", schema).alias("r")).select("r.custom_id", "r.result.type", "r.result.error", "r.result.message")
    call = F.get(F.filter("message.content", lambda b: (b["type"] == "tool_use") & (b["name"] == tool)), 0)["input"]
    error = (
        F.when(F.col("type").isin("expired", "canceled"), F.lit(None).cast("string"))
        .when(F.col("type").isNull() | (F.col("type") != "succeeded"), F.coalesce("error", "type", F.lit("None")))
        .when(F.col("message.stop_reason") == "max_tokens", "stop_reason=max_tokens")
        .when(call.isNull(), F.concat(F.lit("no "), F.lit(tool), F.lit(" block")))
    )
    kind = F.when(F.col("type").isin("expired", "canceled"), F.col("type")).when(error.isNotNull(), "errored").otherwise("succeeded")
    return r.select("custom_id", kind.alias("type"), error.alias("error"), F.when(kind == "succeeded", call).alias("input"))


def carried_flags(value_judged: Column, value_now: Column, wrong: Column, note: Column, value_ok: Column) -> Column:
    """Why an earlier verdict may not hold any more."""
    return F.array_compact(F.array(F.when(~value_judged.eqNullSafe(value_now), "value_changed"), F.when(wrong, "tool_was_wrong"), F.when(F.contains(F.lower(note), F.lit("unstated")) & (value_ok == "yes"), "note_disagrees")))


def scrub_facets(skills: Column, authorisation: Column) -> tuple[Column, Column]:
    """Phrases and authorisations without contact details; evidence spans stay as quoted."""
    return F.transform(skills, lambda s: s.withField("phrase", X.scrub_patterns(s["phrase"]))), X.scrub_patterns(authorisation)


def prompt_text(title: Column, body: Column) -> Column:
    """What is sent: the title, and the body up to the cap with a notice."""
    kept = F.when(F.length(body) > TEXT_CAP, F.concat(F.substring(body, 1, TEXT_CAP), F.lit("\n" + NOTICE))).otherwise(body)
    return F.format_string("TITLE: %s\n\n%s", F.coalesce(title, F.lit("")), F.coalesce(kept, F.lit("")))


def missing_columns(wanted: Iterable[str | None], tables: dict[str, DataFrame]) -> list[str]:
    """Which of `table.column` don't exist; the check that a mapping names real things."""
    there = {f"{name}.{column}" for name, frame in tables.items() for column in frame.columns}
    return sorted(w for w in wanted if w and w not in there)


def key_sets_differ(cache: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """(key, side) of what only one side has: a cache is valid only if this is empty."""
    one = cache.select(key).distinct().join(corpus.select(key), key, "left_anti").withColumn("side", F.lit("cache"))
    return one.unionByName(corpus.select(key).distinct().join(cache.select(key), key, "left_anti").withColumn("side", F.lit("corpus")))


# --- calls, on the driver or in one partition ---------------------------------------------------


class Bucket:
    """A token bucket: at most `rate` calls a second, evenly spread."""

    def __init__(self, rate: float = 5.0, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.now, self.sleep, self.next = 1.0 / rate, now, sleep, now()

    def acquire(self) -> None:
        wait = self.next - self.now()
        if wait > 0:
            self.sleep(wait)
        self.next = max(self.next, self.now()) + self.gap


def with_retry(call: Callable[[], tuple[int, object]], tries: int = 5, least: float = 2.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = lambda: 0.0) -> tuple[int, object]:
    """call() gives (status, body); 429, 5xx and transport errors are tried again with growing waits."""
    for k in range(tries):
        try:
            status, body = call()
        except OSError as failed:
            status, body = 0, failed
        if status and status != 429 and status < 500 or k == tries - 1:
            return status, body
        sleep(min(most, least * 2**k + jitter()))
    raise AssertionError


def outcome(status: int, body) -> str:
    """active, inactive_stub, http_error or error."""
    if status == 0:
        return "error"
    if status >= 400 or not isinstance(body, dict):
        return "http_error"
    return "active" if body.get("ad_content") else "inactive_stub"


def fetch_details(keys: DataFrame, key: str, get: Callable[[str], tuple[int, object]], rate: float = 5.0, tasks: int = 5) -> DataFrame:
    """(key, outcome, payload): each key looked up once. The limit is shared out among the tasks; a failed task is run again by Spark."""
    import json

    def run(batches):
        limit = Bucket(rate / tasks)
        for batch in batches:
            out = []
            for value in batch[key]:
                limit.acquire()
                status, body = with_retry(lambda value=value: get(value))
                kind = outcome(status, body)
                out.append((value, kind, json.dumps(body) if kind in ("active", "inactive_stub") else None))
            yield type(batch)(out, columns=[key, "outcome", "payload"])

    return keys.select(F.col(key).cast("string").alias(key)).distinct().repartition(tasks, key).mapInPandas(run, f"{key} string, outcome string, payload string")


def narrower(roots: Iterable[str], get: Callable[[str], list[str]]) -> set[str]:
    """All that the roots lead to, breadth first; each address is asked once, and cycles end."""
    found: set[str] = set()
    at = list(dict.fromkeys(roots))
    while at:
        found.update(at)
        at = list(dict.fromkeys(x for uri in at for x in get(uri) if x not in found))
    return found


def poll(state: Callable[[], str], most: int = 100, wait: Callable[[], None] = lambda: None) -> str:
    """Ask until the batch has ended."""
    for _ in range(most):
        now = state()
        if now == "ended":
            return now
        if now not in ("in_progress", "canceling"):
            raise BatchFailed(f"unknown state {now!r}")
        wait()
    raise BatchFailed(f"not ended after {most} polls")
