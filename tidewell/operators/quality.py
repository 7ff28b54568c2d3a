"""Extraction quality: evidence spans, coherence, enumerations, repair, gates, batching, sampling."""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import text as X

#: The level field's vocabulary, and the levels that open or close an item to other speakers.
LEVELS = ["certified", "fluent", "professional", "conversational", "desirable", "scandinavian_accepted", "either_norwegian_or_english", "explicitly_not_required", "unstated"]
WORKING = ["norwegian", "english", "both", "scandinavian", "unstated"]
OPEN_LEVELS = ["either_norwegian_or_english", "explicitly_not_required", "desirable"]
CLOSED_LEVELS = ["certified", "fluent", "professional", "conversational", "scandinavian_accepted"]
START, END = ".!?:;\n", ".!?\n"
MARKER = "[...]"


class GateFailed(RuntimeError):
    """Too many records lost their verdict; nothing is written."""


def accessible(level: Column, working: Column, doc_lang: Column) -> Column:
    """Whether a speaker without the local language can apply: the level decides, then the working language, then the text's own. A null level is an error."""
    checked = F.when(level.isNull(), F.raise_error(F.lit("requirement level is missing"))).otherwise(level)
    working = F.coalesce(working, F.lit("unstated"))
    return F.when(checked.isin(OPEN_LEVELS), True).when(checked.isin(CLOSED_LEVELS), False).when(working.isin("english", "both"), True).when(working.isin("norwegian", "scandinavian"), False).otherwise(F.coalesce(doc_lang.isin("en", "mixed", "other", "unknown"), F.lit(False)))


def coherence(spans: Column, basis: Column, strength: Column, level: Column, seniority: Column, years: Column) -> Column:
    """Reasons why a record contradicts itself, in a fixed order; spans is the number of evidence spans."""
    some = F.coalesce(spans, F.lit(0)) > 0
    explicit = F.coalesce(basis == "explicit_statement", F.lit(False))
    rules = [
        (explicit & ~some, "explicit_statement_without_span"),
        ((basis == "no_mention") & some, "no_mention_with_span"),
        ((strength == "none") & some, "strength_none_with_span"),
        (strength.isin("explicit_and_unambiguous", "explicit_but_hedged") & ~some, "explicit_strength_without_span"),
        ((level == "explicitly_not_required") & ~explicit, "not_required_without_explicit_evidence"),
        ((level == "either_norwegian_or_english") & ~explicit, "disjunction_without_explicit_evidence"),
        (~level.eqNullSafe(F.lit("unstated")) & (basis == "no_mention"), "verdict_without_evidence"),
        ((seniority == "senior") & (years == 0), "senior_with_zero_years"),
    ]
    return F.array_compact(F.array(*[F.when(c, name) for c, name in rules]))


def enum_errors(fields: dict[str, tuple[Column, list[str]]]) -> Column:
    """enum:<field>=<value> for each value outside its vocabulary; a null is one too."""
    bad = [F.when(v.isNull(), F.lit(f"enum:{k}=None")).when(~v.isin(allowed), F.concat(F.lit(f"enum:{k}='"), v, F.lit("'"))) for k, (v, allowed) in fields.items()]
    return F.array_compact(F.array(*bad))


def shape_errors(spans: Column, years: Column, most: int = 4, longest: int = 300) -> Column:
    long_ = F.filter(F.transform(F.coalesce(spans, F.array().cast("array<string>")), lambda s, i: F.when(F.length(s) > longest, F.concat(F.lit("shape:evidence_spans["), i.cast("string"), F.lit(f"].span:maxLength_{longest}_got_"), F.length(s).cast("string")))), lambda s: s.isNotNull())
    rest = F.array_compact(F.array(F.when(F.size(spans) > most, F.concat(F.lit(f"shape:evidence_spans:maxItems_{most}_got_"), F.size(spans).cast("string"))), F.when((years < 0) | (years > 60), F.lit("shape:min_years_experience:range"))))
    return F.concat(rest, long_)


def repair(rows: DataFrame, kept: str = "kept_spans") -> DataFrame:
    """A verdict whose evidence is gone becomes unstated; the record is marked."""
    lost = (F.size(F.coalesce(F.col(kept), F.array().cast("array<string>"))) == 0) & (F.col("level") != "unstated") & (F.col("basis") == "explicit_statement")
    lost = F.coalesce(lost, F.lit(False))
    return rows.withColumns({"level": F.when(lost, "unstated").otherwise(F.col("level")), "basis": F.when(lost, "no_mention").otherwise(F.col("basis")), "strength": F.when(lost, "none").otherwise(F.col("strength")), "demoted": lost})


def demotion_gate(rows: DataFrame, most: float = 0.15) -> float:
    """The share of demoted records; raises beyond `most`."""
    share = rows.agg(F.avg(F.col("demoted").cast("double")).alias("s")).first()["s"] or 0.0
    if share > most:
        raise GateFailed(f"{share:.3f} of the records were demoted, most {most}")
    return share


_TOKEN = re.compile(X.LANGUAGE_TOKEN, re.I)


def span_verdict(span: str | None, text: str | None, shortest: int = 15, token: re.Pattern = _TOKEN) -> tuple[bool, str]:
    """Is the span evidence? Verbatim, long enough, about language, and at least one occurrence is a whole statement."""
    quoted = X.fold(span)
    body = "\n".join(" ".join(line.split()) for line in X.fold_lines(text).split("\n")).strip()
    if quoted not in body:
        return False, "not_verbatim"
    if len(quoted) < shortest:
        return False, "fragment_too_short"
    if not token.search(quoted):
        return False, "no_language_token"
    reasons = [edge_reason(quoted, body, m.start()) for m in re.finditer(f"(?={re.escape(quoted)})", body)]
    return (True, "") if "" in reasons else (False, reasons[0])


def edge_reason(span: str, body: str, at: int) -> str:
    """Why the occurrence isn't a whole statement, or nothing. Signs that are no letters or digits are stepped over."""
    for ch in reversed(body[:at]):
        if ch in START:
            break
        if ch.isalnum():
            return "starts_mid_sentence"
    after = body[at + len(span) :]
    if span[-1] not in END:
        for ch in after:
            if ch in END:
                break
            if ch.isalnum():
                return "ends_mid_sentence"
    cut = body[:at].rstrip(" \t\n").endswith(MARKER) or after.lstrip(" \t\n").startswith(MARKER)
    return "truncated_fragment" if cut else ""


_VERDICT = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("reason", T.StringType())])


@F.pandas_udf(_VERDICT)
def span_check(span: pd.Series, text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([span_verdict(s, t) for s, t in zip(span, text, strict=True)], columns=["ok", "reason"])


def language_mass(blocks: DataFrame, key: str, low: float = 0.2, high: float = 0.8, dominance: float = 0.5) -> DataFrame:
    """(key, doc_lang, is_bilingual, n_scored) from blocks (key, cls in no/en/other, n_chars): verdict by characters."""
    mass = lambda c: F.coalesce(F.sum(F.when(F.col("cls") == c, F.col("n_chars"))), F.lit(0))
    m = blocks.groupBy(key).agg(mass("no").alias("no"), mass("en").alias("en"), mass("other").alias("other"), F.count("cls").alias("n_scored"))
    total = F.col("no") + F.col("en") + F.col("other")
    foreign, english = F.try_divide("other", total), F.try_divide(F.col("en"), F.col("no") + F.col("en"))
    verdict = F.when(total == 0, "unknown").when(foreign > dominance, "other").when(foreign >= low, "mixed").when(english >= high, "en").when(english <= low, "no").otherwise("mixed")
    return m.select(key, verdict.alias("doc_lang"), (verdict == "mixed").alias("is_bilingual"), "n_scored")


def byte_chunks(sizes: Iterable[int], most: int) -> list[int]:
    """The batch of each row: greedy by bytes in order, a row over the limit alone."""
    out, batch, held = [], 0, 0
    for size in sizes:
        if held and held + size > most:
            batch, held = batch + 1, 0
        out.append(batch)
        held += size
    return out


def batch_by_bytes(rows: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """rows with `batch`: byte_chunks() inside each group, in the given order. Sequential by nature, so groups should be files or shards."""
    schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.IntegerType())])
    return rows.groupBy(group).applyInPandas(lambda g: (g := g.sort_values(order)).assign(batch=byte_chunks(g[size], most)), schema)


def stratified_sample(rows: list[tuple[int, str]], quota: dict[str, int], seed: int) -> list[int]:
    """Seeded draws, stratum after stratum, none twice; for small frames on the driver."""
    rng, taken, out = random.Random(seed), set(), []
    for stratum, n in quota.items():
        left = sorted(k for k, s in rows if s == stratum and k not in taken)
        rng.shuffle(left)
        out += left[:n]
        taken.update(left[:n])
    return out


def extract(rows: DataFrame, schema: str, model: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Run an injected model over rows in batches; the model returns rows of the schema, keyed by id and never by position."""
    return rows.mapInPandas(lambda batches: (model(b) for b in batches), schema)


def census(items: DataFrame, key: str, text: str, cache: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], most_demoted: float = 0.15) -> DataFrame:
    """(key, level, demoted): one model call for each group of near-duplicates without a cached answer, checked, gated and fanned out.

    cache has columns signature, level, span; the model gets (signature, text) and returns those.
    """
    marked = items.select(key, text, X.signature(F.col(text)).alias("signature"))
    reps = marked.groupBy("signature").agg(F.min_by(text, key).alias(text))
    answers = extract(reps.join(cache.select("signature"), "signature", "left_anti").select("signature", text), "signature string, level string, span string", model)
    every = cache.select("signature", "level", "span").unionByName(answers)
    checked = reps.join(every, "signature").withColumn("kept_spans", F.when(span_check("span", text)["ok"], F.array("span")).otherwise(F.array().cast("array<string>")))
    checked = checked.withColumns({"basis": F.when(F.col("level") == "unstated", "no_mention").otherwise("explicit_statement"), "strength": F.lit("explicit_and_unambiguous")})
    repaired = repair(checked).select("signature", "level", "demoted").persist()
    demotion_gate(repaired, most_demoted)
    return marked.join(repaired, "signature").select(key, "level", "demoted")
