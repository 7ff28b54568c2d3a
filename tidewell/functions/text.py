"""Text functions as columns; pandas or Arrow functions only where Spark has no expression."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that results depend on: word lists and patterns, in natural order.
STOP_NO = """og i jeg er på som en et til for med av det den de har kan vi du ikke å om fra ved eller men også vil skal være blir her der hva hvor når man sin sitt våre min mitt din ditt hans hennes dem oss meg deg seg at så noe noen alle andre""".split()
STOP_EN = """i am a an the with and for do not is are was were be been of to in on at my me you we our your they them this that these those it its as by or but if then have has had will would can could should may might must""".split()
STOP_NOTICE = """looking look seeking seek searching search position positions role roles job jobs work working stilling stillinger jobb arbeid søker søkes permanent fast vikariat experience experienced erfaring erfaren preferably prefer preferred gjerne ønskelig day days evening evenings weekend weekends shift shifts dagvakt kveld helg skift fulltime full part time deltid heltid speak speaks speaking snakker språk language like want wish interested apply application søknad ansettelse tiltredelse snarest""".split()
STOPWORDS = sorted({*STOP_NO, *STOP_EN, *STOP_NOTICE})
LABEL_NOISE = """og i på som en et til for med av the a an and of in at mv andre annet øvrige diverse generell generelle""".split()
SKILL_STOP = """the a an and or of in on at to for with from by as is are be being been og i på som en et til for med av fra ved er use using used ensure ensuring apply applying perform performing carry out conduct manage managing work working utføre bruke bruk eller samt""".split()
#: Character replacements of the shared normaliser.
FOLD_FROM = "\u2018\u2019\u201c\u201d\u00a0\u2009\u202f\u2013\u2014"
FOLD_TO = "''\"\"   --"
FOLD_DROP = "\u00ad"
#: Marks that no text has: a line break, and around what is put aside.
BREAK, OPEN, CLOSE, NUMBER = "\ue000", "\ue001", "\ue002", "\ue003"
WORD = "[\\p{L}\\p{N}]+"
LANGUAGE_TOKEN = "norsk|norwegian|engelsk|english|skandinavisk|scandinavian|spr[åa]k|munnleg|muntlig|skriftlig|skriftleg|norskpr[øo]ve|bergenstest|niv[åa]\\s*[ABC][12]|cefr|nynorsk|bokm[åa]l|samisk"
BOILERPLATE = "personal data|privacy polic|\\bGDPR\\b|equal opportunit|regardless of (race|gender|age)|applicants? (of all|from all)|powered by|cookie polic|terms of service"
EMAIL = "\\b[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+\\b"
DATE_OR_HOURS = "\\b\\d{1,2}[./-]\\d{1,2}[./-]\\d{2,4}\\b"
PHONE = "(?<![\\w])(?:\\+\\s?47[\\s.-]?)?(?:\\d{3}[\\s.-]\\d{2}[\\s.-]\\d{3}|\\d{2}[\\s.-]\\d{2}[\\s.-]\\d{2}[\\s.-]\\d{2}|\\d{8})(?!\\d)"
EMAIL_MARK, PHONE_MARK, NAME_MARK = "[e-post fjernet]", "[telefon fjernet]", "[navn fjernet]"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def without(tokens: Column, stop: list[str]) -> Column:
    """Tokens that aren't in the list, in order, repeats kept."""
    return F.filter(tokens, lambda w: ~w.isin(stop))


def content_words(text: Column, stop: list[str] = STOPWORDS) -> Column:
    return without(words(text), stop)


def label_key(text: Column) -> Column:
    return F.array_join(words(text), " ")


def label_tokens(text: Column) -> Column:
    """A label's words but for noise, once each."""
    return F.array_distinct(without(words(text), LABEL_NOISE))


def skill_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(without(words(text), SKILL_STOP), lambda w: F.length(w) > 2))


def char_ngrams(word: Column, shortest: int = 9, smallest: int = 3, largest: int = 5) -> Column:
    """The character n-grams of a long word, marked with #; repeats kept."""
    grams = F.flatten(F.transform(F.sequence(F.lit(smallest), F.lit(largest)), lambda n: F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.concat(F.lit("#"), F.substr(word, i, n)))))
    return F.when(F.length(word) >= shortest, grams).otherwise(F.array().cast("array<string>"))


def fold_chars(text: Column) -> Column:
    """The normaliser's character replacements, without NFKC (see nfkc)."""
    return F.translate(text, FOLD_FROM + FOLD_DROP, FOLD_TO)


def upper_letters(text: Column) -> Column:
    """Upper case letter by letter, as DuckDB has it: what would become several letters stays, but for the German sharp s."""
    own = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.when(c == "ß", "ẞ").when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c))
    return F.array_join(own, "")


def lower_letters(text: Column) -> Column:
    """Lower case letter by letter: a sigma doesn't depend on what follows it, a dotted capital i is one letter."""
    return F.lower(F.translate(text, "Σİ", "σi"))


def squeeze(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, "\\s+", " "), F.lit(" "))


def place_key(text: Column) -> Column:
    """A place phrase in lower case without punctuation and area suffixes."""
    plain = F.btrim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}_\\s-]", " "), "\\s+", " "), F.lit(" "))
    bare = F.regexp_replace(plain, "([\\s-]*(omr[åa]det|omr[åa]de|og omegn|omegn|regionen|region|kommune|sentrum|area)[\\s-]*)+$", "")
    return F.btrim(bare, F.lit(" -"))


def anywhere(text: Column) -> Column:
    return text.rlike("(?i)^(anywhere|hele landet|norge|norway|any)$")


def canonical(text: Column) -> Column:
    """The comparison form: squeezed, lower case, digits masked unless they state a level, punctuation to spaces."""
    low = F.lower(squeeze(fold_chars(F.coalesce(text, F.lit("")))))
    # words that state a level are met first and keep their number: cheaper than looking back from each digit
    kept = "((?:niv[åa]|norskpr[øo]ve|trinn|spr[åa]kniv[åa]|level|grade)[^\\p{L}\\p{N}_]{0,3}\\p{Nd}{1,9}|[abc]\\p{Nd})"
    masked = F.regexp_replace(F.regexp_replace(low, kept + "|\\p{Nd}+", "$1#"), kept + "#", "$1")
    return F.btrim(F.regexp_replace(masked, "[^\\p{L}\\p{N}_#]+", " "), F.lit(" "))


def signature(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def content_hash(description: Column, title: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(description, F.lit("")), F.coalesce(title, F.lit(""))), 256)


def cache_key(model: str, version: str, text: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", F.lit(model), F.lit(version), squeeze(fold_chars(F.coalesce(text, F.lit(""))))), 256)


def head_tail(text: Column, head: int = 3500, tail: int = 2500) -> Column:
    """Long text as its head and tail around a mark."""
    return F.when(F.length(text) > head + tail, F.concat(F.substr(text, F.lit(1), F.lit(head)), F.lit("\n[...]\n"), F.substr(text, F.length(text) - tail + 1, F.lit(tail)))).otherwise(text)


def pairs(text: Column) -> Column:
    """Neighbouring words as "a b", once each; what holds a comma or full stop is no pair and must be filtered by pair_of_words().

    Strings, since Spark tells structs apart by comparing all of them.
    """
    all_ = F.regexp_extract_all(F.lower(text), F.lit(WORD + "|[,.]"), F.lit(0))
    n = F.greatest(F.size(all_) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(all_, F.lit(1), n), F.slice(all_, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))


def pair_of_words(pair: Column) -> Column:
    return F.translate(pair, ",.", "") == pair


def evidence_key(text: Column) -> Column:
    """What survives quoting: invisible signs and each line's leading marks dropped, one space between words, lower case (without NFKC)."""
    clean = F.translate(F.translate(F.coalesce(text, F.lit("")), "\u00a0", " "), "\u200b\u2060\ufeff\u00ad", "")
    bare = lambda x: F.when(x.rlike("[\\p{L}\\p{N}]"), F.regexp_replace(x, "^[^\\p{L}\\p{N}]+", "")).otherwise(x)
    lines = F.filter(F.transform(F.split(clean, "\n"), lambda x: squeeze(bare(squeeze(x)))), lambda x: x != "")
    return lower_letters(F.array_join(lines, " "))


def http_date(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def iso_timestamp(text: Column) -> Column:
    """An ISO 8601 time with an offset or Z; null if it doesn't parse."""
    return F.try_to_timestamp(text)


def sentences(text: Column) -> Column:
    return F.split(text, "(?<=[.!?])\\s+")


def keep_blocks(text: Column) -> Column:
    """Horizontal white space squeezed; newlines stay."""
    return F.btrim(F.regexp_replace(fold_chars(F.coalesce(text, F.lit(""))), "[^\\S\\n]+", " "), F.lit(" \t\n\r"))


def scrub_patterns(text: Column) -> Column:
    """E-mail addresses and telephone numbers replaced by marks; dates and hour ranges are no numbers."""
    held = F.regexp_replace(text, f"({DATE_OR_HOURS})", f"{OPEN}$1{CLOSE}")
    mailed = F.regexp_replace(held, EMAIL, EMAIL_MARK)
    # what was put aside is matched first and stays; anything else that matches is a number
    phoned = F.regexp_replace(mailed, f"({OPEN}[^{CLOSE}]*{CLOSE})|{PHONE}", f"{NUMBER}$1{NUMBER}")
    phoned = F.regexp_replace(phoned, f"{NUMBER}{NUMBER}", NUMBER)
    return F.translate(F.replace(F.regexp_replace(phoned, f"{NUMBER}?({OPEN}[^{CLOSE}]*{CLOSE}){NUMBER}?", "$1"), F.lit(NUMBER), F.lit(PHONE_MARK)), OPEN + CLOSE, "")


def boilerplate(text: Column) -> Column:
    """Legal and recruiting furniture, by its phrasing."""
    return F.coalesce(text.rlike("(?i)" + BOILERPLATE), F.lit(False))


def has_pii(text: Column) -> Column:
    masked = F.regexp_replace(text, DATE_OR_HOURS, OPEN)
    return masked.rlike(EMAIL) | masked.rlike(PHONE)


def fold(text: str | None) -> str:
    """NFKC, the character replacements, one space between words."""
    folded = unicodedata.normalize("NFKC", text or "").translate({ord(a): b for a, b in zip(FOLD_FROM, FOLD_TO, strict=True)} | {ord(FOLD_DROP): None})
    return " ".join(folded.split())


def in_slices(df: DataFrame, schema: str, make: Callable[[pa.Array, list], list], rows: int = 64) -> DataFrame:
    """make(keys, values) for some rows of df's two columns at a time: what Python holds besides the batch that came doesn't grow with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                yield pa.RecordBatch.from_arrays(make(part.column(0), part.column(1).to_pylist()), names)

    out = T._parse_datatype_string(schema)
    names = out.names
    return df.mapInArrow(run, out)


def nfkc(texts: DataFrame) -> DataFrame:
    """(key, text): fold() of each text; Spark has no expression for NFKC."""
    key, text = texts.columns
    return in_slices(texts, f"{key} {texts.schema[key].dataType.simpleString()}, {text} string", lambda keys, values: [keys, pa.array([fold(x) for x in values], pa.string())])


@F.pandas_udf(T.StringType())
def scrub(text: pd.Series, contacts: pd.Series) -> pd.Series:
    """Patterns, then the item's own contacts: telephone numbers however they are grouped, names longest first."""
    return pd.Series([scrub_item(t, c) for t, c in zip(text, contacts, strict=True)])


def scrub_item(text: str | None, contacts) -> str:
    if not text:
        return ""
    held: list[str] = []

    def park(m: re.Match) -> str:
        held.append(m[0])
        return f"{OPEN}{len(held) - 1}{CLOSE}"

    out = re.sub(PHONE, PHONE_MARK, re.sub(EMAIL, EMAIL_MARK, re.sub(DATE_OR_HOURS, park, text)))
    people = [dict(c) for c in (contacts if contacts is not None else [])]
    for person in people:
        digits = re.sub(r"\D", "", person.get("phone") or "")
        groups = {digits[k : k + 8] for k in range(0, len(digits), 8)} | {digits[-8:]}
        for number in sorted(g for g in groups if len(g) == 8):
            gap = "[\\s.\u00a0-]{0,2}"
            out = re.sub(f"(?<![\\d\\w])(?:(?:\\+|00){gap}47{gap})?{gap.join(number)}(?!\\d)", PHONE_MARK, out)
    out = re.sub(f"{OPEN}(\\d+){CLOSE}", lambda m: held[int(m[1])], out)
    for name in sorted({(p.get("name") or "").strip() for p in people}, key=lambda n: (-len(n), n)):
        if len(name) >= 4:
            out = out.replace(name, NAME_MARK)
    return out


_BLOCKS = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "div"}
_SKIPPED = {"script", "style", "noscript"}


class _Reader(HTMLParser):
    """Collects, for each block element in document order, the text outside inner blocks; br ends a piece."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = []  # tag, pieces, has inner block
        self.open: list[int] = []
        self.loose: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skip += 1
        elif tag == "br":
            self.handle_data(BREAK)
        elif tag in _BLOCKS:
            if tag in ("p", "li", "td") and self.open and self.blocks[self.open[-1]][0] == tag:
                self.open.pop()
            elif tag != "p" and self.open and self.blocks[self.open[-1]][0] == "p":
                self.open.pop()
            for k in self.open:
                self.blocks[k][2] = True
            self.blocks.append([tag, [], False])
            self.open.append(len(self.blocks) - 1)

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in _BLOCKS and any(self.blocks[k][0] == tag for k in self.open):
            while self.blocks[self.open.pop()][0] != tag:
                pass

    def handle_data(self, data):
        if not self.skip:
            (self.blocks[self.open[-1]][1] if self.open else self.loose).append(data)


def html_blocks_of(html: str | None) -> list[dict]:
    """The ordered content blocks of a page: index, tag, text, n_chars."""
    if not html or not html.strip():
        return []
    reader = _Reader()
    reader.feed(html)
    reader.close()
    out: list[dict] = []

    def emit(tag: str, text: str) -> None:
        for piece in text.split(BREAK):
            if len(piece := piece.strip()) >= 2:
                out.append({"index": len(out), "tag": tag, "text": piece, "n_chars": len(piece)})

    for tag, pieces, mixed in reader.blocks:
        text = fold(" ".join(pieces))
        if not mixed or len(text) >= 3:
            emit(tag, text)
    if not out:
        for line in "".join(reader.loose).split("\n"):
            emit("p", fold(line))
    return out


def html_blocks(pages: DataFrame) -> DataFrame:
    """(key, index, tag, text, n_chars): a row for each content block of pages (key, html)."""

    def make(keys: pa.Array, values: list) -> list:
        blocks = [html_blocks_of(x) for x in values]
        flat = [b for bs in blocks for b in bs]
        own = keys.take(pa.array([k for k, bs in enumerate(blocks) for _ in bs], pa.int64()))
        return [own, *(pa.array([b[name] for b in flat], kind) for name, kind in (("index", pa.int32()), ("tag", pa.string()), ("text", pa.string()), ("n_chars", pa.int32())))]

    key = pages.columns[0]
    return in_slices(pages, f"{key} {pages.schema[key].dataType.simpleString()}, index int, tag string, text string, n_chars int", make)


def html_text(pages: DataFrame) -> DataFrame:
    """(key, text): the content blocks of pages (key, html), a line each."""
    key = pages.columns[0]
    return in_slices(pages, f"{key} {pages.schema[key].dataType.simpleString()}, text string", lambda keys, values: [keys, pa.array(["\n".join(b["text"] for b in html_blocks_of(x)) for x in values], pa.string())])


def stem_chain(word: str, stemmers, steps: int = 4) -> list[str]:
    """The word, then each stemmer's successive stems until they settle; once each."""
    out = [word]
    for stem in stemmers:
        now = word
        for _ in range(steps):
            following = stem(now)
            if not following or following == now:
                break
            now = following
            if now not in out:
                out.append(now)
    return out


def stems(tokens: Column, stemmers) -> Column:
    """stem_chain() of each token; without stemmers the tokens themselves."""
    if not stemmers:
        return F.transform(tokens, lambda w: F.array(w))
    chain = F.pandas_udf(lambda s: s.map(lambda ws: [stem_chain(w, stemmers) for w in ws]), T.ArrayType(T.ArrayType(T.StringType())))
    return chain(tokens)


def fold_lines(text: str | None) -> str:
    """fold() that keeps line breaks."""
    return "\n".join(fold(line) for line in (text or "").split("\n"))
