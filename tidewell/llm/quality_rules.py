"""Line-first cleaning with native expressions only: rules judge lines, then documents that lost too much.

Everything of one document is computed inside its row: no shuffle, and no group that could be hot.
Arrays that a lambda reads are columns of an earlier projection; each is read more than once
above, so the optimizer doesn't inline (and evaluate again for each element) what made them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
#: A line may end in these.
TERMINAL = ".!?:;,…。！？\"'”’»)]"
MARKS = "!?#*$%&|<>=~_^@\\/{}[]+"
SEPARATORS = "|»>·"
MENU = "home|menu|login|log in|sign in|sign up|register|next|previous|back to top|read more|share|search|sitemap|contact us|about us|skip to content"
BOILERPLATE = (
    "all rights reserved|copyright ©|\\(c\\) [12][0-9]{3}|cookie policy|cookies? (to|on this)|privacy policy|terms of (use|service)|"
    "enable javascript|javascript is (disabled|required)|lorem ipsum|subscribe to our|powered by|click here"
)


def clean(docs: DataFrame, most_marks: float = 0.2, most_lost: float = 0.3, shortest_menu: int = 3) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_removed_lines, kept_text.

    A line with text fails (1) punctuation: it has no terminal mark at its end, or marks make up
    more than most_marks of its characters; (2) navigation: it has separators (| » > ·) between
    shortest_menu or more items of 25 characters at most on average, or is nothing but a menu word; (3) boilerplate: it holds a legal
    or site phrase. Failed lines are removed; blank lines stay. kept is false if base_failed, if
    nothing is left, or if more than most_lost of the non-blank lines' characters went.
    Null and empty texts have no words: base_failed is true. Rows with equal ids are separate documents;
    columns of docs that clash with the new ones are replaced.
    """
    text, words, h, s, pos = (F.col(c) for c in ("_text", "_words", "_h", "_s", "_pos"))
    space = "[\\x20\\x09-\\x0D]+"
    # a row's own columns stay in one struct, whatever their names
    out = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    out = out.withColumn("_trim", F.btrim(text, F.lit(SPACES)))
    out = out.withColumns(
        {
            "_words": F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", space)),
            "_lines": F.split(text, "\n"),
            "_all": F.length(text),
            "_bare": F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES))),
        }
    )
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
            "n_symbols": (F.col("_all") - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "_h": F.when(F.size(words) < 5, F.array().cast("array<bigint>")).otherwise(
                F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))
            ),
            "_dups": F.filter("_lines", lambda x: F.translate(x, SPACES, "") != ""),
            "_ok": F.transform("_bare", lambda x: ~line_fails(x, most_marks, shortest_menu)),
        }
    )
    out = out.withColumns(
        {
            "n_dup_lines": (F.size("_dups") - F.size(F.array_distinct("_dups"))).cast("long"),
            "n_lines": F.size("_dups").cast("long"),
            "kept_text": F.array_join(F.filter("_lines", lambda x, i: F.get(F.col("_ok"), i)), "\n"),
            "_n_ok": F.size(F.filter("_ok", lambda ok: ok)),
            "_s": F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))),
        }
    )
    twice = F.filter(s, lambda e, k: (F.get(s, k - 1)["x"].eqNullSafe(e["x"])) | (F.get(s, k + 1)["x"].eqNullSafe(e["x"])))
    out = out.withColumn("_pos", F.when(s.isNotNull(), F.sort_array(F.transform(twice, lambda e: e["i"]))))
    steps = F.transform(pos, lambda p, k: F.least(F.lit(5), F.coalesce(F.get(pos, k + 1), p + 5) - p))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"))
    out = out.withColumn("n_removed_lines", (F.size("_lines") - F.col("_n_ok")).cast("long"))
    bad = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.length(F.translate("kept_text", SPACES, ""))
    out = out.withColumn("base_failed", bad).withColumn("kept", ~bad & (left > 0) & (F.col("word_chars") - left <= most_lost * F.col("word_chars")))
    new = [c for c in out.columns if not c.startswith("_")]
    return out.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in new], *new)


def line_fails(bare, most_marks: float, shortest_menu: int):
    """The rules on one trimmed line, as a column; a blank line passes."""
    size = F.length(bare)
    count = lambda chars: size - F.length(F.translate(bare, chars, ""))
    punctuation = ~F.lit(TERMINAL).contains(F.right(bare, F.lit(1))) | (count(MARKS) > most_marks * size)
    items = count(SEPARATORS)
    navigation = (items >= shortest_menu - 1) & (items * 25 > size) | bare.rlike(f"^(?i)({MENU})[.!:]?$")
    boilerplate = bare.rlike(f"(?i)({BOILERPLATE})")
    return (bare != "") & (punctuation | navigation | boilerplate)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query: one row for each row of docs."""
    return clean(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_removed_lines")
