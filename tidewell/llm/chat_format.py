"""Quotation linking, with DataFrame expressions only.

Lines of messages carry quote levels (leading `>` signs). Quoted lines of one level that follow each
other form a passage. Passages are normalised (white space and line breaks folded), hashed and
joined to the messages of the conversation that said the same as a whole, as a paragraph or as a
line; of a passage nobody said as it is, the paragraphs are looked for, and then the lines. A message
replies to the message that most of its first-level quotes come from. Messages without quotes, in the order of
threads and turns, are the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import cut, redeal

QUOTE = "^(?:[ \\t]*>)+[ \\t]?"
INTRODUCTION = "(?i)^[ \\t]*(on\\b.{0,300}\\bwrote|.{0,100}\\bsaid):[ \\t]*$"
RUN, PARAGRAPH, LINE = 3, 2, 1


def folded(text: Column) -> Column:
    """Lower case, one space between words."""
    return F.btrim(F.regexp_replace(F.lower(text), "[\\x20\\x09-\\x0D]+", " "))


def _keys(text: Column) -> list[Column]:
    """A hash of 128 bits, as two columns."""
    return [F.xxhash64(text, F.lit(n)).alias(f"key{n}") for n in (1, 2)]


def content():
    """A message's text without quoted lines and the lines that introduce quotes, as a column over text."""
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    quoted = lambda x: x.rlike(QUOTE)
    own = F.filter(split, lambda x: ~quoted(x) & ~x.rlike(INTRODUCTION))
    return F.when(F.exists(split, quoted), F.btrim(F.array_join(own, "\n"), F.lit(" \t\n\r"))).otherwise(F.coalesce("text", F.lit("")))


def said(messages: DataFrame) -> DataFrame:
    """(conv_id, key1, key2, earliest, latest): who said each text of their own: as a whole, as a paragraph or as a line."""
    own = messages.select("conv_id", "turn", content().alias("own"))
    whole, parts, lines = F.array("own"), F.split("own", "\n[ \\t]*\n"), F.split("own", "\n")
    units = own.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(F.concat(whole, parts, lines), folded))).alias("unit"))
    return units.where("unit <> ''").select("conv_id", "turn", *_keys(F.col("unit"))).groupBy("conv_id", "key1", "key2").agg(F.min("turn").alias("earliest"), F.max("turn").alias("latest"))


def quoted(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, message, level, run, paragraph, kind, n_lines, key1, key2): what messages quote, by passage, by paragraph and by line."""
    quoting = messages.where(F.col("text").rlike("(?m)" + QUOTE)).select("conv_id", "turn", "text").distinct()
    lines = quoting.select("conv_id", "turn", F.xxhash64("text").alias("message"), F.posexplode(F.split("text", "\n")).alias("k", "raw"))
    marks = F.regexp_extract("raw", QUOTE, 0)
    level = F.length(marks) - F.length(F.translate(marks, ">", ""))
    lines = lines.withColumn("level", level).withColumn("line", folded(F.substr("raw", F.length(marks) + 1))).where("level > 0")
    inside = Window.partitionBy("conv_id", "turn", "message").orderBy("k")
    new = F.coalesce((F.col("level") != F.lag("level").over(inside)) | (F.col("k") != F.lag("k").over(inside) + 1), F.lit(True))
    lines = lines.withColumn("new", new)
    lines = lines.withColumn("run", F.sum(F.col("new").cast("int")).over(inside)).withColumn("paragraph", F.sum((F.col("new") | (F.col("line") == "")).cast("int")).over(inside))
    lines = lines.where("line <> ''")
    name = ["conv_id", "turn", "message", "level", "run"]
    together = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), " ")

    def unit(kind: int, by: list[str]) -> DataFrame:
        met = lines.groupBy(*by).agg(together.alias("unit"), F.count("*").alias("n_lines"))
        return met.select(*name, *(F.col(c) if c in by else F.lit(None).cast("long").alias(c) for c in ("paragraph", "k")), F.lit(kind).alias("kind"), "n_lines", *_keys(F.col("unit")))

    return unit(RUN, name).unionByName(unit(PARAGRAPH, [*name, "paragraph"])).unionByName(unit(LINE, [*name, "paragraph", "k"]))


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, n_quoted, n_linked) of the messages with quotes."""
    origin = said(messages)
    keys = ["conv_id", "key1", "key2"]
    met = quoted(messages).join(origin.repartition(F.xxhash64(*keys)), keys, "left")
    met = met.withColumn("found", F.coalesce(F.col("earliest") < F.col("turn"), F.lit(False)))
    message = ["conv_id", "turn", "message"]
    larger = lambda kind, *by: F.max((F.col("found") & (F.col("kind") == kind)).cast("int")).over(Window.partitionBy(*message, *by)) == 1
    met = met.withColumn("in_run", larger(RUN, "run")).withColumn("in_paragraph", larger(PARAGRAPH, "run", "paragraph") & F.col("paragraph").isNotNull())
    counts = F.col("found") & ((F.col("kind") == RUN) | ~F.col("in_run") & ((F.col("kind") == PARAGRAPH) | ~F.col("in_paragraph")))
    met = cut(met.withColumn("counts", counts))
    # one who said it is sure; of several, the first and (if before the quote) the last get lesser votes
    sources = F.array_distinct(F.array(F.col("earliest"), F.when(F.col("latest") < F.col("turn"), F.col("latest")).otherwise(F.col("earliest"))))
    votes = met.where("counts and level = 1").select("conv_id", "turn", F.explode(sources).alias("source"), "n_lines", (F.col("earliest") == F.col("latest")).alias("sure"))
    votes = votes.groupBy("conv_id", "turn", "source").agg(F.coalesce(F.sum(F.when(F.col("sure"), F.col("n_lines"))), F.lit(0)).alias("n_sure"), F.sum("n_lines").alias("n"))
    parents = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("n_sure", "n", "source"))["source"].alias("parent_turn"))
    numbers = met.groupBy("conv_id", "turn").agg(F.sum(F.when(F.col("kind") == LINE, 1).otherwise(0)).alias("n_quoted"), F.sum(F.when(F.col("counts"), F.col("n_lines")).otherwise(0)).alias("n_linked"))
    return numbers.join(parents, ["conv_id", "turn"], "left")


def threads(replies: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(conv_id, turn, thread_turn) of each message that replies, replies being (conv_id, turn, parent_turn) with parents of lower turns.

    Each round doubles the steps to an ancestor; rounds end when nobody's ancestor replies to another.
    """
    now = cut(replies.select("conv_id", "turn", F.col("parent_turn").alias("up")))
    for _ in range(most_rounds):
        # both sides are keyed by unique (conv_id, turn) on the right: a message with many replies can be split
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next")).repartition(F.xxhash64("conv_id", "up"))
        now = cut(now.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        if not now.where("moved").limit(1).count():
            return now.select("conv_id", "turn", F.col("up").alias("thread_turn"))
        now = now.drop("moved")
    raise RuntimeError(f"threads did not settle in {most_rounds} rounds")


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, thread_turn, turn, role, parent_turn, n_quoted, n_linked, content, formatted): one row for each row of messages.

    A quoted passage links to earlier messages of its conversation that have it, however wrapped, as
    all of their own text, as a paragraph or as a line; a passage without such a message links by its
    paragraphs, and these by their lines. Blank lines never link. parent_turn is the turn with most
    first-level quoted lines that only it said, then with most that it was the first or last to say, then the latest;
    without any, null. thread_turn is the first turn of the thread that replies form; a message that
    neither replies nor is replied to is a thread of its own, and sorting by conv_id, thread_turn, turn gives reply-ordered
    conversations. n_quoted counts non-blank quoted lines of all levels, n_linked those with a link. Rows
    that repeat (conv_id, turn) are one message to links (repeated texts count once) and keep their rows. A null conv_id or
    turn links with nothing. formatted is the message with its role's mark. Other columns are
    ignored; an empty table gives an empty result.
    """
    data = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    known = cut(links(data.where("conv_id is not null and turn is not null")))
    found = threads(known.where("parent_turn is not null"))
    known = known.join(found, ["conv_id", "turn"], "left").repartition(F.xxhash64("conv_id", "turn"))
    out = data.join(known, ["conv_id", "turn"], "left").withColumn("content", content())
    role = F.coalesce("role", F.lit("user"))
    return out.select(
        "conv_id",
        F.coalesce("thread_turn", "turn").alias("thread_turn"),
        "turn",
        "role",
        "parent_turn",
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "content",
        F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("content"), F.lit("\n")).alias("formatted"),
    )
