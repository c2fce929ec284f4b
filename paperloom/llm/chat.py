"""Chat formatting by quotation linking (DataFrame functions only).

Quote levels are the leading ``>`` of lines. Own text (level 0) is hashed as a whole and by passage, paragraph and
line; so is quoted text of each level, over the whole message and over each quote. Blank lines, with or without ``>``,
end a paragraph but not a passage or a quote. Each quoted line is linked by the largest text around it that a message
of the conversation wrote. A message replies to the latest earlier message that it quotes at its outermost level;
threads follow these replies up to their roots.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.line_dedup import ascii_lower
from paperloom.session import written

MARKS = r"^[ \t]*>[ \t>]*"
#: A text with quoted lines.
QUOTING = r"(?:^|\n)[ \t]*>"


def normalised(text: Column) -> Column:
    """Lower-case A-Z, runs of blanks as one space, none at the ends."""
    return F.btrim(F.regexp_replace(ascii_lower(text), r"[\x20\x09-\x0D]+", " "))


def quote_lines(text: Column) -> Column:
    """array<struct<level, body>> of the lines: the number of ``>`` before the text, and the text after them."""
    marks = lambda line: F.regexp_extract(line, MARKS, 0)
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.struct((F.char_length(marks(line)) - F.char_length(F.translate(marks(line), ">", ""))).alias("level"), F.regexp_replace(line, MARKS, "").alias("body")))


def lines_of(text: Column) -> Column:
    """array<struct<at, level, text>> of the lines that aren't blank: their place among all lines, and normalised text."""
    placed = F.transform(quote_lines(text), lambda x, i: F.struct(i.alias("at"), x["level"].alias("level"), normalised(x["body"]).alias("text")))
    return F.filter(placed, lambda x: x["text"] != "")


def cut(lines: Column, starts: Callable[[Column, Column], Column]) -> Column:
    """The lines as an array of arrays, cut before each line for which ``starts``(line before it, line) holds."""
    n = F.size(lines)
    first = F.filter(F.slice(F.sequence(F.lit(0), n), F.lit(1), n), lambda i: (i == 0) | starts(F.get(lines, i - 1), F.get(lines, i)))
    ends = F.concat(F.slice(first, F.lit(2), n), F.array(n))
    return F.transform(F.arrays_zip(first.alias("a"), ends.alias("b")), lambda s: F.slice(lines, s["a"] + 1, s["b"] - s["a"]))


def by_level(lines: Column) -> Column:
    return F.transform(F.array_distinct(F.transform(lines, lambda x: x["level"])), lambda v: F.filter(lines, lambda x: x["level"] == v))


def passages(lines: Column) -> Column:
    return cut(lines, lambda x, y: x["level"] != y["level"])


def joined(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["text"]), " ")


def units(lines: Column) -> Column:
    """array<struct<level, at, h1, h2>>: texts of one level, with the places of their lines: of the message, of each quote, passages, paragraphs and lines."""
    quotes = F.flatten(F.transform(cut(lines, lambda x, y: (x["level"] > 0) != (y["level"] > 0)), by_level))
    paragraphs = cut(lines, lambda x, y: (x["level"] != y["level"]) | (x["at"] + 1 != y["at"]))
    parts = F.concat(by_level(lines), quotes, passages(lines), paragraphs, F.transform(lines, lambda x: F.array(x)))
    return F.transform(parts, lambda p: F.struct(F.get(p, F.lit(0))["level"].alias("level"), F.transform(p, lambda x: x["at"]).alias("at"), *hashes(joined(p))))


def parsed(conversations: DataFrame) -> DataFrame:
    """The messages with body (without quotes) and n_quotes: the number of their distinct quoted passages."""
    quoting = F.col("text").rlike(QUOTING)
    own = F.filter(quote_lines(F.col("text")), lambda x: x["level"] == 0)
    body = F.when(quoting, F.array_join(F.transform(own, lambda x: x["body"]), "\n")).otherwise(F.coalesce("text", F.lit("")))
    rows = conversations.withColumn("_lines", F.when(quoting, lines_of(F.col("text"))))
    quoted = F.filter(passages(F.col("_lines")), lambda p: F.get(p, F.lit(0))["level"] > 0)
    texts = F.transform(quoted, lambda p: F.concat(F.get(p, F.lit(0))["level"].cast("string"), F.lit(" "), joined(p)))
    n = F.when(F.size("_lines") > 0, F.size(F.array_distinct(texts))).otherwise(0)
    return rows.withColumns({"body": F.btrim(body, F.lit(" \t\n\x0b\f\r")), "n_quotes": n.cast("long")}).drop("_lines")


def hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def exploded(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, message, n_own, level, at, h1, h2): a row for each text in ``units``; n_own counts a message's own lines."""
    rows = messages.select("conv_id", "turn", F.xxhash64("text").alias("message"), lines_of(F.col("text")).alias("_lines")).where(F.size("_lines") > 0)
    n_own = F.size(F.filter("_lines", lambda x: x["level"] == 0))
    return rows.select("conv_id", "turn", "message", n_own.alias("n_own"), F.explode(units(F.col("_lines"))).alias("u")).select("conv_id", "turn", "message", "n_own", "u.*")


def reply_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked) of the messages that quote an earlier one.

    The original of a text is the first message of the conversation whose whole own text it is, else the first that
    has it as a passage, paragraph or line: one row for each text, so that a text repeated any number of times joins
    each quotation once. Only conversations with quotes are hashed.
    """
    key = ["conv_id", "h1", "h2"]
    known = messages.select("conv_id", "turn", "text").where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quotes = written(exploded(known.where(F.col("text").rlike(QUOTING))).where("level > 0").drop("n_own").distinct(), "quotes")
    own = exploded(known.join(quotes.select("conv_id").distinct(), "conv_id", "left_semi")).where("level = 0")
    originals = own.groupBy(*key).agg(F.min(F.when(F.size("at") == F.col("n_own"), F.col("turn"))).alias("whole"), F.min("turn").alias("part"))
    original = F.coalesce(*(F.when(F.col(c) < F.col("turn"), F.col(c)) for c in ("whole", "part")))
    found = quotes.join(originals, key).withColumn("original", original).where("original is not null")
    # The texts around a line hold each other, so the longest is the largest.
    lines = found.select("conv_id", "turn", "message", "level", F.size("at").alias("n"), "original", F.explode("at").alias("line"))
    linked = lines.groupBy("conv_id", "turn", "message", "line").agg(F.max(F.struct("n", "level", "original")).alias("best")).select("conv_id", "turn", "best.*")
    best = F.max(F.struct((-F.col("level")).alias("depth"), F.col("original").alias("turn")))
    return linked.groupBy("conv_id", "turn").agg(best["turn"].alias("reply_to"), F.count_distinct("original").alias("n_linked"))


def thread_roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread): the first message of each reply chain, by rounds of pointer jumping; each round is written."""
    up = written(links.select("conv_id", "turn", F.col("reply_to").alias("thread")), "up")
    while True:
        above = up.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("further"))
        step = written(up.join(above, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("further", "thread").alias("thread"), F.col("further").isNotNull().alias("moved")), "up")
        up = step.select("conv_id", "turn", "thread")
        if step.where("moved").limit(1).count() == 0:
            return up


def format_chat(conversations: DataFrame) -> DataFrame:
    """A row for each message: conv_id, turn, role, thread, reply_to, n_quotes, n_linked, body and formatted.

    In the order of (conv_id, thread, turn) every conversation is reply-ordered: a message comes after the one that it
    answers and within its thread. thread is the turn of the thread's first message; without a link it is the message's
    own, and reply_to is null. n_quotes counts distinct quoted passages, n_linked distinct originals. Quoted text is
    linked down to whole lines; a part of a line is not. formatted is
    ``<|role|>`` and the text without quotes. Null text is empty; a null role is "user". A null turn or conv_id links
    nothing. Messages that repeat a turn share its links; each stays a row. Other columns are dropped. An empty table
    gives an empty result.
    """
    messages = parsed(conversations.select("conv_id", "turn", "role", "text"))
    links = written(reply_links(messages), "links")
    linked = links.join(thread_roots(links), ["conv_id", "turn"])
    out = messages.join(linked, ["conv_id", "turn"], "left")
    role = F.coalesce("role", F.lit("user"))
    return out.select("conv_id", "turn", "role", F.coalesce("thread", "turn").alias("thread"), "reply_to", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "body", F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("body")).alias("formatted"))


#: Turns of a thread that one task holds, as a power of two, and the text of a transcript's part.
CHUNK_BITS, PART_BYTES = 10, 1 << 20


def transcripts(messages: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The threads of ``format_chat`` as text: conv_id, thread, part, first_turn, last_turn, n_messages, transcript.

    The messages of a thread stand in the order of their turns, equal turns by their text. A thread of any length is
    given in parts, read in the order of ``part`` (numbers that grow along the thread, with gaps): a part ends with a
    chunk of 2 ** CHUNK_BITS turns, or where its messages pass ``part_bytes``, so it is longer than that by one message at
    most. Messages without conv_id or turn belong to no thread and are left out; messages that share a turn are ordered
    in one task.
    """
    rows = messages.where("conv_id is not null and turn is not null").select("conv_id", "thread", "turn", "formatted")
    rows = rows.withColumns({"_chunk": F.shiftright(F.col("turn").cast("long"), CHUNK_BITS), "_bytes": F.octet_length("formatted").cast("long"), "_hash": F.xxhash64("formatted")})
    before = Window.partitionBy("conv_id", "thread", "_chunk").orderBy("turn", "_hash", "formatted").rowsBetween(Window.unboundedPreceding, -1)
    part = F.shiftleft(F.col("_chunk"), 32) + F.floor(F.coalesce(F.sum("_bytes").over(before), F.lit(0)) / part_bytes).cast("long")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", "_hash", "formatted"))), lambda x: x["formatted"])
    return rows.withColumn("part", part).groupBy("conv_id", "thread", "part").agg(
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n_messages"), F.array_join(ordered, "\n").alias("transcript"),
    )
