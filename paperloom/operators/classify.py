"""What each line of a paper is, as far as the line alone tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import patterns as P
from paperloom.functions.text import digits, strip


def _captured(line: Column, patterns: tuple[str, ...]) -> Column:
    """What the first of ``patterns`` that matches captures, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(line, P.FLAGS + p, 1), F.lit("")) for p in patterns])


def header_word(line: Column, legacy: bool = False) -> Column:
    """The type word of a section header, else null."""
    return _captured(line, P.LEGACY_HEADERS) if legacy else F.nullif(F.regexp_extract(line, P.HEADER, 1), F.lit(""))


def header_type(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in P.HEADER_TYPES.items() for x in pair])
    return F.element_at(table, word)


def first_capture(line: Column, leads: tuple[str, ...]) -> Column:
    """The stripped text after the first of ``leads`` that matches, else null."""
    out = F.lit(None).cast("string")
    for start in reversed(leads):
        out = F.when(F.regexp_like(line, F.lit(P.lead(start))), strip(F.regexp_extract(line, P.lead(start), 1))).otherwise(out)
    return out


def answer_text(line: Column) -> Column:
    return first_capture(line, P.ANSWER_LEADS)


def analysis_text(line: Column) -> Column:
    return first_capture(line, P.ANALYSIS_LEADS)


def score_value(line: Column) -> Column:
    """Points named by the first score pattern that matches, else null."""
    return digits(_captured(line, P.SCORES)).cast("double")


def question_number(line: Column, legacy: bool = False) -> Column:
    return digits(_captured(line, P.LEGACY_NUMBERS) if legacy else F.nullif(F.regexp_extract(line, P.NUMBER, 1), F.lit("")))


def after_number(line: Column, legacy: bool = False) -> Column:
    """The stripped line without its question number."""
    out = F.regexp_replace(line, P.NUMBER, "")
    if legacy:
        out = line
        for p in reversed(P.LEGACY_NUMBERS):
            out = F.when(F.regexp_like(line, F.lit(P.FLAGS + p)), F.regexp_replace(line, P.FLAGS + p, "")).otherwise(out)
    return strip(out)


def has_content(items: Column) -> Column:
    return F.coalesce(F.exists(items, lambda x: x["type"].isin("image", "latex", "latex_block")), F.lit(False))


def classify(lines: DataFrame, legacy: bool = False) -> DataFrame:
    """``lines`` (file_id, pos, text, optionally content_items) with line and flag.

    flag: blank, header, marker, answer, analysis, or text for lines that no rule takes by themselves; these also have
    score (points named) and number (of a question), either of which may be null. Rules are tried in this order.
    ``legacy``: headers and numbers of older papers, which know no markers.
    """
    content = has_content(F.col("content_items")) if "content_items" in lines.columns else F.lit(False)
    line = F.col("line")
    out = lines.withColumn("line", strip(F.coalesce("text", F.lit(""))))
    out = out.withColumn("header_word", header_word(line, legacy)).withColumn("answer_text", answer_text(line)).withColumn("analysis_text", analysis_text(line))
    flag = (
        F.when((line == "") & ~content, "blank")
        .when(F.col("header_word").isNotNull(), "header")
        .when(F.lit(False) if legacy else F.regexp_like(line, F.lit(P.MARKER)), "marker")
        .when(F.col("answer_text").isNotNull(), "answer")
        .when(F.col("analysis_text").isNotNull(), "analysis")
        .otherwise("text")
    )
    out = out.withColumn("flag", flag)
    free = F.col("flag") == "text"
    return out.withColumns({"score": F.when(free, score_value(line)), "number": F.when(free, question_number(line, legacy))})
