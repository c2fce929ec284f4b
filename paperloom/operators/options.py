"""Answer options in a line of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import patterns as P
from paperloom.functions.text import strip

#: Put before each option label, so that a split gives remainder and options.
MARK = "\u0001"


def pieces(text: Column) -> Column:
    return F.split(F.regexp_replace(text, P.OPTION, MARK + "$0"), MARK)


def remainder(text: Column) -> Column:
    """The text before the first option; all of it where there is none."""
    return F.when(F.size(pieces(text)) > 1, strip(F.get(pieces(text), F.lit(0)))).otherwise(text)


def split_options(text: Column) -> Column:
    """array<struct<label, content>> of the options, empty without any."""
    own = F.slice(pieces(text), 2, F.greatest(F.size(pieces(text)) - 1, F.lit(0)))
    return F.transform(own, lambda x: F.struct(F.regexp_extract(x, "^" + P.OPTION, 1).alias("label"), strip(F.regexp_replace(x, P.FLAGS + "^" + P.OPTION.removeprefix(P.FLAGS), "")).alias("content")))


def is_latex(content: Column, images: Column | None = None) -> Column:
    plain = F.contains(content, F.lit("$")) | F.contains(content, F.lit("\\"))
    return plain | (F.size(images) > 0) if images is not None else plain


def option_images(items: Column) -> Column:
    """map<label, array<file name>>: images go to the option whose label was last seen in a text item before them."""
    def step(acc: Column, x: Column) -> Column:
        found = F.nullif(F.regexp_extract(x["text"], P.OPTION, 1), F.lit(""))
        label = F.when(x["type"] == "text", F.coalesce(found, acc["label"])).otherwise(acc["label"])
        name = F.when(x["type"] == "image", x["image"]["filename"])
        pairs = F.when(name.isNotNull() & acc["label"].isNotNull(), F.array_append(acc["pairs"], F.struct(acc["label"].alias("label"), name.alias("name")))).otherwise(acc["pairs"])
        return F.struct(label.alias("label"), pairs.alias("pairs"))

    start = F.struct(F.lit(None).cast("string").alias("label"), F.array().cast("array<struct<label: string, name: string>>").alias("pairs"))
    pairs = F.aggregate(items, start, step, lambda acc: acc["pairs"])
    labels = F.array_distinct(F.transform(pairs, lambda p: p["label"]))
    return F.map_from_arrays(labels, F.transform(labels, lambda k: F.transform(F.filter(pairs, lambda p: p["label"] == k), lambda p: p["name"])))


def option_pairs(options: Column) -> Column:
    """array<array<option>>: two options a line."""
    lines = F.sequence(F.lit(0), F.floor((F.size(options) - 1) / 2).cast("int"))
    return F.when(F.size(options) > 0, F.transform(lines, lambda i: F.slice(options, 2 * i + 1, 2))).otherwise(F.array())


def legacy_options(text: Column) -> Column:
    """Older rule: options count only where there are two or more."""
    return F.when(F.size(split_options(text)) >= 2, split_options(text)).otherwise(F.array().cast("array<struct<label: string, content: string>>"))


def continued_options(lines: DataFrame) -> DataFrame:
    """Older rule, for ordered lines (file_id, pos, text): (file_id, pos, options) of each line that holds options.

    The last option of a line goes on over the lines after it that hold none, set apart by a blank; an option without
    any content is left out. Null texts are empty; lines before a file's first option belong to none.
    """
    text = F.coalesce("text", F.lit(""))
    own = lines.select("file_id", "pos", text.alias("text"), split_options(text).alias("own")).withColumn("has", F.size("own") > 0)
    order = Window.partitionBy("file_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("at", F.last(F.when(F.col("has"), F.col("pos")), ignorenulls=True).over(order)).where("at is not null")
    rest = F.array_sort(F.collect_list(F.when(~F.col("has") & (strip(F.col("text")) != ""), F.struct("pos", strip(F.col("text")).alias("line")))))
    held = own.groupBy("file_id", "at").agg(F.max_by("own", "has").alias("own"), F.transform(rest, lambda x: x["line"]).alias("more"))
    last = F.element_at("own", -1)
    whole = F.concat(F.slice("own", 1, F.size("own") - 1), F.array(F.struct(last["label"].alias("label"), strip(F.array_join(F.concat(F.array(last["content"]), F.col("more")), " ")).alias("content"))))
    return held.select("file_id", F.col("at").alias("pos"), F.filter(whole, lambda o: o["content"] != "").alias("options"))
