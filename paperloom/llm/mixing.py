"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Each document draws the exponential key -ln(u) / weight, u from a hash of its id, so reruns agree. A source's target
is met by complete epochs, then by its documents of smallest key up to the rest of the budget. Prefix sums run over
groups of key buckets per source, then over the buckets of the group in which its budget ends; only the one bucket
in which it ends is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.text import bring_back, set_aside
from paperloom.session import written

#: Columns that the mix adds.
NEW = ["size", "source_size", "target", "copies", "taken"]
#: Weights of the sources in order, repeating.
CYCLE = (3.0, 1.0, 2.0)
BUCKETS, GROUP = 1 << 14, 1 << 7


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def quality_weight(text: Column) -> Column:
    """Quality of a document: 0.05 to 1, the share of characters that aren't symbols, squared."""
    plain = F.char_length(F.translate(text, "#$%&*|<>{}[]=_~^\\@+!", "")) / F.nullif(F.char_length(text), F.lit(0))
    return F.greatest(F.lit(0.05), F.coalesce(plain * plain, F.lit(1.0)))


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """(source, source_size) with target: ``share`` times all sizes, dealt by weight, ``most`` times a source's size at most.

    The excess of capped sources goes to the others by weight until none is above: in the order of cap / weight, the
    first source whose cap isn't reached fixes the level (target per weight) of itself and all that follow.
    """
    weight = F.element_at(F.lit(list(cycle)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(cycle))) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    ranked = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    onward = ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumns({"total": share * F.sum("source_size").over(everything), "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "open_w": F.sum("w").over(onward)})
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_w")).withColumn("level", F.when(F.col("level") * F.col("w") < F.col("cap"), F.col("level")))
    level = F.min("level").over(everything)
    first = F.first("level", ignorenulls=True).over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return s.withColumn("target", F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", first * F.col("w")))).select("source", "source_size", "target")


def keyed(docs: DataFrame, seed: int, weight: Column | None) -> DataFrame:
    """``docs`` with size, _key and _bucket."""
    chosen = weight if weight is not None else quality_weight(F.col("text"))
    key = -F.log(uniform(F.col("doc_id"), seed)) / F.greatest(F.lit(1e-6), F.coalesce(chosen, F.lit(1.0)))
    sized = docs.withColumns({"size": word_count(F.col("text")), "_key": F.struct(key.alias("key"), "doc_id", F.xxhash64("text").alias("hash"))})
    # 1 - exp(-key) is in the order of the keys, and even over (0, 1) where weights are equal.
    return sized.withColumn("_bucket", F.floor((1 - F.exp(-F.col("_key.key"))) * BUCKETS).cast("int"))


def ending(sums: DataFrame, by: str) -> DataFrame:
    """The row of each source, in the order of ``by``, whose words reach ``rest``; so_far becomes the words before it."""
    below = Window.partitionBy("_source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("so_far", F.col("so_far") + F.coalesce(F.sum("words").over(below), F.lit(0)))
    return sums.where((F.col("so_far") < F.col("rest")) & (F.col("so_far") + F.col("words") >= F.col("rest")))


def mix_plan(sized: DataFrame, share: float, most: float, cycle: tuple[float, ...]) -> DataFrame:
    """A row per source: source_size, target, epochs, and the bucket and key at which its last, partial epoch ends."""
    buckets = written(sized.groupBy("source", "_bucket").agg(F.sum("size").alias("words")), "buckets")
    targets = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), share, most, cycle)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    targets = written(targets.withColumnRenamed("source", "_source"), "targets")
    # Where the budget ends: first the group of buckets, then the bucket in it, so that no task orders all of a source's.
    group = F.floor(F.col("_bucket") / GROUP).cast("int")
    groups = buckets.groupBy("source", group.alias("_group")).agg(F.sum("words").alias("words"))
    groups = groups.join(few(targets), F.col("source").eqNullSafe(F.col("_source"))).withColumn("so_far", F.lit(0))
    groups = few(written(ending(groups, "_group").select("_source", "_group", "so_far", "rest"), "groups"))
    ends = buckets.join(groups, F.col("source").eqNullSafe(F.col("_source")) & (group == F.col("_group")))
    ends = written(ending(ends, "_bucket").select("_source", F.col("_bucket").alias("end_bucket"), F.col("so_far").alias("words_before"), "rest"), "ends")
    # Only the rows of these buckets are ordered one by one.
    edge = sized.select("source", "_bucket", "_key", "size").join(few(ends), F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("end_bucket")))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("_source").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = edge.withColumn("before", before + F.col("words_before")).where(F.col("before") + F.col("size") / 2 <= F.col("rest")).groupBy("_source").agg(F.max("_key").alias("cut"))
    t, e, c = targets.alias("t"), ends.drop("words_before", "rest").alias("e"), cuts.alias("c")
    same = lambda x: F.col("t._source").eqNullSafe(F.col(f"{x}._source"))
    plan = t.join(e, same("e"), "left").join(c, same("c"), "left")
    return written(plan.select("t._source", "source_size", "target", "epochs", F.coalesce("end_bucket", F.lit(-1)).alias("end_bucket"), "cut"), "plan")


def few(table: DataFrame, limit: int = 50_000) -> DataFrame:
    """Marked for broadcast if it has ``limit`` rows at most; else Spark joins it as it sees fit."""
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, cycle: tuple[float, ...] = CYCLE, seed: int = 42, weight: Column | None = None) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (words taken, repeats counted).

    A document is taken once per complete epoch of its source, and once more if the middle of its words in key order
    comes before the end of the remaining budget. Null source is a source of its own, the last. Documents without words
    have size 0 and take no words (copies has their epochs). Rows that repeat an id are told apart by their text;
    rows with the same id and text are taken together. ``weight`` (positive; null counts as 1) replaces the quality of
    the text. Clashing column names are replaced; an empty table gives an empty result.
    """
    docs, names, own = _own_columns(docs, weight)
    sized = written(keyed(docs, seed, own).select("doc_id", "source", "size", "_key", "_bucket"), "sized")
    plan = mix_plan(sized, share, most, cycle)
    return bring_back(_taken(keyed(docs, seed, own), plan), names, NEW)


def mix_counts(docs: DataFrame, share: float = 1.5, most: float = 2.0, cycle: tuple[float, ...] = CYCLE, seed: int = 42, weight: Column | None = None) -> DataFrame:
    """(doc_id, source) and the new columns of ``mix`` for every row of ``docs``: the same decisions, but texts are read once."""
    docs, _, own = _own_columns(docs, weight)
    sized = written(keyed(docs, seed, own).select("doc_id", "source", "size", "_key", "_bucket"), "sized")
    return _taken(sized, mix_plan(sized, share, most, cycle)).select("doc_id", "source", *NEW)


def _own_columns(docs: DataFrame, weight: Column | None) -> tuple[DataFrame, dict[str, str], Column | None]:
    """``docs`` with other columns set aside, their names, and the weight as a column of its own."""
    if weight is None:
        return *set_aside(docs, ["doc_id", "text", "source"], NEW), None
    name = "_weight"
    while name in docs.columns:
        name += "_"
    docs, names = set_aside(docs.withColumn(name, weight.cast("double")), ["doc_id", "text", "source", name], NEW)
    names.pop(name)
    return docs, names, F.col(name)


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    joined = rows.join(few(plan), F.col("source").eqNullSafe(F.col("_source")), "left")
    last = (F.col("_bucket") < F.col("end_bucket")) | ((F.col("_bucket") == F.col("end_bucket")) & F.coalesce(F.col("_key") <= F.col("cut"), F.lit(False)))
    return joined.withColumn("copies", (F.col("epochs") + last.cast("int")).cast("int")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``; edge cases as in ``mix``."""
    docs, names = set_aside(docs, ["doc_id", "text", "source"])
    return bring_back(mix(docs, **options).withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))), names)
