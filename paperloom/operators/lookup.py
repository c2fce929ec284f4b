"""Keyed lookups as joins: relationships, media, formula cache, image names, selections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from paperloom.functions.text import basename, is_web_image, prefixed, unprefixed
from paperloom.operators.small import few
from paperloom.session import written


def resolve_relationships(references: DataFrame, relationships: DataFrame) -> DataFrame:
    """Image references (file_id, rel_id, ...) with target and original_filename; a reference without a target is no image."""
    return references.join(relationships.select("file_id", "rel_id", "target"), ["file_id", "rel_id"]).withColumn("original_filename", basename(F.col("target")))


def resolve_media(images: DataFrame, media: DataFrame) -> DataFrame:
    """``images`` (file_id, original_filename, ...) with filename: the stored name, else the original one."""
    stored = media.groupBy("file_id", "original_filename").agg(F.max("filename").alias("_stored"))
    return images.join(stored, ["file_id", "original_filename"], "left").withColumn("filename", F.coalesce("_stored", "original_filename")).drop("_stored")


def merged_media(media: DataFrame, previews: DataFrame) -> DataFrame:
    """Union of media and OLE previews by original name; a preview replaces a medium of the same name."""
    both = media.withColumn("_rank", F.lit(0)).unionByName(previews.withColumn("_rank", F.lit(1)))
    rest = [c for c in media.columns if c not in ("file_id", "original_filename")]
    return both.groupBy("file_id", "original_filename").agg(F.max_by(F.struct(*rest), "_rank").alias("m")).select("file_id", "original_filename", "m.*").select(*media.columns)


def _power(n: Column) -> Column:
    """The exponent of the greatest power of two that is ``n`` at most."""
    return F.char_length(F.bin(n)) - 1


def _power_of_two(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), k)


def _grams(name: Column) -> Column:
    """The distinct substrings of ``name`` of 1, 2, 4, 8, ... characters."""
    n = F.char_length(name)
    at = lambda k: F.transform(F.sequence(F.lit(1), n - _power_of_two(k) + 1), lambda i: F.substring(name, i, _power_of_two(k)))
    return F.when(n > 0, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), _power(n)), at))))


def distinct_names(references: DataFrame, key: str, name: str, *order: str) -> DataFrame:
    """(key, names): each key's distinct names by their first place in ``order``. Null names are left out.

    Repeats go before anything is collected, so a list is as long as the key has different names.
    """
    first = references.where(F.col(name).isNotNull()).groupBy(key, name).agg(F.min(F.struct(*order)).alias("_first"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_first", name))), lambda x: x[name])
    return first.groupBy(key).agg(listed.alias("names"))


def match_images(formulas: DataFrame, media: DataFrame) -> DataFrame:
    """``formulas`` (file_id, image_ref, ...) with image_filename: the first medium of the file that is, or contains, the reference.

    An exact name comes first, then the smallest. An index holds each name's substrings of 1, 2, 4, 8, ... characters.
    The greatest power of two within a reference's length gives the two grams it starts and ends with, which cover it.
    A reference that is such a gram itself is answered by the smallest name of its entry; any other one meets the names
    under the rarer of the two, and each is verified. The index is joined by merge: it is much larger than the names, in
    memory above all, so it isn't left to Spark to broadcast it. Distinct references are matched once. A null or empty reference
    names nothing; repeated and null names do no harm.
    """
    refs = formulas.where("image_ref <> '' and file_id is not null").select("file_id", "image_ref").distinct()
    names = media.where("filename is not null").select("file_id", F.col("filename").alias("image_filename")).distinct()
    index = names.select("file_id", "image_filename", F.explode(_grams(F.col("image_filename"))).alias("gram"))
    entries = index.groupBy("file_id", "gram").agg(F.count("*").alias("names"), F.min("image_filename").alias("smallest"))
    ref, n = F.col("image_ref"), F.char_length("image_ref")
    size = _power_of_two(_power(n))
    probes = refs.select("file_id", "image_ref", (size == n).alias("whole"), F.explode(F.array_distinct(F.array(F.substring(ref, F.lit(1), size), F.substring(ref, n - size + 1, size)))).alias("gram"))
    met = probes.join(entries.hint("merge"), ["file_id", "gram"]).groupBy("file_id", "image_ref", "whole").agg(F.min(F.struct("names", "gram", "smallest")).alias("e"))
    met = met.select("file_id", "image_ref", "whole", "e.gram", "e.smallest")
    hit = met.where(~F.col("whole")).join(index.hint("merge"), ["file_id", "gram"]).where(F.contains("image_filename", "image_ref"))
    longer = hit.groupBy("file_id", "image_ref").agg(F.min("image_filename").alias("image_filename"))
    first = met.where("whole").select("file_id", "image_ref", F.col("smallest").alias("image_filename")).unionByName(longer)
    exact = names.select("file_id", F.col("image_filename").alias("image_ref"), F.lit(True).alias("_exact"))
    best = first.join(exact, ["file_id", "image_ref"], "left").withColumn("image_filename", F.when(F.col("_exact"), F.col("image_ref")).otherwise(F.col("image_filename")))
    return formulas.join(best.drop("_exact"), ["file_id", "image_ref"], "left")


def unreferenced(media: DataFrame, formulas: DataFrame) -> DataFrame:
    """Web images that no formula refers to."""
    used = formulas.where("image_filename is not null").select("file_id", F.col("image_filename").alias("filename")).distinct()
    return media.where(is_web_image(F.col("filename"))).join(used, ["file_id", "filename"], "left_anti")


def cached_formulas(formulas: DataFrame, cache: DataFrame) -> DataFrame:
    """``formulas`` (hash, ...) with status and cached: entries whose path still exists count (column exists of ``cache``)."""
    held = cache.where("exists").groupBy("hash").agg(F.min("path").alias("cache_path"))
    out = formulas.join(held, "hash", "left")
    hit = F.col("cache_path").isNotNull()
    return out.withColumns({"cached": hit, "status": F.when(hit, "cached").otherwise("source_only")})


def resolve_names(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """``requests`` (file_id, name) with path, by the first kind of name that is stored (file_id, name, path).

    In order: the name itself, with the file's prefix, without it, then either at the end of any stored path. Both joins
    are by merge: five candidates a request are much larger than the files they come from, by whose size Spark would
    pass them whole through the driver.
    """
    asked = requests.select("file_id", "name").distinct()
    name, file_id = F.col("name"), F.col("file_id")
    keys = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(deep).alias("deep"), k.alias("key")) for i, (deep, k) in enumerate([(False, name), (False, prefixed(name, file_id)), (False, unprefixed(name, file_id)), (True, name), (True, unprefixed(name, file_id))])])
    candidates = asked.select("file_id", "name", F.inline(keys))
    held = stored.select("file_id", F.inline(F.array(F.struct(F.lit(False).alias("deep"), F.col("name").alias("key"), "path"), F.struct(F.lit(True).alias("deep"), basename(F.col("path")).alias("key"), "path"))))
    found = candidates.join(held.hint("merge"), ["file_id", "deep", "key"]).groupBy("file_id", "name").agg(F.min(F.struct("rank", "path")).alias("b"))
    best = found.select("file_id", "name", F.col("b.path").alias("path"), F.col("b.rank").alias("rank"))
    return requests.join(best.hint("merge"), ["file_id", "name"], "left")


def export_name(name: Column) -> Column:
    """Candidate names of an image to export, in order: as is, below media/, without media/."""
    return F.array_distinct(F.array(name, F.concat(F.lit("media/"), name), F.regexp_replace(name, "^media/", "")))


@pandas_udf(StringType())
def _replaced(texts: pd.Series, words: pd.Series, values: pd.Series) -> pd.Series:
    """``texts`` with words replaced in one pass from the left, the longest word at each place; what is put in isn't read again."""
    import ahocorasick

    def scanner(row) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for word, value in zip(*row, strict=True):
            made.add_word(word, (len(word), value))
        made.make_automaton()
        return made

    out, held, scan = [], None, None
    for text, *row in zip(texts, words, values, strict=True):
        if not text or row[0] is None or not len(row[0]):
            out.append(text)
            continue
        key = [list(x) for x in row]
        if key != held:
            held, scan = key, scanner(key)
        longest: dict[int, tuple[int, str]] = {}
        for end, (size, value) in scan.iter(text):
            # Words found later at a place end later, so they are longer.
            longest[end + 1 - size] = size, value
        pieces, at = [], 0
        for start in sorted(longest):
            if start >= at:
                size, value = longest[start]
                pieces += [text[at:start], value]
                at = start + size
        out.append("".join(pieces) + text[at:])
    return pd.Series(out, dtype=object)


def rewrite_paths(pages: DataFrame, media: DataFrame) -> DataFrame:
    """``pages`` (file_id, html) with every path of the file's media (file_id, path, url) replaced by its URL.

    One pass of an automaton over each page: at each place the longest path counts, and URLs put in are not searched
    again, whatever paths they hold. Null or empty paths and null URLs are left out; of repeated paths the smallest URL
    counts. A page takes its file's paths along, so these fit in a task; pages of a null file_id stay as they are.
    """
    named = media.where("file_id is not null and path <> '' and url is not null").groupBy("file_id", "path").agg(F.min("url").alias("url"))
    pairs = named.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("path", "url"))).alias("_pairs"))
    html = F.when(F.col("_pairs").isNotNull(), _replaced(F.col("html"), F.col("_pairs.path"), F.col("_pairs.url"))).otherwise(F.col("html"))
    return pages.join(pairs, "file_id", "left").withColumn("html", html).drop("_pairs")


def selected(questions: DataFrame, ids: DataFrame) -> DataFrame:
    """The questions whose (file_id, id) is in ``ids``; an empty selection is an error."""
    checked = written(ids.select("file_id", "id").distinct(), "selected_ids")
    if checked.limit(1).count() == 0:
        raise ValueError("no question is selected")
    return questions.join(few(checked), ["file_id", "id"], "left_semi")


def not_selected(questions: DataFrame, ids: DataFrame) -> DataFrame:
    return questions.join(ids.select("file_id", "id").distinct(), ["file_id", "id"], "left_anti")
