"""URL filters: a blocked Bloom filter of listed keys passes possible hits to an exact hash join (DataFrame functions only).

A rule (host, path prefix, verdict) is listed by its text ``host + path``, a listed URL by its canonical form. A page's
URL has one key for each host suffix and path prefix that a rule could have, and its own canonical form. The filter
also holds each rule's text cut to the greatest power of two of path characters: with these few keys it is told where
pages are read which URLs may be listed. Only those are given all their keys; what passes the filter again is shuffled
and joined with the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.line_dedup import LOWER, UPPER
from paperloom.llm.text import bring_back, set_aside
from paperloom.session import written

#: 64-bit words of a block (256 bits, one bit of each word a key), and bits of the filter a key.
WORDS, BITS = 4, 16
#: A key or URL with one row in so many is hot: there are no more than that, so the hot ones are broadcast.
HOTTEST = 8192
#: Query parameters that only say where a reader came from.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|\\z)"
HOST_EXTRAS = "(?s)^(.*@)?(www[.])?|[.]?(:(80|443))?\\z"
PATH_EXTRAS = "/index[.]html?/*\\z"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host, path and query of a URL without what names the same page anew; null for a null URL or one without ``://``.

    Dropped: scheme, user, a leading ``www.`` and a final dot of the host, the ports 80 and 443, a final ``index.html``
    and final slashes of the path, the fragment, and tracking parameters. The other parameters are sorted.
    """
    host = F.regexp_replace(host_of(url), HOST_EXTRAS, "")
    path = F.rtrim(F.regexp_replace(path_of(url), PATH_EXTRAS, ""), F.lit("/"))
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(url, "(?s)^.*?://[^?#]*[?]([^#]*)", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.when(F.contains(url, F.lit("://")), F.rtrim(F.concat(host, path, F.lit("?"), F.array_join(kept, "&")), F.lit("?")))


def _suffix(host: Column, n: Column | int) -> Column:
    """The last ``n`` labels of a host; null if it has fewer."""
    parts = F.split(host, "[.]")
    return F.when(F.size(parts) >= n, F.array_join(F.slice(parts, F.size(parts) - n + 1, F.lit(n) if isinstance(n, int) else n), "."))


def _prefix(path: Column, n: int) -> Column:
    """The first ``n`` characters of a path; null if it has fewer."""
    return F.when(F.char_length(path) >= n, F.substring(path, 1, n))


def _coarse(length: Column) -> Column:
    """The greatest power of two that is not above; 0 for 0."""
    return F.when(length > 0, F.call_function("shiftleft", F.lit(1), F.char_length(F.bin(length)) - 1)).otherwise(0)


def _keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All keys under which rules may list a URL. Hosts and paths hold no ``?``; canonical forms get one in front."""
    suffixes = F.array_compact(F.transform(F.array(*map(F.lit, labels)), lambda n: _suffix(host, n)))
    prefixes = F.array_compact(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.when(F.char_length(path) >= n, F.substring(path, F.lit(1), n))))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """For each word of a block the one bit of a key: six bits of a second hash each."""
    second = F.xxhash64(F.lit(1), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


class BlockedBloom:
    """A Bloom filter whose keys set and test bits in one block of 256 bits each.

    It is built by one aggregation, written, and read as a scalar subquery, whose value Spark hands to every task.
    ``limit`` bounds its bytes. A list too long for ``BITS`` bits a key within that only passes more rows that are not
    listed; the exact join removes them.
    """

    def __init__(self, keys: DataFrame, count: int, limit: int):
        spark = keys.sparkSession
        self.blocks = max(1, min(-(-count * BITS // (64 * WORDS)), limit // (8 * WORDS)))
        words = [F.bit_or(bit).alias(f"w{i}") for i, bit in enumerate(_bits(F.col("key")))]
        filled = keys.groupBy(_block(F.col("key"), self.blocks).alias("block")).agg(*words)
        every = spark.range(self.blocks).select(F.col("id").cast("int").alias("block")).join(filled, "block", "left")
        row = F.struct("block", F.array(*(F.coalesce(f"w{i}", F.lit(0).cast("long")) for i in range(WORDS))).alias("words"))
        # One array of at most ``limit`` bytes.
        self.table = written(every.agg(F.flatten(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["words"])).alias("words")), "bloom")

    def tested(self, df: DataFrame, keys: dict[str, Column]) -> DataFrame:
        """``df`` with a column for each key, whether it may be listed: never false for one that is, null for null."""
        words = self.table.scalar()
        blocks = {f"_block_{name}": F.slice(words, _block(key, self.blocks) * WORDS + 1, F.lit(WORDS)) for name, key in keys.items()}
        held = {}
        for name, key in keys.items():
            held[name] = F.lit(True)
            for i, bit in enumerate(_bits(key)):
                held[name] &= F.col(f"_block_{name}")[i].bitwiseAND(bit) != 0
        return df.withColumns(blocks).withColumns(held).drop(*blocks)


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, filter_bytes: int = 16 << 20) -> DataFrame:
    """``pages`` with host, path, rule, is_listed and verdict.

    ``rules`` (host, path, verdict) fit their host and its subdomains where the URL's path starts with theirs; the rule
    of most characters wins, of equally long ones the longer host. ``listed`` (url) are blocked in any form that has
    the same canonical form, unless a rule decides; all other URLs are allowed.

    A null URL, or one without ``://``, has an empty host and path and is in no list; a rule of empty host and path fits
    it. Rows that repeat are judged apiece. Of rules that repeat with different verdicts ``block`` counts; null hosts,
    paths or verdicts make no rule. Other columns of ``pages`` are carried; clashing names are replaced. Empty tables
    give no rows, or no rules. URLs are taken whole, however long.
    """
    new = ["host", "path", "rule", "is_listed", "verdict"]
    pages, names = set_aside(pages, ["url"], new)
    known = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    entries = known.select(F.concat("host", "path").alias("key"), F.char_length("host").alias("host_length"), "verdict").unionByName(
        listed.select(F.concat(F.lit("?"), canonical(F.col("url"))).alias("key")).where("key is not null").distinct().select("key", F.lit(None).cast("int").alias("host_length"), F.lit("block").alias("verdict"))
    )
    # Two rules of the same text would be one host and path: a path starts with a slash or is empty, a host holds none.
    entries = written(entries.groupBy("key").agg(F.max("host_length").alias("host_length"), F.max("verdict").alias("verdict")), "listed_keys")
    # Bounded by the lengths of one URL, not by the number of rules.
    shapes = [tuple(r) for r in known.select(F.size(F.split("host", "[.]")), F.char_length("path")).distinct().collect()]
    labels, lengths = sorted({n for n, _ in shapes}), sorted({m for _, m in shapes})
    coarse = sorted({(n, 1 << m.bit_length() - 1 if m else 0) for n, m in shapes})
    cut = known.select(F.concat("host", F.substring(F.col("path"), F.lit(1), _coarse(F.char_length("path")))).alias("key"))
    bloom = BlockedBloom(entries.select("key").unionByName(cut), 2 * entries.count(), filter_bytes)

    judged = pages.withColumns({"host": host_of(F.coalesce("url", F.lit(""))), "path": path_of(F.coalesce("url", F.lit("")))})
    host, path, own = F.col("host"), F.col("path"), F.concat(F.lit("?"), canonical(F.col("url")))
    few = {f"_possible_{n}_{c}": F.concat(_suffix(host, n), _prefix(path, c)) for n, c in coarse}
    judged = bloom.tested(judged, {"_possible": own} | few)
    judged = judged.withColumn("_possible", F.coalesce(*(F.when(F.col(x), True) for x in ("_possible", *few)), F.lit(False))).drop(*few)
    clean = judged.where(~F.col("_possible")).withColumns({"rule": F.lit(None).cast("string"), "is_listed": F.lit(False), "verdict": F.lit("allow")})
    # A null URL is judged as an empty one.
    rest = judged.where("_possible").withColumn("_url", F.coalesce("url", F.lit("")))

    keys = F.array_compact(F.array(own))
    keys = F.concat(_keys(host, path, labels, lengths), keys) if labels else keys
    asked = bloom.tested(rest.select("_url", F.explode(keys).alias("key")), {"_held": F.col("key")}).where("_held")
    asked = written(asked.groupBy("_url", "key").agg(F.count("*").alias("n")), "possible_keys")
    total = asked.agg(F.sum("n")).first()[0] or 0
    least = F.lit(-(-total // HOTTEST))
    # The exact hash join: each key once on both sides.
    hits = written(asked.groupBy("key").agg(F.sum("n").alias("all_n")).join(entries, "key"), "listed_hits")
    hot = F.broadcast(hits.where(F.col("all_n") >= least))
    found = asked.join(hot, "key").unionByName(asked.join(hot.select("key"), "key", "left_anti").join(hits.where(F.col("all_n") < least), "key"))
    is_rule = F.col("host_length").isNotNull()
    best = F.max(F.when(is_rule, F.struct(F.char_length("key").alias("size"), "host_length", F.col("key").alias("rule"), "verdict")))
    decided = found.groupBy("_url").agg(best.alias("_best"), F.bool_or(~is_rule).alias("is_listed"), F.max("n").alias("_n"))
    decided = written(decided.select("_url", F.col("_best.rule").alias("rule"), "is_listed", F.coalesce("_best.verdict", F.lit("block")).alias("verdict"), "_n"), "decided_urls")
    hot_urls, other = F.broadcast(decided.where(F.col("_n") >= least).drop("_n")), decided.where(F.col("_n") < least).drop("_n")
    late = rest.join(hot_urls, "_url").unionByName(rest.join(hot_urls.select("_url"), "_url", "left_anti").join(other, "_url", "left"))
    late = late.withColumns({"is_listed": F.coalesce("is_listed", F.lit(False)), "verdict": F.coalesce("verdict", F.lit("allow"))})
    return bring_back(clean.unionByName(late.drop("_url")), names, new)
