"""Line dedup with levelled sorted runs of line hashes (DataFrame functions only).

A run is a table of (h1, h2, n_docs, last_doc), bucketed and sorted by hash: Spark knows how it lies, so a batch's join
doesn't shuffle it. Each batch of documents is reduced to such entries, merge-anti-joined with one run after the other
(an entry that can't change a decision any more is left out) and added as a run of level 0; when a level has
``fanout`` runs, they are merged into one of the next level.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.text import bring_back, set_aside
from paperloom.session import shared_folder, written

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; texts without other code points take the quick way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return F.btrim(ascii_lower(line), F.lit(BLANKS))


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2) of every line whose key has ``min_chars`` code points or more.

    Two independently seeded 64-bit hashes stand for a key, so different lines don't meet even among 10**12.
    """
    text = F.coalesce("text", F.lit(""))
    # The text's hash is taken before its lines are dealt out: beside them it would be taken anew for each.
    hashed = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    keyed = hashed.select("doc_id", "text_hash", F.posexplode(F.split(ascii_lower(F.col("text")), "\n")).alias("pos", "line"))
    key = F.btrim("line", F.lit(BLANKS))
    return keyed.select("doc_id", "text_hash", "pos", key.alias("key")).where(F.char_length("key") >= min_chars).select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineRuns:
    """A store of levelled runs: tables of the session's catalog whose files lie in its shared folder.

    All runs have as many buckets as the session had shuffle partitions when the store was made, so that a batch's
    entries, once shuffled by hash, meet each run in place.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 3, min_docs: int = 3, doc_id: str = "long"):
        self.spark, self.fanout, self.min_docs, self.doc_id = spark, fanout, min_docs, doc_id
        self.path = path or f"{shared_folder(spark)}/paperloom/{uuid.uuid4().hex}/runs"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def runs(self) -> list[str]:
        """The names of all runs; each has an entry for each hash it knows."""
        return [name for level in self.levels for name in level]

    def merged(self, names: list[str]) -> DataFrame:
        # As plain files: grouping a union of bucketed tables without a shuffle, Spark 4.1.2 split groups (measured).
        runs = self.spark.read.schema(f"h1 long, h2 long, n_docs long, last_doc {self.doc_id}").parquet(*(f"{self.path}/{name}" for name in names))
        return runs.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def _write(self, entries: DataFrame, level: int) -> None:
        name = f"line_run_{level}_{uuid.uuid4().hex}"
        # By hash into as many partitions as buckets: one file a bucket; entries that lie so already aren't shuffled again.
        entries = entries.select(*HASH, "n_docs", "last_doc").repartition(self.buckets, *HASH)
        entries.write.format("parquet").bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.path}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def news(self, lines: DataFrame) -> DataFrame:
        """The entries of a batch of lines (doc_id, text_hash, h1, h2) that may still change a decision."""
        entries = lines.groupBy("doc_id", "text_hash", *HASH).agg(F.lit(1).alias("one")).groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        last = F.col("e.last_doc")
        for name in self.runs():
            full = self.spark.table(name).where(F.col("n_docs") >= self.min_docs).hint("merge").alias("r")
            same = [F.col(f"e.{h}") == F.col(f"r.{h}") for h in HASH]
            entries = entries.alias("e").join(full, [*same, F.coalesce(F.col("r.last_doc") >= last, last.isNull())], "left_anti")
        return entries

    def add(self, lines: DataFrame) -> None:
        """Add a batch of lines; a document must not be split over batches."""
        self._write(self.news(lines), 0)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                names, self.levels[level] = self.levels[level], []
                self._write(self.merged(names), level + 1)
                self.forget(names)

    def repeated(self) -> DataFrame:
        """(h1, h2, keeper, n_docs) of the lines found in ``min_docs`` documents or more; n_docs may lack documents that decide nothing."""
        return self.merged(self.runs()).where(F.col("n_docs") >= self.min_docs).select(*HASH, F.col("last_doc").alias("keeper"), "n_docs")

    def forget(self, names: list[str] | None = None) -> None:
        """Take runs (all, if none are named) out of the catalog; their files stay."""
        for name in self.runs() if names is None else names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def with_keeper(lines: DataFrame, repeated: DataFrame, hottest: int = 8192) -> DataFrame:
    """The lines that are repeated, with their keeper.

    A line that is one copy in ``hottest`` or more is hot. There are at most ``hottest`` different ones, so these are
    broadcast, and no task gets all copies of one. The rest is joined by hash.
    """
    least = F.lit(-(-lines.count() // hottest))
    # Copies, not documents: a document may hold a line many times over.
    often = F.broadcast(lines.groupBy(*HASH).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*HASH))
    hot, rest = (written(repeated.drop("n_docs").join(often, HASH, how), "repeated_" + how) for how in ("left_semi", "left_anti"))
    return lines.join(F.broadcast(hot), HASH).unionByName(lines.join(F.broadcast(hot), HASH, "left_anti").join(rest, HASH))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Drop lines found in ``min_docs`` documents or more, except in the largest doc_id that holds them.

    Returns the columns of ``docs`` (any columns besides doc_id and text are carried; the names n_lines, n_dropped and
    kept_text are replaced if they clash) with n_lines, n_dropped and kept_text. Null or empty text: one empty line.
    Rows are documents: rows that repeat a doc_id with another text count apiece, identical rows (same doc_id and text)
    count once, and all rows with the largest doc_id keep a line. A null doc_id is never the keeper, unless all are
    null: then nothing is dropped. doc_id may be of any type that Spark orders. Texts are taken whole, in time and memory
    linear in their lines. An empty table gives an empty result.
    """
    new = ["n_lines", "n_dropped", "kept_text"]
    docs, names = set_aside(docs, ["doc_id", "text"], new)
    lines = written(lines_of(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "lines")
    store = LineRuns(docs.sparkSession, fanout=fanout, min_docs=min_docs, doc_id=docs.schema["doc_id"].dataType.simpleString())
    try:
        for batch in range(batches):
            store.add(lines.where(F.col("batch") == batch))
        repeated = written(store.repeated(), "repeated")
    finally:
        store.forget()
    found = with_keeper(lines, repeated)
    hits = found.where(~F.col("doc_id").eqNullSafe(F.col("keeper")) & F.col("keeper").isNotNull())
    dropped = hits.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("_dropped")).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "_dropped")
    text = F.coalesce("text", F.lit(""))
    joined = docs.withColumn("_text_hash", F.xxhash64(text)).join(dropped, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_hash")), "left")
    joined = joined.withColumn("_lines", F.split(text, "\n"))
    # Linear in the lines: positions are subtracted as sets, and an array of its own column is not split again for each.
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_dropped"), lambda i: F.element_at("_lines", i + 1))
    joined = joined.withColumns({
        "n_lines": F.size("_lines").cast("long"),
        "n_dropped": F.coalesce(F.size("_dropped"), F.lit(0)).cast("long"),
        "kept_text": F.when(F.col("_dropped").isNull(), text).otherwise(F.array_join(kept, "\n")),
    })
    return bring_back(joined, names, new)
