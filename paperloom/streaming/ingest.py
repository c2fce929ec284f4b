"""Uploaded papers as a table that is kept current: a stream of packages, and a keyed upsert that may be repeated.

Below the table's folder ``questions/<key>`` and ``papers/<key>`` hold what one batch brought; a batch counts once
``papers/<key>`` is complete, which is written last. Nothing is changed in place: readers take each paper's newest upload.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.functions.text import basename
from paperloom.operators.segment import split_questions
from paperloom.operators.small import few
from paperloom.session import written
from paperloom.sources.docx import paragraphs, raw_paragraphs, read_parts, stored_id

FILES = "path string, modificationTime timestamp, length long, content binary"
#: An upload of a paper; of several, that with the greatest (modified, path) is the newest.
UPLOAD = ["file_id", "modified", "path"]
Parse = Callable[[DataFrame], tuple[DataFrame, DataFrame | None]]


def uploads(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The stream of packages stored as <id>_<name>.docx below ``folder``: (file_id, modified, path, content)."""
    files = spark.readStream.format("binaryFile").schema(FILES).options(pathGlobFilter="*.docx", recursiveFileLookup="true", maxFilesPerTrigger=files_per_batch).load(folder)
    return files.select(stored_id(basename(F.col("path"))).alias("file_id"), F.col("modificationTime").alias("modified"), "path", "content")


def parse_packages(newest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The questions of packages, and (file_id, error) of those that can't be read."""
    parts = written(read_parts(newest), "parts")
    failures = parts.unionByName(raw_paragraphs(parts), allowMissingColumns=True).where("error is not null")
    return split_questions(paragraphs(parts)), failures.select("file_id", "error")


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The complete folders in ``path``; one name for each batch since the last compaction, at most a few thousand."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(n for n in names if fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS")))


def _state(spark: SparkSession, table: str) -> tuple[str | None, dict[str, int], list[str]]:
    """The last compaction, the last batch of each stream that is in it, and the complete batches that are not."""
    names = _folders(spark, f"{table}/papers")
    base = max((n for n in names if n.startswith("base-")), default=None)
    covered = {} if base is None else {r["stream"]: r["batch"] for r in spark.read.parquet(f"{table}/covers/{base}").collect()}
    return base, covered, [n for n in names if n.startswith("batch-") and not _number(n) <= covered.get(_stream(n), -1)]


def _key(stream: str, batch: int) -> str:
    return f"batch-{stream}-{batch:012}"


def _number(key: str) -> int:
    return int(key.rpartition("-")[2])


def _stream(key: str) -> str:
    return key.removeprefix("batch-").rpartition("-")[0]


def _of(rows: DataFrame, held: DataFrame) -> DataFrame:
    """The rows whose upload is in ``held``."""
    held = held.select(*[F.col(c).alias(f"_{c}") for c in UPLOAD])
    return rows.join(held, (F.col("file_id") == F.col("_file_id")) & (F.col("modified") == F.col("_modified")) & F.col("path").eqNullSafe(F.col("_path")), "left_semi")


def store_batch(table: str, stream: str, batch: int, found: DataFrame, parse: Parse) -> bool:
    """Add the uploads of one batch; False, with nothing done, if that batch of that stream is complete already.

    ``found`` has the columns of UPLOAD, and those that ``parse`` needs. Rows without file_id or modified are left out, of
    several uploads of one paper the newest stays. Batches of a stream are numbered upwards; a batch that failed before
    it was complete is written anew. An upload without questions takes a paper's questions away, one that can't be
    read doesn't.
    """
    spark = found.sparkSession
    key, (_, covered, open_) = _key(stream, batch), _state(spark, table)
    if batch <= covered.get(stream, -1) or key in open_:
        return False
    found = found.where("file_id is not null and modified is not null")
    last = found.groupBy("file_id").agg(F.max(F.struct("modified", "path")).alias("_u")).select("file_id", "_u.*")
    newest = _of(found, last).dropDuplicates(["file_id"])
    questions, failures = parse(newest)
    questions.join(last, "file_id").write.mode("overwrite").parquet(f"{table}/questions/{key}")
    counts = spark.read.parquet(f"{table}/questions/{key}").groupBy("file_id").agg(F.count("*").alias("n_questions"))
    papers = last.join(counts, "file_id", "left").withColumn("n_questions", F.coalesce("n_questions", F.lit(0)))
    errors = spark.createDataFrame([], "file_id string, error string") if failures is None else failures.groupBy("file_id").agg(F.min("error").alias("error"))
    papers = papers.join(errors, "file_id", "left").withColumn("status", F.when(F.col("error").isNull(), "completed").otherwise("error"))
    papers.write.mode("overwrite").parquet(f"{table}/papers/{key}")
    return True


def _all(spark: SparkSession, table: str, kind: str) -> DataFrame:
    base, _, open_ = _state(spark, table)
    keys = ([base] if base else []) + open_
    if not keys:
        raise ValueError(f"{table} holds no complete batch")
    return spark.read.parquet(*[f"{table}/{kind}/{k}" for k in keys])


def _newest(papers: DataFrame) -> DataFrame:
    rest = [c for c in papers.columns if c not in UPLOAD]
    return papers.groupBy("file_id").agg(F.max_by(F.struct("modified", "path", *rest), F.struct("modified", "path")).alias("_p")).select("file_id", "_p.*")


def current_papers(spark: SparkSession, table: str) -> DataFrame:
    """(file_id, modified, path, n_questions, error, status): the newest upload of each paper, readable or not."""
    return _newest(_all(spark, table, "papers"))


def current_questions(spark: SparkSession, table: str) -> DataFrame:
    """The questions of each paper's newest readable upload, with its modified and path."""
    held = _newest(_all(spark, table, "papers").where("status = 'completed'")).select(UPLOAD)
    return _of(_all(spark, table, "questions"), few(held))


def compact(spark: SparkSession, table: str) -> str:
    """Write what is current as one folder that stands for all complete batches; its name.

    Readers and streams may go on meanwhile. The folders that it replaces are left for those who still read them.
    """
    base, covered, open_ = _state(spark, table)
    if not open_:
        return base or ""
    name = f"base-{_number(base) + 1 if base else 0:012}"
    keys = ([base] if base else []) + open_
    papers, questions = (spark.read.parquet(*[f"{table}/{kind}/{k}" for k in keys]) for kind in ("papers", "questions"))
    # The newest readable upload of each paper, and the newest of all where that is another.
    held = _newest(papers.where("status = 'completed'"))
    _of(questions, few(held.select(UPLOAD))).write.mode("overwrite").parquet(f"{table}/questions/{name}")
    for key in open_:
        covered[_stream(key)] = max(covered.get(_stream(key), -1), _number(key))
    spark.createDataFrame(sorted(covered.items()), "stream string, batch long").write.mode("overwrite").parquet(f"{table}/covers/{name}")
    held.unionByName(_newest(papers).where("status <> 'completed'")).write.mode("overwrite").parquet(f"{table}/papers/{name}")
    return name


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, stream: str = "uploads", files_per_batch: int = 1000, parse: Parse = parse_packages) -> StreamingQuery:
    """Start a stream that takes what has been uploaded below ``folder`` into ``table``, then ends.

    Started again with its checkpoint it goes on where it was; a batch that it repeats changes nothing. A stream with
    a new checkpoint counts its batches anew and needs a new name.
    """

    def store(found: DataFrame, batch: int) -> None:
        store_batch(table, stream, batch, found, parse)

    sink = uploads(spark, folder, files_per_batch).writeStream.foreachBatch(store)
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
