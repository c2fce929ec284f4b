"""Exact top-k search by distributed histogram selection.

A block of queries is broadcast; each task scores its candidates against it and reports, per query, a histogram of the
scores in the query's current range. Summed histograms narrow the range until it is one value: the k-th highest
score. A last pass keeps higher scores and, of those equal to it, the smallest ids. A task reports only its highest
bins that hold k scores, and only the k smallest ids of a tie; the rest can't be among the k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 256
#: Queries of a block: with 64 components, 2 MB.
BLOCK = 4096
#: Candidates scored at a time.
ROWS = 1024


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; without vectors that are null or hold null or non-finite ones."""
    ok = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.coalesce(ok, F.lit(False))).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of ``width`` components, and which rows have that width."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    # Offsets of a slice count from its batch's start, the flattened values from its own.
    ends = ends - ends[0]
    fits = np.diff(ends) == width
    if fits.all():
        return flat.reshape(-1, width), fits
    return np.array([flat[a:b] for a, b, f in zip(ends, ends[1:], fits, strict=False) if f], np.int64).reshape(-1, width), fits


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating-point multiplication where its sums are exact."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64) if most < 2**53 else queries @ rows.T


def _scored(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(scores of all queries, candidate ids, True where a candidate is the query itself) in slices."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            rows, fits = _matrix(part.column(1), queries.shape[1])
            found = part.column(0).to_numpy(zero_copy_only=False)[fits]
            if len(found):
                yield _scores(queries, rows), found, ids[:, None] == found[None, :]


def _histograms(candidates: DataFrame, ids: np.ndarray, vectors: np.ndarray, low: np.ndarray, span: np.ndarray, width: np.ndarray, need: np.ndarray) -> DataFrame:
    """(query, bin, n): bin b of query q holds scores from low[q] + b * width[q] below low[q] + span[q]; only bins that may hold a needed score."""
    sent = candidates.sparkSession.sparkContext.broadcast((ids, vectors, low, span, width, need))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, low, span, width, need = sent.value
        total = np.zeros((len(ids), BINS), np.int64)
        offset = np.arange(len(ids))[:, None] * BINS
        for scores, _, own in _scored(batches, ids, vectors):
            above = scores - low[:, None]
            inside = (above >= 0) & (above < span[:, None]) & ~own
            total += np.bincount((above // width[:, None] + offset)[inside], minlength=total.size).reshape(total.shape)
        above = total[:, ::-1].cumsum(axis=1)[:, ::-1] - total
        rows, bins = np.nonzero((total > 0) & (above < need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(bins.astype(np.int32)), pa.array(total[rows, bins])], names=["query", "bin", "n"])

    return candidates.mapInArrow(run, "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))


def _kth(candidates: DataFrame, ids: np.ndarray, vectors: np.ndarray, longest: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query the k-th highest score and how many of the rows that have it are needed; a query with fewer rows has the lowest."""
    bound = np.ceil(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)) * longest).astype(np.int64) + 1
    low, span = -bound, 2 * bound + 1
    need = np.full(len(ids), k, np.int64)
    while True:
        width = np.maximum(1, -(-span // BINS))
        # Per query: the bins from the highest down, until the needed number is reached.
        down = Window.partitionBy("query").orderBy(F.desc("bin"))
        needs = candidates.sparkSession.createDataFrame(list(enumerate(need.tolist())), "query int, need long")
        bins = _histograms(candidates, ids, vectors, low, span, width, need).withColumn("upto", F.sum("n").over(down)).join(needs, "query")
        end = F.expr("upto >= need and upto - n < need")
        rows = bins.groupBy("query").agg(F.max(F.when(end, F.col("bin"))).alias("bin"), F.max(F.when(end, F.col("upto") - F.col("n"))).alias("above")).where("bin is not null").collect()
        hit = np.array([r["query"] for r in rows], np.int64)
        fewer = np.setdiff1d(np.arange(len(ids)), hit)
        low, need = low.copy(), need.copy()
        low[hit] += np.array([r["bin"] for r in rows], np.int64) * width[hit]
        need[hit] -= np.array([r["above"] for r in rows], np.int64)
        if width.max(initial=1) == 1:
            return low, need
        span = width.copy()
        span[fewer] = 1


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` with the highest integer inner products for each query.

    Ties go to the smaller vec_id. A row whose vec_id is the query's own is no candidate for it. Null vec_ids, and
    vectors that are null or hold null or non-finite components, take no part; nor do pairs of unequal length. Rows of
    ``queries`` that repeat are one query (of several vectors under one id, the greatest counts); rows of ``vectors``
    that repeat are candidates apiece. Empty tables give an empty result. Scores must fit a long.
    """
    spark = vectors.sparkSession
    asked = quantised(queries).groupBy("vec_id").agg(F.max("v").alias("v")).withColumn("width", F.size("v"))
    candidates = quantised(vectors)
    sizes = {r["width"]: r["count"] for r in asked.groupBy("width").count().collect()}
    out = []
    for width, n in sorted(sizes.items()):
        blocks = -(-n // block)
        longest = candidates.where(F.size("v") == width).agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))).first()[0] or 0.0
        for i in range(blocks):
            rows = asked.where((F.col("width") == width) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i)).orderBy("vec_id").select("vec_id", "v").collect()
            if rows and width:
                out.append(_selected(candidates, np.array([r["vec_id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.int64), longest, k))
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = out[0]
    for x in out[1:]:
        found = found.union(x)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _selected(candidates: DataFrame, ids: np.ndarray, vectors: np.ndarray, longest: float, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the rows above each query's k-th score and the smallest ids of those equal to it."""
    kth, need = _kth(candidates, ids, vectors, longest, k)
    sent = candidates.sparkSession.sparkContext.broadcast((ids, vectors, kth, need))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, kth, need = sent.value
        ties: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for scores, found, own in _scored(batches, ids, vectors):
            above, equal = (scores > kth[:, None]) & ~own, (scores == kth[:, None]) & ~own
            rows, columns = np.nonzero(above)
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(found[columns]), pa.array(scores[rows, columns])], names=["query_id", "vec_id", "score"])
            rows, columns = np.nonzero(equal)
            rows, held = np.concatenate((ties[0], rows)), np.concatenate((ties[1], found[columns]))
            order = np.lexsort((held, rows))
            rows, held = rows[order], held[order]
            first = np.searchsorted(rows, rows)
            kept = np.arange(len(rows)) - first < need[rows]
            ties = rows[kept], held[kept]
        yield pa.RecordBatch.from_arrays([pa.array(ids[ties[0]]), pa.array(ties[1]), pa.array(kth[ties[0]])], names=["query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, "query_id long, vec_id long, score long")
