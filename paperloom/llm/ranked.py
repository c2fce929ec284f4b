"""Ranked lexical search of many items at once, with common subexpressions evaluated once.

A document's score for an item is a sum over the item's terms. Term sets that several items share are mined: each
item's terms are put in order of how many items hold them, and the pair of neighbours that most items share becomes a
new node, over and over. The nodes form a DAG: terms at the bottom, shared sets above, items on top. Per document every
node's accumulator is computed once, from its two parts, and each item adds up the few nodes it is left with.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.text import small_batches, text_bytes, words
from paperloom.session import written

#: Text bytes and items of a block: its terms, DAG and best documents are held by every task.
BLOCK_BYTES, BLOCK_ITEMS = 4 << 20, 4096
#: Accumulators (nodes times documents) held at once: 32 MB.
CELLS = 4 << 20
#: Partial lists of an item that one task merges at most, about.
MERGE = 1024


class SharedSets:
    """The sharing DAG of items' term sets.

    Nodes below ``n_terms`` are terms; ``parts`` has the two nodes of each further one, which are made before it.
    ``levels`` are ranges of further nodes whose parts all lie below the range's first. ``items`` are the nodes whose
    sum is an item.
    """

    def __init__(self, items: list[list[int]], n_terms: int):
        self.n_terms = n_terms
        held = Counter(t for item in items for t in set(item))
        self.items = [sorted(set(item), key=lambda t: (-held[t], t)) for item in items]
        parts: list[tuple[int, int]] = []
        self.levels: list[tuple[int, int]] = []
        while True:
            pairs = Counter(pair for item in self.items for pair in zip(item, item[1:], strict=False))
            # A round takes disjoint nodes' best pairs only, so that all of it is replaced in one sweep.
            taken: set[int] = set()
            chosen: dict[tuple[int, int], int] = {}
            first = n_terms + len(parts)
            for pair, n in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
                if n < 2:
                    break
                if taken.isdisjoint(pair):
                    taken.update(pair)
                    chosen[pair] = n_terms + len(parts)
                    parts.append(pair)
            if not chosen:
                break
            self.levels.append((first, n_terms + len(parts)))
            self.items = [_replaced(item, chosen) for item in self.items]
        self.parts = np.array(parts, np.int64).reshape(-1, 2)

    @property
    def nodes(self) -> int:
        return self.n_terms + len(self.parts)

    @property
    def additions(self) -> int:
        """Additions a document, with sharing."""
        return len(self.parts) + sum(max(0, len(x) - 1) for x in self.items)


def _replaced(item: list[int], chosen: dict[tuple[int, int], int]) -> list[int]:
    out, i = [], 0
    while i < len(item):
        node = chosen.get((item[i], item[i + 1])) if i + 1 < len(item) else None
        out.append(item[i] if node is None else node)
        i += 1 if node is None else 2
    return out


class Plan:
    """What a task needs to score documents: term weights, the DAG as arrays, and the corpus' N and L."""

    def __init__(self, sets: SharedSets, weights: np.ndarray, n_docs: int, n_words: int):
        self.weights, self.n_docs, self.n_words = weights, n_docs, n_words
        self.n_terms, self.nodes, self.parts, self.levels = sets.n_terms, sets.nodes, sets.parts, sets.levels
        sizes = np.array([len(x) for x in sets.items], np.int64)
        self.flat = np.array([x for item in sets.items for x in item], np.int64)
        self.starts = np.cumsum(sizes) - sizes

    def scores(self, n: np.ndarray, offsets: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Scores (items, documents) of documents with ``n`` words; document i has terms and counts offsets[i]:offsets[i + 1]."""
        sums = np.zeros((self.nodes, len(n)), np.int64)
        of = np.repeat(np.arange(len(n)), np.diff(offsets))
        m = 10 + 90 * n * self.n_docs // max(1, self.n_words)
        sums[terms, of] = self.weights[terms] * (1_000_000_000 * counts // (1000 * counts + 8 * m[of]))
        for first, end in self.levels:
            left, right = self.parts[first - self.n_terms : end - self.n_terms].T
            np.add(sums[left], sums[right], out=sums[first:end])
        return np.add.reduceat(sums[self.flat], self.starts, axis=0)


class Best:
    """The k best documents of each item so far; equal scores by ascending id."""

    def __init__(self, items: int, k: int):
        self.k, self.item, self.score, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64), None
        self.least = np.ones(items, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if scores.shape[1] > 2 * self.k:
            # No document below a slice's own k-th score is among the best.
            floor = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            rows, columns = np.nonzero(scores >= np.maximum(self.least, floor)[:, None])
        else:
            rows, columns = np.nonzero(scores >= self.least[:, None])
        if not len(rows):
            return
        item, score = np.concatenate((self.item, rows)), np.concatenate((self.score, scores[rows, columns]))
        held = ids[columns] if self.ids is None else np.concatenate((self.ids, ids[columns]))
        # Ids of any type are compared by their place in order.
        place = np.unique(held, return_inverse=True)[1].reshape(-1)
        order = np.lexsort((place, -score, item))
        item, score, held = item[order], score[order], held[order]
        kept = np.arange(len(item)) - np.searchsorted(item, item) < self.k
        self.item, self.score, self.ids = item[kept], score[kept], held[kept]
        full = np.flatnonzero(np.bincount(self.item, minlength=len(self.least)) == self.k)
        last = np.searchsorted(self.item, full, "right") - 1
        self.least[full] = self.score[last]


def _items(benchmark: DataFrame, n: int, i: int) -> list[tuple[object, set[bytes]]]:
    """Items of block ``i`` of ``n`` and their terms; rows of one item_id are one item."""
    rows = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).select("item_id", "text").collect()
    found: dict[object, set[bytes]] = defaultdict(set)
    for item, text in rows:
        found[item].update(words((text or "").encode()))
    return sorted(found.items(), key=lambda x: (x[0] is None, x[0]))


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): words of each document, and the terms of the vocabulary that it holds; texts are read once."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        size = len(sent.value)
        for batch in small_batches(batches):
            n, terms, counts = [], [], []
            for text in text_bytes(batch.column(1)):
                tokens = words(text)
                ids = np.fromiter((get(w, size) for w in tokens), np.int64, len(tokens))
                found, times = np.unique(ids, return_counts=True)
                known = found < size
                n.append(len(tokens))
                terms.append(found[known])
                counts.append(times[known])
            ends = np.concatenate(([0], np.cumsum([len(x) for x in terms]))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x).astype(t))) for x, t in ((terms, np.int32), (counts, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {doc_id}, n long, terms array<int>, counts array<long>")


def _block_best(counted: DataFrame, plan: Plan, k: int) -> DataFrame:
    """(part, item, doc_id, score): each task's best documents."""
    sent = counted.sparkSession.sparkContext.broadcast(plan)
    kind = counted.schema["doc_id"].dataType

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = sent.value
        best = Best(len(plan.starts), k)
        step = max(1, CELLS // (plan.nodes + len(plan.flat) + len(plan.starts)))
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, n = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy()
                ends = np.asarray(part.column(2).offsets).astype(np.int64)
                terms, counts = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                best.add(plan.scores(n, ends - ends[0], terms, counts), ids)
        if best.ids is not None and id_type is not None:
            task = np.full(len(best.item), TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(best.item.astype(np.int32)), pa.array(best.ids.tolist(), id_type), pa.array(best.score)], names=["part", "item", "doc_id", "score"])

    return counted.mapInArrow(search, f"part int, item int, doc_id {kind.simpleString()}, score long")


def rank_documents(docs: DataFrame, benchmark: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest score above 0 for each item.

    Terms are runs of digits, letters and non-ASCII code points of whole texts, A-Z lower-cased. With N documents that
    have a term, L terms in all, n in the document, df documents with the term and tf of it in the document, a term's
    weight is w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))), a document's m = 10 + 90 * n * N div L, and its score is
    the sum of w * (1000000000 * tf div (1000 * tf + 8 * m)) over the item's distinct terms. Equal scores are ranked by
    ascending doc_id.

    Null and empty texts have no terms; such documents are not found, and such items find nothing. Rows of one item_id
    are one item with the terms of all (null is an item_id). Documents of null doc_id count in N, L and df, but are not
    found; rows that repeat a doc_id are found apiece. Other columns are ignored. Empty tables give an empty result.

    Items are dealt in blocks of at most about ``block_bytes`` of text and 4096 items; a block reads all texts once and
    keeps its terms' counts per document (a table), which the statistics and the search read.
    """
    benchmark = benchmark.select("item_id", "text")
    size = benchmark.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))), F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).first()
    blocks = max(1, -(-(size[0] or 0) // block_bytes), -(-(size[1] or 0) // BLOCK_ITEMS))
    spark, item_type = docs.sparkSession, benchmark.schema["item_id"].dataType.simpleString()
    schema = f"item_id {item_type}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long"
    out = None
    for i in range(blocks):
        items = [(item, terms) for item, terms in _items(benchmark, blocks, i) if terms]
        if not items:
            continue
        # Terms in order, so that runs agree.
        vocabulary = {w: j for j, w in enumerate(sorted(set().union(*(terms for _, terms in items))))}
        counted = written(_counted(docs, vocabulary), "term_counts")
        total = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        n_docs, n_words = total[0], total[1] or 0
        # One row a term of the block.
        holders = np.zeros(len(vocabulary), np.int64)
        for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            holders[term] = n
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in holders], np.int64)
        plan = Plan(SharedSets([sorted(vocabulary[w] for w in terms) for _, terms in items], len(vocabulary)), weights, n_docs, n_words)
        found = _block_best(counted.where(F.col("doc_id").isNotNull() & (F.size("terms") > 0)), plan, k)
        # Few lists an item go to one task: first within groups of tasks, then over these.
        groups = max(1, -(-counted.rdd.getNumPartitions() // MERGE))
        order = (F.desc("score"), "doc_id")
        if groups > 1:
            found = found.withColumn("part", F.pmod("part", F.lit(groups))).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        # At most BLOCK_ITEMS names.
        names = spark.createDataFrame([(j, item) for j, (item, _) in enumerate(items)], f"item int, item_id {item_type}")
        found = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out
