"""SimHash near-dedup with vantage-point trees.

Distinct fingerprints go down a top tree whose vantage points come from a bounded sample. A fingerprint has one home
shard, and visits each other shard that the triangle bound can't rule out; so every pair within ``radius`` meets in
the home shard of either. In a shard, a vantage-point tree is searched for all fingerprints at once. What leaves a
shard is no list of pairs but, for each fingerprint with a neighbour, the smallest one of its group there: linear in
the shard, however dense a group of near copies is. Shard groups are joined by rounds of min-label propagation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.text import bring_back, set_aside, small_batches, text_bytes
from paperloom.session import written

#: Fingerprints of the sample that the top tree is built from, at least; a deeper tree takes 8 for each leaf.
SAMPLE = 8192
#: Home fingerprints of a shard that the depth of the top tree aims at.
SHARD = 1 << 15
#: Most levels of the top tree: each one multiplies the visits of a fingerprint by about 1.4 (35 at 10, 97 at 13).
DEPTH = 13
LEAF = 64


def fingerprint(text: bytes, width: int = 3, chunk: int = 1 << 15) -> int:
    """Bit i is set if it is in over half of the shingles' XXH64 hashes (seed 42); 0 without words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    ends = (ends[width - 1 :] - 1).tolist()
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), chunk):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + chunk], ends[at : at + chunk], strict=True)], np.dtype("<u8"))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((1 << np.flatnonzero(2 * total > len(starts)).astype(object)).sum()) if (2 * total > len(starts)).any() else 0


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_hash) with the fingerprint as a signed long and a hash that tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = np.array([fingerprint(x) for x in text_bytes(batch.column(batch.schema.get_field_index("text")))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(1)], names=["doc_id", "fp", "text_hash"])

    return docs.select("doc_id", text_hash().alias("text_hash"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long, text_hash long")


def text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


class TopTree:
    """A vantage-point tree over the sample; leaves are shards, numbered from 0."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.shards = 0
        self.root = self._build(sample, depth)

    def _build(self, points: np.ndarray, depth: int):
        if depth > 0 and len(points) > 1:
            vantage = points[0]
            d = np.bitwise_count(points ^ vantage)
            at = int(np.median(d))
            inner, outer = points[d <= at], points[d > at]
            if len(inner) and len(outer):
                return vantage, at, self._build(inner, depth - 1), self._build(outer, depth - 1)
        self.shards += 1
        return self.shards - 1

    def places(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, indexes of its points and visitors, whether it is their home)."""
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, index, home = todo.pop()
            if isinstance(node, int):
                yield node, index, home
                continue
            vantage, at, inner, outer = node
            d = np.bitwise_count(points[index] ^ vantage).astype(np.int64)
            for child, near, own in ((inner, d - radius <= at, d <= at), (outer, d + radius > at, d > at)):
                if near.any():
                    todo.append((child, index[near], (home & own)[near]))


def close_pairs(points: np.ndarray, radius: int, home: np.ndarray | None = None, leaf: int = LEAF) -> np.ndarray:
    """Links (i, j) that connect all points within ``radius`` of each other (not every pair, but every group).

    With ``home``, the indexes of some of the points, only pairs (i, j), i < j, with j among these are looked for. The tree is descended with points and visitors at once. Where the bounds no longer separate the points, as among
    near copies, all of a small node is compared, and the points of a large one are joined through shared neighbours.
    """
    found = []
    todo = [(np.arange(len(points)) if home is None else home, np.arange(len(points)))]
    while todo:
        own, queries = todo.pop()
        if len(own) == 0 or len(queries) == 0:
            continue
        if len(own) <= leaf:
            rows, columns = np.nonzero(np.bitwise_count(points[queries][:, None] ^ points[own][None, :]) <= radius)
            pair = np.stack((queries[rows], own[columns]), 1)
            found.append(pair[pair[:, 0] < pair[:, 1]])
            continue
        vantage = points[own[len(own) // 2]]
        d, q = np.bitwise_count(points[own] ^ vantage).astype(np.int64), np.bitwise_count(points[queries] ^ vantage).astype(np.int64)
        at = int(np.median(d))
        if at == d.max():
            at -= 1
        parts = [(own[d <= at], queries[q - radius <= at]), (own[d > at], queries[q + radius > at])]
        if sum(len(a) * len(b) for a, b in parts) > 0.95 * len(own) * len(queries):
            found.append(_through_neighbours(points, np.union1d(own, queries), radius))
            continue
        todo += parts
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _through_neighbours(points: np.ndarray, index: np.ndarray, radius: int) -> np.ndarray:
    """Links among the points: two are within 2 bits if, and only if, they share a value at most one bit from each."""
    if radius != 2:
        found = []
        for i in range(0, len(index), 256):
            rows, columns = np.nonzero(np.bitwise_count(points[index[i : i + 256]][:, None] ^ points[index][None, :]) <= radius)
            pair = np.stack((index[i : i + 256][rows], index[columns]), 1)
            found.append(pair[pair[:, 0] < pair[:, 1]])
        return np.concatenate(found)
    flips = np.concatenate(([0], 1 << np.arange(64, dtype=np.uint64))).astype(np.uint64)
    values, owners = (points[index][:, None] ^ flips[None, :]).ravel(), np.repeat(index, 65)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    same = values[1:] == values[:-1]
    return np.stack((owners[:-1][same], owners[1:][same]), 1)


def group_labels(n: int, links: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` points is connected to."""
    label = np.arange(n)
    while len(links):
        a, b = label[links[:, 0]], label[links[:, 1]]
        open_ = a != b
        if not open_.any():
            break
        links, low, high = links[open_], np.minimum(a, b)[open_], np.maximum(a, b)[open_]
        np.minimum.at(label, high, low)
        while not np.array_equal(label, nxt := label[label]):
            label = nxt
    return label


def fingerprint_links(fps: DataFrame, radius: int = 2, shard: int = SHARD) -> DataFrame:
    """(a, b), a < b: links that connect the distinct fingerprints ``fp`` of ``fps`` as all pairs within ``radius`` would."""
    spark = fps.sparkSession
    n = fps.count()
    depth = 0
    while depth < DEPTH and shard << depth < n:
        depth += 1
    picked = fps.orderBy(F.xxhash64("fp"), "fp").limit(max(SAMPLE, 8 << depth)).collect() if depth else []
    tree = spark.sparkContext.broadcast(TopTree(np.array([r["fp"] for r in picked], np.int64).view(np.uint64), depth))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for number, index, home in tree.value.places(points, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), number, np.int32)), pa.array(points[index].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    def link(table: pa.Table) -> pa.Table:
        points, first = np.unique(table.column("fp").to_numpy().view(np.int64), return_index=True)
        # A visitor has its own pairs looked for at home; here it only meets those who live here.
        home = np.flatnonzero(table.column("home").to_numpy()[first])
        label = group_labels(len(points), close_pairs(points.view(np.uint64), radius, home))
        linked = np.flatnonzero(label != np.arange(len(points)))
        return pa.table({"a": points[label[linked]], "b": points[linked]})

    return fps.select("fp").mapInArrow(place, "shard int, fp long, home boolean").groupBy("shard").applyInArrow(link, "a long, b long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, component): for each linked fp, the smallest (first_doc, fp) of ``nodes`` that it reaches.

    Rounds of taking the smallest label over links, then the label of the fingerprint that this one names; each is
    written, and they end when none changes.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.select(F.col("a").alias("fp")).distinct().join(nodes, "fp").select("fp", F.struct("first_doc", F.col("fp").alias("root")).alias("label")), "labels")
    while True:
        spread = both.join(labels, both["a"] == labels["fp"]).groupBy(F.col("b").alias("fp")).agg(F.min("label").alias("near"))
        lower = written(labels.join(spread, "fp").select("fp", F.least("label", "near").alias("next"), F.col("label").alias("old")), "lower")
        further = lower.select(F.col("fp").alias("named"), F.col("next").alias("further"))
        step = written(lower.join(further, F.col("next.root") == F.col("named")).select("fp", "old", F.least("next", "further").alias("label")), "step")
        labels = step.select("fp", "label")
        if step.where("label < old").limit(1).count() == 0:
            return labels.withColumnRenamed("label", "component")


def with_components(printed: DataFrame, radius: int, shard: int) -> DataFrame:
    """``printed`` (doc_id, fp, text_hash) with component_id, the smallest doc_id that its fingerprint reaches, and root, which names the component."""
    nodes = written(printed.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "nodes")
    links = written(fingerprint_links(nodes, radius, shard), "shard_links")
    joined = nodes.join(components(nodes, links), "fp", "left").withColumn("component", F.coalesce("component", F.struct("first_doc", F.col("fp").alias("root"))))
    return printed.join(joined.select("fp", F.col("component.first_doc").alias("component_id"), "component.root"), "fp", "left")


def near_groups(docs: DataFrame, radius: int = 2, shard: int = SHARD) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest doc_id reachable. Null and
    empty texts (and those of blanks only) have fingerprint 0, linked like any other. Rows that repeat a doc_id count
    apiece, each by its text. Rows with a null doc_id link nothing; they get the component of their fingerprint, null if
    no other document has it. Columns other than doc_id and text aren't read. An empty table gives an empty result.
    """
    found = with_components(written(with_fingerprints(docs), "fingerprints"), radius, shard)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, radius: int = 2, shard: int = SHARD) -> DataFrame:
    """``docs`` with one row of each group: of the rows with its smallest doc_id, that of the smallest text hash.

    Null texts count as empty ones; all empty texts are one group. Of rows alike in doc_id and text, one stays: that of
    the smallest hash over all columns. All rows with a null doc_id stay. Columns are carried, whatever their names. An
    empty table gives an empty result.
    """
    docs, names = set_aside(docs, ["doc_id", "text"])
    found = with_components(written(with_fingerprints(docs), "fingerprints"), radius, shard).where("doc_id = component_id")
    keep = found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n")).groupBy("root").agg(F.min(F.struct("text_hash", "n", "doc_id")).alias("first"))
    keep = written(keep.select("first.*"), "keep")
    hashed = docs.withColumn("text_hash", text_hash())
    out = hashed.join(keep.where("n = 1").drop("n"), ["doc_id", "text_hash"], "left_semi").drop("text_hash").unionByName(docs.where("doc_id is null"))
    if keep.where("n > 1").limit(1).count():
        several = hashed.join(keep.where("n > 1").drop("n"), ["doc_id", "text_hash"], "left_semi")
        row = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns))
        out = out.unionByName(several.groupBy("doc_id", "text_hash").agg(row.alias("row")).select("row.*"))
    return bring_back(out, names)
