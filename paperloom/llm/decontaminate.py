"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows.

A window's hash is a wrapping polynomial over the ids of its words (0: not a benchmark word). A hit is verified by
comparing the ids themselves, so the result is exact. The benchmark is read in blocks of bounded size: usually one;
a larger benchmark takes one chained scan a block, never a larger broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.text import bring_back, set_aside, small_batches, text_bytes, words
from paperloom.session import written

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Odd multiplier of the window hash.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Text bytes of the benchmark in one broadcast.
BLOCK_BYTES = 8 << 20
#: Blocks whose windows are held by a task at once; the hits so far are written between so many.
CHAINED = 4


class WindowSet:
    """The windows of a block of benchmark items, by width: sorted hashes, where each distinct window stands, and its items.

    All parts are arrays (about 24 bytes a benchmark word), so that a broadcast is a small multiple of the block's text.
    """

    def __init__(self, items: list[tuple[object, bytes]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [None if item is None else str(item) for item, _ in items]
        rows = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int32) for _, text in items]
        self.ids = np.concatenate([*rows, np.zeros(0, np.int32)])
        sizes = np.array([len(r) for r in rows], np.int64)
        offsets, widths = np.cumsum(sizes) - sizes, np.minimum(sizes, width)
        self.widths = {}
        for n in np.unique(widths[widths > 0]).tolist():
            own = np.flatnonzero(widths == n)
            count = sizes[own] - n + 1
            owner = np.repeat(own, count)
            start = np.repeat(offsets[own], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            _, first, same = np.unique(self.ids[start[:, None] + np.arange(n)], axis=0, return_index=True, return_inverse=True)
            held = np.unique(np.stack((same.reshape(-1), owner), 1), axis=0)
            h = self._hashes(start[first], n)
            order = np.argsort(h, kind="stable")
            left, right = np.searchsorted(held[:, 0], order, "left"), np.searchsorted(held[:, 0], order, "right")
            self.widths[n] = (h[order], start[first][order].astype(np.int32), left.astype(np.int32), right.astype(np.int32), held[:, 1].astype(np.int32))

    def _hashes(self, start: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(start), np.uint64)
        for k in range(n):
            out = out * FACTOR + self.ids[start + k].astype(np.uint64)
        return out

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, width, items) of each window that occurs in ``ids``."""
        runs = np.concatenate(([0], np.cumsum(ids != 0)))
        for n, (h, start, low, high, owners) in self.widths.items():
            if len(ids) < n:
                continue
            places = np.flatnonzero(runs[n:] - runs[:-n] == n)  # every word is a benchmark word
            if not len(places):
                continue
            own = np.zeros(len(places), np.uint64)
            for k in range(n):
                own = own * FACTOR + ids[places + k].astype(np.uint64)
            left, right = np.searchsorted(h, own, "left"), np.searchsorted(h, own, "right")
            for i in np.flatnonzero(left < right):
                window = ids[places[i] : places[i] + n]
                for j in range(left[i], right[i]):  # more than one only where hashes collide
                    if np.array_equal(self.ids[start[j] : start[j] + n], window):
                        yield int(places[i]), n, [self.names[x] for x in owners[low[j] : high[j]] if self.names[x] is not None]


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[tuple[list[tuple[object, bytes]], bool]]:
    """The distinct items, a block at a time and whether it is the last, dealt so that a block's texts have about ``limit`` bytes.

    More than one block: the items are written once, a folder a block, and each block reads its own.
    """
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-total // limit))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")
    dealt = written(items.withColumn("_block", block), "items", "_block") if n > 1 else items.withColumn("_block", F.lit(0))
    for i in range(n):
        rows = dealt.where(F.col("_block") == i).select("item_id", "text").collect()
        yield [(r[0], r[1].encode()) for r in rows], i == n - 1


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES, remove_spans: bool = False) -> DataFrame:
    """``docs`` with n_words, n_hit, items (array of item_id as text, sorted), and clean_text if ``remove_spans``.

    A window is ``width`` consecutive words of an item; an item with fewer (but not none) is one window. A word inside
    an occurrence of a window is hit; clean_text is the text without the bytes from the first to the last word of each
    run of hit words. Null text has no words. Items that repeat are one; an item_id of null hits words but isn't
    listed. Columns of ``docs`` are carried; clashing names are replaced. Empty tables give no hits, or no rows.
    """
    new = ["n_words", "n_hit", "items"] + ["clean_text"] * remove_spans
    docs, names = set_aside(docs, ["text"], new)
    sc = docs.sparkSession.sparkContext
    held = "n_words long, n_hit long, items array<string>" + ", clean_text string" * remove_spans

    def scan(block, last):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = block.value
            get = windows.vocabulary.get
            for batch in small_batches(batches):
                column = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
                rows = []
                earlier = column["_hits"].to_pylist() if "_hits" in column else [None] * batch.num_rows
                for text, spans in zip(text_bytes(column["text"]), earlier, strict=True):
                    tokens = words(text)
                    ids = np.fromiter((get(w, 0) for w in tokens), np.int64, len(tokens))
                    found = [tuple(s.values()) for s in spans or []]
                    for first, n, names in windows.hits(ids):
                        found.append((first, n, names))
                    rows.append((text, len(tokens), found))
                if not last:
                    hits = pa.array([[{"first": a, "n": n, "items": names} for a, n, names in found] for _, _, found in rows], HITS)
                    yield pa.RecordBatch.from_arrays([*(column[c] for c in docs_names), hits], names=[*docs_names, "_hits"])
                    continue
                out = [[], [], [], []]
                for text, n_words, found in rows:
                    hit = np.zeros(n_words, bool)
                    for first, n, _ in found:
                        hit[first : first + n] = True
                    out[0].append(n_words)
                    out[1].append(int(hit.sum()))
                    out[2].append(sorted({x for _, _, names in found for x in names}))
                    if remove_spans:
                        out[3].append(without(text, hit) if found else text)
                arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.string()))]
                arrays += [pa.array([x.decode("utf-8", "replace") for x in out[3]], pa.string())] * remove_spans
                yield pa.RecordBatch.from_arrays([*(column[c] for c in docs_names), *arrays], names=[*docs_names, *new])

        return run

    docs_names = docs.columns
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    sent = []
    for i, (block, last) in enumerate(_blocks(benchmark, block_bytes)):
        windows = sc.broadcast(WindowSet(block, width))
        sent.append(windows)
        docs = docs.mapInArrow(scan(windows, last), f"{carried}, " + (held if last else "_hits array<struct<first: int, n: int, items: array<string>>>"))
        if not last and i % CHAINED == CHAINED - 1:
            docs = written(docs, "hits")
            # What is written needs these windows no more, not even if executors are lost.
            while sent:
                sent.pop().destroy()
    return bring_back(docs, names, new)


HITS = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32()), ("items", pa.list_(pa.string()))]))


def without(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its runs of hit words."""
    out, at, places = [], 0, [(m.start(), m.end()) for m in WORD.finditer(text.lower())]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    for first, end in edges.reshape(-1, 2):
        out.append(text[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", width: int = 10) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with the hit passages cut from their texts."""
    docs, names = set_aside(docs, ["text"])
    found = find_benchmark(docs, benchmark, width, remove_spans=remove == "spans")
    if remove == "spans":
        return bring_back(found.withColumn("text", F.when(F.col("n_hit") > 0, F.col("clean_text")).otherwise(F.col("text"))), names)
    return bring_back(found.where(F.col("n_hit") == 0), names)


def items_digest(items: list[str]) -> str:
    """SHA-256 of the comma-joined sorted items, as the query reports it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
