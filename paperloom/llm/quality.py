"""Quality classifier: an interpolated modified Kneser-Ney model of word pairs, trained on trusted text.

The KNOWN most frequent words have a number each; any other word is one of RARE classes, and is spelled out by a second
Kneser-Ney model, of byte classes, trained on the distinct words. Pair counts are unlimited and grow with the corpus:
they stay in shards, as many as there are words for, and never meet in one place. What is sent to all tasks is bounded:
the numbered words, a few sums for each number, and the spelling model (64 MB at most).

Documents are scored by a sharded count join: each task packs its documents' pairs by shard, a shard's rows follow the
shard's counts through one task, and the sums go back to their documents. Texts themselves aren't shuffled.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.text import small_batches, text_bytes
from paperloom.session import written

ORDER, KINDS = 4, 64
#: Symbol 0 stands before and after a text; the last one for all rarer bytes.
EDGE, OTHER = 0, KINDS - 1
#: Numbers of words: 0 stands before and after a text, frequent words follow, then the classes of all others.
NUMBERS, RARE = 1 << 16, 1 << 13
KNOWN = NUMBERS - RARE
#: Words of so many bytes or more are never numbered.
LONGEST = 64
#: Words of the trusted text (and different pairs, at most) that a shard is meant for; words that a task packs at once;
#: bytes of sums, or of different words, that it holds.
PER_SHARD, PACKED, HELD = 500_000, 2_000_000, 32 << 20
#: Share of a count that a discount takes at least, where the counts of counts would give less.
LEAST_CUT = 0.05
#: One in so many trusted documents is kept from training: the thresholds are taken from these.
HELD_OUT = 5
#: Fixed-point scale of log-probabilities: sums don't depend on their order.
SCALE = 1 << 20
#: Trusted ids that are broadcast at most; more are joined by merge.
BROADCAST_IDS = 1_000_000
#: Bytes that count as one: digits, blanks, and A-Z as a-z.
FOLDED = bytes(0x30 if 0x30 <= b <= 0x39 else 0x20 if b in b" \0\t\n\x0b\f\r" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def byte_counts(docs: DataFrame) -> np.ndarray:
    """How often each folded byte occurs: 256 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in small_batches(batches):
            for text in text_bytes(batch.column(0)):
                total += np.bincount(np.frombuffer(text.translate(FOLDED), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["byte", "n"])

    out = np.zeros(256, np.int64)
    for r in docs.select("text").mapInArrow(run, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r["byte"]] = r["n"]
    return out


def alphabet(counts: np.ndarray) -> bytes:
    """The symbol of each byte."""
    table = np.full(256, OTHER, np.uint8)
    ranked = sorted(np.flatnonzero(counts), key=lambda b: (-counts[b], b))[: OTHER - 1]
    table[ranked] = np.arange(1, len(ranked) + 1)
    return bytes(table[list(FOLDED)])


def symbols(text: bytes, table: bytes) -> np.ndarray:
    """The text's symbols after ORDER - 1 edges, with one at its end."""
    return np.frombuffer(bytes(ORDER - 1) + text.translate(table) + bytes(1), np.uint8)


def codes(a: np.ndarray) -> np.ndarray:
    """The number of the n-gram that ends at each position from ORDER - 1 on."""
    n = len(a) - ORDER + 1
    out = np.zeros(n, np.int32)
    for k in range(ORDER):
        out = out * KINDS + a[k : k + n]
    return out


def shard_of(code):
    """The last symbol of the n-gram's context."""
    return code // KINDS % KINDS


def ngram_counts(docs: DataFrame, table: bytes) -> DataFrame:
    """(shard, code, n) over all of ``docs``; each task adds up its own documents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(KINDS**ORDER, np.int64)
        for batch in small_batches(batches):
            parts = [codes(symbols(x, table)) for x in text_bytes(batch.column(0)) if x]
            if parts:
                code, n = np.unique(np.concatenate(parts), return_counts=True)
                held[code] += n
        code = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(shard_of(code).astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(held[code])], names=["shard", "code", "n"])

    return docs.select("text").mapInArrow(run, "shard int, code int, n long").groupBy("shard", "code").agg(F.sum("n").alias("n"))


def lower_order(counts: DataFrame, order: int) -> DataFrame:
    """Continuation counts: how many different symbols stand before each ``order``-gram, as (code, n)."""
    return counts.select((F.col("code") % KINDS ** (order + 1)).alias("code")).distinct().groupBy((F.col("code") % KINDS**order).alias("code")).agg(F.count("*").alias("n"))


def discounts(counts: DataFrame) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and 3 or more, from the counts of counts 1 to 4."""
    held = {r["n"]: r["count"] for r in counts.where("n <= 4").groupBy("n").count().collect()}
    return discounts_from([0, *(held.get(i, 0) for i in range(1, 5))])


def discounts_from(n: list[int]) -> np.ndarray:
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    d = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i for i in (1, 2, 3)]
    # Any seen context must free some mass, or unseen words would have no probability: a count of i gives LEAST_CUT * i at least.
    return np.array([0.0, *np.clip(d, [LEAST_CUT, 2 * LEAST_CUT, 3 * LEAST_CUT], [1, 2, 3])])


def interpolated(counts: np.ndarray, d: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """P(w | context) along the last axis: discounted counts plus the freed mass times the lower order."""
    total = counts.sum(axis=-1, keepdims=True)
    cut = d[np.minimum(counts, 3)]
    freed = cut.sum(axis=-1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = (counts - cut) / total + freed / total * lower
    return np.where(total > 0, out, lower)


class Scorer:
    """Natural log-probabilities of all n-grams, put together from the shards: rows of seen contexts over those of the order below."""

    def __init__(self, table: bytes, shards: dict[int, tuple[bytes, bytes, bytes]], rest: np.ndarray):
        self.table = table
        self.logp = np.empty((KINDS, KINDS, KINDS, KINDS), np.float32)
        for s in range(KINDS):
            if s not in shards:
                self.logp[:, :, s, :] = rest
                continue
            lower, context, rows = (np.frombuffer(x, kind) for x, kind in zip(shards[s], (np.float32, np.uint16, np.float32), strict=True))
            self.logp[:, :, s, :] = lower.reshape(1, KINDS, KINDS)
            self.logp[context // KINDS, context % KINDS, s, :] = rows.reshape(-1, KINDS)
        self.logp = self.logp.reshape(-1)

    def log_probability(self, text: bytes) -> tuple[int, float]:
        """Symbols scored (the end counts), and the sum of their log-probabilities."""
        found = self.logp[codes(symbols(text, self.table))]
        return len(found), float(found.sum(dtype=np.float64))

    def spell(self, words: list[bytes]) -> np.ndarray:
        """The log-probability of each word (none holds a zero byte)."""
        if not words:
            return np.zeros(0)
        table = bytes([EDGE]) + self.table[1:]
        edges = bytes(ORDER)
        a = np.frombuffer((bytes(ORDER - 1) + edges.join(words) + bytes(1)).translate(table), np.uint8)
        # Each word and its end are scored; the other edges between words are not.
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.concatenate(([0], np.cumsum(sizes + ORDER - 1)[:-1]))
        total = np.concatenate(([0.0], np.cumsum(self.logp[codes(a)], dtype=np.float64)))
        return total[starts + sizes] - total[starts]


def train(trusted: DataFrame, corpus: DataFrame) -> tuple[bytes, dict[int, tuple[bytes, bytes, bytes]], np.ndarray]:
    """The alphabet (of ``corpus``), the shards' log-probabilities, and those of a context whose last symbol never occurs."""
    table = alphabet(byte_counts(corpus))
    counts = written(ngram_counts(trusted, table), "counts")
    # Continuation counts of lower orders; pairs and single symbols are KINDS ** 2 rows at most.
    orders = {3: lower_order(counts, 3), 2: lower_order(counts, 2), 1: lower_order(counts, 1)}
    d = {4: discounts(counts)} | {k: discounts(x) for k, x in orders.items()}
    one = np.zeros(KINDS, np.int64)
    for r in orders[1].collect():
        one[r["code"]] = r["n"]
    p1 = interpolated(one, d[1], np.full(KINDS, 1 / KINDS))

    def estimate(key: tuple, rows: pa.Table) -> pa.Table:
        s = key[0].as_py()
        c4 = np.zeros((KINDS, KINDS, KINDS), np.int64)
        code = rows.column("code").to_numpy()
        c4[code // KINDS**3, code // KINDS**2 % KINDS, code % KINDS] = rows.column("n").to_numpy()
        c3 = (c4 > 0).sum(axis=0)
        c2 = (c3 > 0).sum(axis=0)
        p2 = interpolated(c2, d[2], p1)
        p3 = interpolated(c3, d[3], p2[None, :])
        p4 = interpolated(c4, d[4], p3[None, :, :])
        seen = np.flatnonzero(c4.any(axis=2))
        parts = (np.log(p3).astype(np.float32), seen.astype(np.uint16), np.log(p4.reshape(-1, KINDS)[seen]).astype(np.float32))
        return pa.table({"shard": pa.array([s], pa.int32()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("lower", "context", "rows"), parts, strict=True)}})

    estimated = counts.groupBy("shard").applyInArrow(estimate, "shard int, lower binary, context binary, rows binary")
    shards = {r["shard"]: (bytes(r["lower"]), bytes(r["context"]), bytes(r["rows"])) for r in estimated.toLocalIterator()}
    return table, shards, np.log(p1).astype(np.float32)


def split(text: bytes) -> list[bytes]:
    """Words between blanks, A-Z as a-z, digits as one."""
    return text.translate(FOLDED).split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(text, n): the words of all of ``docs``, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["text", "n"])

        for batch in small_batches(batches):
            for text in text_bytes(batch.column(0)):
                held.update(split(text))
            if len(held) > 300_000 or sum(map(len, held)) > HELD:
                yield out()
                held.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "text binary, n long").groupBy("text").agg(F.sum("n").alias("n"))


class Words:
    """Numbers of words."""

    def __init__(self, known: list[bytes]):
        self.number = {w: i for i, w in enumerate(known, 1)}

    def pairs(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(pair, text) of each word and each end: the number before times NUMBERS plus its own, as uint64."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        get, crc = self.number.get, zlib.crc32
        own = np.fromiter((get(w) or KNOWN + crc(w) % RARE for t in texts for w in t), np.uint64, sizes.sum())
        a = np.zeros(len(own) + len(texts) + 1, np.uint64)
        a[np.arange(1, len(own) + 1) + np.repeat(np.arange(len(texts)), sizes)] = own
        return a[:-1] * np.uint64(NUMBERS) + a[1:], np.repeat(np.arange(len(texts), dtype=np.uint64), sizes + 1)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of uint32, the first one ascending, as compressed bytes."""
    columns = (np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:])
    return zstandard.compress(b"".join(c.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns), 3)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(columns, 4, -1)
    out = [np.ascontiguousarray(x.T).view("<u4")[:, 0] for x in planes]
    return [np.cumsum(out[0], dtype=np.uint32), *out[1:]]


def halves(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as two columns of 32 bits."""
    return n & 0xFFFFFFFF, n >> 32


def unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    pair, low, high = unpack(blob, 3)
    return pair, low.astype(np.int64) + (high.astype(np.int64) << 32)


def by_shard(pair: np.ndarray, shards: int, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(shard, rows, packed rows) of ascending pairs."""
    shard = (pair * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    found, at = np.unique(shard[order], return_index=True)
    for s, rows in zip(found.tolist(), np.split(order, at[1:]), strict=True):
        yield s, len(rows), pack(pair[rows], *(c[rows] for c in columns))


def pair_counts(docs: DataFrame, known, shards: int) -> DataFrame:
    """(shard, n_words, blob): all pairs of ``docs`` and how often each occurs, a row per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = Words(known.value), []

        def out() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            rows = list(by_shard(pair, shards, *halves(n)))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "blob"])

        for batch in small_batches(batches):
            held.append(words.pairs([split(x) for x in text_bytes(batch.column(0))])[0])
            if sum(map(len, held)) > PACKED:
                yield out()
                held.clear()
        if held:
            yield out()

    def merge(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in rows:
            parts = [unpack_counts(x.as_py()) for x in batch.column("blob")]
            pair, back = np.unique(np.concatenate([pair, *(x[0] for x in parts)]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n, *(x[1] for x in parts)])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([int(n.sum())]), pa.array([pack(pair, *halves(n))], pa.binary())], names=["shard", "n_words", "blob"])

    parts = docs.select("text").mapInArrow(run, "shard int, blob binary")
    return parts.groupBy("shard").applyInArrow(merge, "shard int, n_words long, blob binary")


class Pairs:
    """P(word | word before) from a pair's count and sums by number: a bounded table."""

    def __init__(self, sums: list[tuple]):
        table = np.zeros((NUMBERS, 7), np.int64)
        for r in sums:
            table[r[0]] = r[1:]
        total, kinds, n1, n2, n3, n4, before = table.T
        self.cut = discounts_from([0, *(int(x.sum()) for x in (n1, n2, n3, n4))])
        lower = discounts_from([0, *(int((before == i).sum()) for i in range(1, 5))])
        self.first = interpolated(before, lower, np.full(NUMBERS, 1 / NUMBERS))
        self.freed = np.where(total > 0, (self.cut[1] * n1 + self.cut[2] * n2 + self.cut[3] * (kinds - n1 - n2)) / np.maximum(total, 1), 1.0)
        self.total = np.maximum(total, 1)

    def log_probability(self, pair: np.ndarray, count: np.ndarray) -> np.ndarray:
        left, right = pair // NUMBERS, pair % NUMBERS
        return np.log((count - self.cut[np.minimum(count, 3)]) / self.total[left] + self.freed[left] * self.first[right])


def pair_sums(counts: DataFrame) -> Pairs:
    """What the formula needs of each word number: at most NUMBERS rows, summed in Spark."""
    names = ["total", "kinds", "n1", "n2", "n3", "n4", "before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((NUMBERS, len(names)), np.int64)
        for batch in batches:
            for blob in batch.column(0):
                pair, n = unpack_counts(blob.as_py())
                left = pair // NUMBERS
                held[:, 0] += np.bincount(left, n, NUMBERS).astype(np.int64)
                held[:, 1] += np.bincount(left, minlength=NUMBERS)
                for i in range(1, 5):
                    held[:, 1 + i] += np.bincount(left[n == i], minlength=NUMBERS)
                held[:, 6] += np.bincount(pair % NUMBERS, minlength=NUMBERS)
        ids = np.flatnonzero(held.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(c) for c in held[ids].T)], names=["id", *names])

    rows = counts.select("blob").mapInArrow(run, "id long, " + ", ".join(f"{c} long" for c in names))
    return Pairs([tuple(r) for r in rows.groupBy("id").agg(*(F.sum(c).alias(c) for c in names)).collect()])


def train_words(trusted: DataFrame) -> tuple[list[bytes], tuple, DataFrame, int]:
    """The numbered words, the spelling model, the pair counts in shards, and the number of shards."""
    words = written(word_counts(trusted), "words")
    known = [bytes(r["text"]) for r in words.where(F.octet_length("text") < LONGEST).orderBy(F.desc("n"), "text").limit(KNOWN - 1).collect()]
    shards = 16 + min(words.agg(F.sum("n")).first()[0] or 0, NUMBERS**2) // PER_SHARD
    spelling = train(words.select("text"), words.select("text"))
    counts = written(pair_counts(trusted, trusted.sparkSession.sparkContext.broadcast(known), shards), "pairs")
    return known, spelling, counts, shards


def perplexities(docs: DataFrame, model: tuple[list[bytes], tuple, DataFrame, int]) -> DataFrame:
    """``docs`` (without text) with n_symbols, log_prob and perplexity (per symbol) of every row.

    Symbols are the bytes of words, a blank between words, and the end. A word without a number has the probability of
    its class, times that of its spelling among all words, times RARE (the spellings of a class are 1 / RARE of all).
    """
    known, spelling, counts, shards = model
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("text", "n_symbols", "log_prob", "perplexity")]
    kept = {f.name: f.dataType.simpleString() for f in docs.schema}
    # A shard of far more words than it is meant for has copies of its counts, over which the packed rows are dealt.
    n_copies = (1 + F.floor(F.col("n_words") / (2 * PER_SHARD))).cast("int")
    copies = {r["shard"]: r["copies"] for r in counts.select("shard", n_copies.alias("copies")).where("copies > 1").collect()}
    sent = spark.sparkContext.broadcast((known, spelling, pair_sums(counts), copies))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, spelling, _, copies = sent.value
        words, scorer = Words(known), Scorer(*spelling)
        held, heads, docs_held, seq = [], [], 0, 0

        def out() -> pa.RecordBatch:
            part = TaskContext.get().partitionId()
            at, spread = (part << 32) + seq, part + seq
            key, n = np.unique(np.concatenate(held), return_counts=True)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, heads[0].schema) as w:
                for h in heads:
                    w.write_batch(h)
            rows = list(by_shard(key >> np.uint64(32), shards, key & np.uint64(0xFFFFFFFF), n))
            arrays = [pa.array([-1 - spread, *(r[0] for r in rows)], pa.int32()), pa.array([0, *(spread % copies.get(r[0], 1) for r in rows)], pa.int32()), pa.array([at] * (len(rows) + 1), pa.int64())]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([sink.getvalue().to_pybytes(), *(r[2] for r in rows)], pa.binary())], names=["shard", "copy", "batch", "blob"])

        for batch in small_batches(batches):
            texts = [split(x) for x in text_bytes(batch.column(batch.schema.get_field_index("text")))]
            pair, doc = words.pairs(texts)
            rare = [[w for w in t if w not in words.number] for t in texts]
            spelt = scorer.spell([w for t in rare for w in t]) + np.log(RARE)
            if not np.isfinite(spelt).all():
                raise ValueError("a word has no spelling probability")
            total = np.bincount(np.repeat(np.arange(len(rare)), [len(t) for t in rare]), np.rint(spelt * SCALE), len(rare)).astype(np.int64)
            size = np.array([sum(map(len, t)) + max(len(t), 1) for t in texts], np.int64)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            heads.append(pa.RecordBatch.from_arrays([*columns, pa.array(size), pa.array(total)], names=[*(f"c{i}" for i in range(len(names))), "size", "total"]))
            held.append(pair << np.uint64(32) | (doc + np.uint64(docs_held)))
            docs_held += len(texts)
            if sum(map(len, held)) > PACKED:
                yield out()
                held, heads, docs_held, seq = [], [], 0, seq + 1
        if held:
            yield out()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formula, shard, pair, count, sums, size = sent.value[2], None, np.zeros(0, np.uint32), np.zeros(0, np.int64), {}, 0

        def out() -> pa.RecordBatch:
            rows = [(b, v) for b, v in sums.items()]
            cells = [np.stack((i := np.flatnonzero(v), v[i])).astype("<i8").tobytes() for _, v in rows]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([False] * len(rows), pa.bool_()), pa.array(cells, pa.binary())], names=["batch", "head", "blob"])

        for rows in batches:
            for s, b, blob in zip(*(rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("shard", "batch", "blob")), strict=True):
                if s < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([True]), pa.array([blob], pa.binary())], names=["batch", "head", "blob"])
                elif b < 0:
                    shard, (pair, count) = s, unpack_counts(blob)
                else:
                    own, doc, n = unpack(blob, 3)
                    seen = np.zeros(len(own), np.int64)
                    if s == shard and len(pair):
                        at = np.minimum(np.searchsorted(pair, own), len(pair) - 1)
                        seen = np.where(pair[at] == own, count[at], 0).astype(np.int64)
                    value = np.bincount(doc, np.rint(formula.log_probability(own, seen) * SCALE) * n).astype(np.int64)
                    before = sums.get(b, np.zeros(0, np.int64))
                    if len(before) > len(value):
                        value = np.pad(value, (0, len(before) - len(value)))
                    value[: len(before)] += before
                    sums[b], size = value, size + value.nbytes - before.nbytes
                    if size > HELD:
                        yield out()
                        sums, size = {}, 0
        yield out()

    def finished(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, parts = None, []
        for batch in rows:
            for is_head, blob in zip(batch.column("head").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if is_head:
                    head = pa.ipc.open_stream(blob).read_all()
                else:
                    parts.append(np.frombuffer(blob, "<i8").reshape(2, -1))
        total = head.column("total").to_numpy().copy()
        for at, value in parts:
            np.add.at(total, at, value)
        size, total = head.column("size").to_numpy(), total / SCALE
        if not np.isfinite(total).all() or (total > 0).any():
            raise ValueError("a document has no proper probability")
        arrays = [*(head.column(i).combine_chunks() for i in range(len(names))), pa.array(size, pa.int64()), pa.array(total), pa.array(np.exp(-total / size))]
        yield pa.RecordBatch.from_arrays(arrays, names=[*names, "n_symbols", "log_prob", "perplexity"])

    tables = counts.select("shard", F.explode(F.sequence(F.lit(0), n_copies - 1)).alias("copy"), F.lit(-1).cast("long").alias("batch"), "blob")
    rows = docs.select(*names, "text").mapInArrow(packed, "shard int, copy int, batch long, blob binary").unionByName(tables)
    # A shard's counts come before what is looked up in them.
    met = rows.repartition("shard", "copy").sortWithinPartitions("shard", "copy", "batch").mapInArrow(scored, "batch long, head boolean, blob binary")
    return met.groupBy("batch").applyInArrow(finished, "".join(f"`{c}` {kept[c]}, " for c in names) + "n_symbols long, log_prob double, perplexity double")


def language_thresholds(scored: DataFrame, quantile: float, slack: float, step: float = 1e-3) -> DataFrame:
    """(lang, threshold): ``slack`` times the perplexity at ``quantile`` of the documents of each language marked ``sets_threshold``.

    Log-perplexities are counted in steps of ``step``, so that the exact quantile of any number of documents comes from
    some thousand counts a language. A language without such documents has the threshold of all together; of few
    documents the quantile is their greatest perplexity (below 20 for 0.95).
    """
    bins = written(scored.where("sets_threshold").groupBy("lang", F.round(F.log("perplexity") / step).cast("long").alias("bin")).agg(F.count("*").alias("n")), "bins")

    def at(table: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by)
        upto = table.groupBy(*by, "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
        return upto.where(F.col("upto") >= quantile * F.col("total")).groupBy(*by).agg((F.exp(F.min("bin") * step) * slack).alias("threshold"))

    overall = at(bins.withColumn("every", F.lit(1)), "every").select(F.col("threshold").alias("overall"))
    return at(bins, "lang").select("lang", "threshold"), overall


def classify_quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.95, slack: float = 1.1, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(doc_id, lang, trusted, n_symbols, log_prob, perplexity, threshold, keep) of every row of ``docs``.

    Trusted are the documents labelled quality 1. One in HELD_OUT of them (by a hash of the id) is kept from training
    and sets the thresholds, as documents score far better under a model that has seen them. Kept are the documents
    whose perplexity is no higher than their language's threshold. Null and empty texts have one symbol, their end. Null
    lang is a language of its own. Without trusted text all words of a length are equally likely; without held-out
    trusted documents thresholds are null and all are kept. Texts are scored whole, however long. Rows that repeat count apiece; a doc_id with several labels
    is trusted if any is 1, a null doc_id never. Other columns aren't read.
    """
    good = labels.where("quality = 1").select("doc_id").distinct()
    held_out = F.pmod(F.xxhash64(F.lit("threshold"), "doc_id"), F.lit(HELD_OUT)) == 0
    learnt = good.where(~held_out)
    ids = F.broadcast(learnt) if learnt.limit(broadcast_ids + 1).count() <= broadcast_ids else learnt.hint("merge")
    model = train_words(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").select("text"))
    scored = written(perplexities(docs.select("doc_id", "lang", "text"), model), "scored")
    scored = scored.join(good.withColumn("trusted", F.lit(True)), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    scored = scored.withColumn("sets_threshold", F.col("trusted") & held_out)
    by_lang, overall = language_thresholds(scored, quantile, slack)
    by_lang = written(by_lang.withColumnRenamed("lang", "_lang"), "thresholds")
    overall = overall.first()
    out = scored.join(F.broadcast(by_lang) if by_lang.limit(10_001).count() <= 10_000 else by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    limit = F.coalesce("threshold", F.lit(overall["overall"] if overall else None).cast("double"))
    return out.select("doc_id", "lang", "trusted", "n_symbols", "log_prob", "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(True)).alias("keep"))
