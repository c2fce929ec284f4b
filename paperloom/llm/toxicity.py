"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

The lexicon is learnt: words and beginnings of words that stand in far more toxic than other labelled documents. Trees
see each document against a lexicon learnt without its own part of the sample (cross-fitting), so that chance finds of
the lexicon don't look like evidence. Features come from the text alone, in Arrow batches. Lexicon and trees are fitted
on one part of a bounded sample of labelled rows, the calibration on another (``sample`` rows at most, those with the
smallest hash of doc_id).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.text import WORD_BYTES, small_batches, text_bytes
from paperloom.session import written

# Second-person words of four languages.
SECOND_PERSON = """
you your yours yourself u ur ya du dich dir dein deine deiner euch euer ihr sie tu te toi ton ta tes vous votre vos
tú ti tuyo tus usted ustedes vosotros
""".split()
FEATURES = ("log_words", "hits", "hit_rate", "strong_hits", "strong_rate", "distinct_hits", "weight_sum", "weight_rate", "weight_top", "near_person", "person_rate", "capitals", "shouted", "exclaimed", "questions", "punctuation", "repeated_marks", "obfuscated_hits", "obfuscated_rate", "masked_rate", "digit_rate", "non_ascii", "distinct_words")
#: Bytes of the beginnings of words that may enter the lexicon.
SHORTEST, LONGEST = 3, 12
#: Toxic documents that an entry stands in, its least weight, and by how much it must exceed a shorter entry's weight.
SUPPORT, WEIGHT, GAIN, STRONG = 3, 1.0, 0.3, 2.5
#: Candidates that are weighed, and entries of the lexicon, at most: sizes of the model.
CANDIDATES, ENTRIES = 200_000, 20_000
#: Bytes between a hit and a second-person word that count as near.
NEAR = 40
LEET = bytes.maketrans(b"013457@$|", b"oieastasl")
UPPER, LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
DIGITS, MARKS, HIGH = b"0123456789", bytes(b for b in range(33, 127) if not chr(b).isalnum()), bytes(range(128, 256))
MARK_RUN = re.compile(rb"[!?]{2,}")
SPELLED = re.compile(rb"(?<![0-9A-Za-z])(?:[A-Za-z][.\-_* ]){3,}[A-Za-z](?![0-9A-Za-z])")
DISGUISED = re.compile(rb"[A-Za-z]+[013457@$|]+[0-9A-Za-z@$|]*|[013457@$|]+[A-Za-z]{2,}[0-9A-Za-z@$|]*")
NOT_LETTERS = bytes(b for b in range(256) if b not in LETTERS)
MASKED = re.compile(rb"[A-Za-z]+[*#@$]+[A-Za-z]+")
SHOUTED = re.compile(rb"(?<![0-9A-Za-z\x80-\xff])[A-Z]{3,}(?![0-9A-Za-z\x80-\xff])")


def padded(text: bytes) -> bytes:
    """The lower-cased words between blanks: `` w `` in it is a word, `` w`` a word's beginning."""
    return b" " + text.translate(WORD_BYTES) + b" "


def entries(text: bytes) -> set[bytes]:
    """All that the lexicon may hold of a text: its words, and their beginnings of SHORTEST to LONGEST bytes."""
    found = set(text.translate(WORD_BYTES).split())
    return {b" " + w + b" " for w in found} | {b" " + w[:k] for w in found for k in range(SHORTEST, min(len(w) - 1, LONGEST) + 1)}


class Lexicon:
    """Weighted words and beginnings of words, and second-person words, found in one pass over a text."""

    def __init__(self, weights: dict[bytes, float]):
        self.scan = ahocorasick.Automaton()
        values: dict[str, list] = {}
        for i, (entry, weight) in enumerate(sorted(weights.items())):
            values[entry.decode("latin-1")] = [i, weight, False]
        for w in SECOND_PERSON:
            values.setdefault(f" {w} ".encode().decode("latin-1"), [-1, 0.0, True])[2] = True
        for entry, value in values.items():
            self.scan.add_word(entry, (len(entry) - 1, *value))
        self.scan.make_automaton()

    def find(self, text: bytes) -> tuple[dict[int, tuple[float, int]], list[int]]:
        """The best (weight, entry) at each place of a padded text where one stands, and the places of second-person words."""
        hits: dict[int, tuple[float, int]] = {}
        people = []
        for end, (size, entry, weight, person) in self.scan.iter(text.decode("latin-1")):
            at = end - size
            if person:
                people.append(at)
            if entry >= 0 and (at not in hits or hits[at][0] < weight):
                hits[at] = (weight, entry)
        return hits, people

    def features(self, text: bytes) -> list[float]:
        """The numbers named in FEATURES; an empty text has all of them 0."""
        tokens = text.translate(WORD_BYTES).split()
        n, size = max(1, len(tokens)), max(1, len(text))
        count = lambda chars: size - len(text.translate(None, chars)) if text else 0
        hits, people = self.find(padded(text))
        weights = [w for w, _ in hits.values()]
        near = 0
        if hits and people:
            places, sides = np.fromiter(hits, np.float64), np.array([-math.inf, *people, math.inf])
            at = np.searchsorted(sides, places)
            near = int((np.minimum(places - sides[at - 1], sides[at] - places) <= NEAR).sum())
        strong, capitals = sum(w >= STRONG for w in weights), count(UPPER)
        disguised = [m.translate(LEET) for m in DISGUISED.findall(text)] + [m.translate(None, NOT_LETTERS) for m in SPELLED.findall(text)]
        obfuscated = len(self.find(padded(b" ".join(disguised)))[0]) if disguised else 0
        return [
            math.log1p(len(tokens)), len(hits), len(hits) / n, strong, strong / n, len({i for _, i in hits.values()}),
            sum(weights), sum(weights) / n, max(weights, default=0.0), near, len(people) / n,
            capitals / max(1, count(LETTERS)), len(SHOUTED.findall(text)) / n, text.count(b"!") / n, text.count(b"?") / n,
            count(MARKS) / size, len(MARK_RUN.findall(text)) / n, obfuscated, obfuscated / n, len(MASKED.findall(text)) / n,
            count(DIGITS) / size, count(HIGH) / size, len(set(tokens)) / n,
        ]


def weigh(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """The lower bound (two standard errors) of the smoothed log-odds of standing in a toxic document."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1))
    return odds - 2 * np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))


def lexicon_weights(counts: list[tuple[bytes, int, int]], n_toxic: int, n_other: int) -> dict[bytes, float]:
    """The entries that tell toxic documents apart, out of (entry, toxic documents, other documents).

    An entry whose beginning is an entry of about the same weight says nothing new and is left out.
    """
    counts = [c for c in counts if c[1] >= SUPPORT]
    weights = weigh(np.array([c[1] for c in counts]), np.array([c[2] for c in counts]), n_toxic, n_other)
    heavy = sorted(((float(w), c[0]) for w, c in zip(weights, counts, strict=True) if w >= WEIGHT), key=lambda x: (-x[0], x[1]))[:ENTRIES]
    kept: dict[bytes, float] = {}
    for weight, entry in sorted(heavy, key=lambda x: (len(x[1]), x[1])):
        if weight > max((kept.get(entry[:k], 0.0) for k in range(SHORTEST + 1, len(entry))), default=0.0) + GAIN:
            kept[entry] = weight
    return kept


def entry_counts(rows: DataFrame, only=None) -> DataFrame:
    """(entry, fold, n): in how many texts of ``rows`` (fold, text) each entry stands; only those of the broadcast set ``only``, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[int, bytes]] = Counter()

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[1] for k in held], pa.binary()), pa.array([k[0] for k in held], pa.int32()), pa.array(list(held.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["entry", "fold", "n"])

        for batch in small_batches(batches):
            folds = batch.column(batch.schema.get_field_index("fold")).to_pylist()
            for fold, text in zip(folds, text_bytes(batch.column(batch.schema.get_field_index("text"))), strict=True):
                found = entries(text)
                held.update((fold, e) for e in (found if only is None else found & only.value))
            if len(held) > 500_000:
                yield out()
                held.clear()
        yield out()

    return rows.select("fold", "text").mapInArrow(run, "entry binary, fold int, n long").groupBy("entry", "fold").agg(F.sum("n").alias("n"))


def learn_lexicons(rows: DataFrame, folds: Iterable[int]) -> dict[int, dict[bytes, float]]:
    """The lexicon learnt without each of ``folds`` of ``rows`` (fold, label, text), and under 0 the one learnt from all.

    Entries are first counted in toxic documents; in the others only those are counted that stand in SUPPORT toxic ones.
    """
    folds = list(folds)
    sizes = {(r["fold"], r["label"]): r["count"] for r in rows.groupBy("fold", "label").count().collect()}
    toxic = written(entry_counts(rows.where("label = 1")), "toxic_entries")
    frequent = toxic.groupBy("entry").agg(F.sum("n").alias("n")).where(F.col("n") >= SUPPORT).orderBy(F.desc("n"), "entry").limit(CANDIDATES)
    names = [bytes(r["entry"]) for r in frequent.select("entry").collect()]
    at = {e: i for i, e in enumerate(names)}
    only = rows.sparkSession.sparkContext.broadcast(frozenset(names))
    table = np.zeros((2, len(names), max([0, *folds]) + 1), np.int64)
    wanted = F.broadcast(frequent.select("entry"))
    for label, counts in ((1, toxic.join(wanted, "entry", "left_semi")), (0, entry_counts(rows.where("label = 0"), only))):
        found = counts.toArrow()  # CANDIDATES entries a fold at most
        table[label, [at[e] for e in found["entry"].to_pylist()], found["fold"].to_numpy()] = found["n"].to_numpy()
    out = {}
    for left_out in (0, *folds):
        used = [f for f in folds if f != left_out]
        n = [sum(sizes.get((f, float(label)), 0) for f in used) for label in (0, 1)]
        other, bad = (table[label][:, used].sum(axis=1).tolist() for label in (0, 1))
        out[left_out] = lexicon_weights(list(zip(names, bad, other, strict=True)), n[1], n[0])
    only.destroy()
    return out


def with_features(docs: DataFrame, lexicons, keep: tuple[str, ...] = ("doc_id",), fold: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with features: an array of doubles for every row.

    ``lexicons`` is a broadcast of what learn_lexicons gives; the column ``fold`` names each row's (0 without it).
    """
    kept = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Lexicon] = {}
        for batch in small_batches(batches):
            at = batch.schema.get_field_index
            own = batch.column(at(fold)).to_pylist() if fold else [0] * batch.num_rows
            for f in set(own) - made.keys():
                made[f] = Lexicon(lexicons.value.get(f, lexicons.value[0]))
            rows = [made[f].features(x) for f, x in zip(own, text_bytes(batch.column(at("text"))), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in keep), pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "features"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "features array<double>")


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; 0 (or a null id) is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)), F.lit(0)).cast("int")


class ToxicityModel:
    """A lexicon, trees and a calibration, or a constant where the labels don't allow a fit."""

    def __init__(self, lexicons=None, trees=None, calibration=None, constant: float = 0.0):
        self.lexicons, self.trees, self.calibration, self.constant = lexicons, trees, calibration, constant

    def score(self, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """The columns ``keep`` of ``docs`` with score (0 to 1)."""
        if self.trees is None:
            return docs.select(*keep, F.lit(self.constant).alias("score"))
        featured = with_features(docs, self.lexicons, keep)
        out = self.trees.transform(featured.withColumn("features", array_to_vector("features"))).withColumn("raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
        out = self.calibration.transform(out).withColumnRenamed("prediction", "score") if self.calibration else out.withColumn("score", F.col("raw"))
        return out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score"))).drop("raw")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 15_000, trees: int = 20, depth: int = 4) -> ToxicityModel:
    """Fit on labelled rows outside the held-out fold: folds 2 to 4 give lexicon and trees, fold 1 calibrates them.

    The sample are the ``sample`` labelled ids of smallest hash. A doc_id with several labels counts as toxic if any is
    1; rows whose label is null are left out. Of rows that repeat a doc_id, the least text counts.
    """
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    marked = marked.withColumn("fold", fold()).where("fold > 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` rows go to all tasks, so that no other text than theirs is moved or read twice.
    marked = written(marked, "sampled_labels")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marked.select("doc_id")), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text")).join(F.broadcast(marked), "doc_id")
    texts = written(texts.select("doc_id", "fold", "label", "text"), "sampled_texts")
    seen = {(r["part"], r["label"]): r["count"] for r in texts.groupBy((F.col("fold") == 1).alias("part"), "label").count().collect()}
    total, toxic = sum(seen.values()), sum(n for (_, label), n in seen.items() if label == 1.0)
    if any(not seen.get((False, label)) for label in (0.0, 1.0)):
        return ToxicityModel(constant=toxic / total if total else 0.0)
    lexicons = docs.sparkSession.sparkContext.broadcast(learn_lexicons(texts.where("fold > 1"), (2, 3, 4)))
    rows = with_features(texts, lexicons, ("doc_id", "fold", "label"), "fold")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("fold", "label", "features")
    rows = written(rows.coalesce(1), "sample").coalesce(1).withColumn("features", array_to_vector("features")).cache()
    grown = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, minInstancesPerNode=10, stepSize=0.2, seed=7, maxMemoryInMB=64).fit(rows.where("fold > 1"))
    calibration = None
    if all(seen.get((True, label)) for label in (0.0, 1.0)):
        held = grown.transform(rows.where("fold = 1")).select("label", vector_to_array("probability")[1].alias("raw"))
        calibration = IsotonicRegression(labelCol="label", featuresCol="raw").fit(held)
    rows.unpersist()
    return ToxicityModel(lexicons, grown, calibration)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 15_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Null and empty texts have features of 0 and get the score that the model gives those. Without labels of both kinds
    the score is the share of toxic labels (0 without any). Rows with a null doc_id are scored but never learnt from,
    and count as held out. Rows that repeat are scored alike. Columns other than doc_id and text are never read.
    """
    scored = fit(docs, labels, sample).score(docs)
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = 15_000) -> DataFrame:
    """``docs`` without the rows whose text scores 0.5 or more. Rows are scored where they are read: none is moved."""
    carried = {"text" if c == "text" else f"_c{i}": c for i, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for k, c in carried.items()))
    scored = fit(docs, labels, sample).score(rows, tuple(carried))
    return scored.where("score < 0.5").select(*(F.col(k).alias(c) for k, c in carried.items()))
