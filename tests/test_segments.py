"""Long papers: dealing in chunks against a walk over whole papers."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import segment

SCHEMA = "file_id string, pos int, line string, flag string, number int, score double"


def walked(rows, marks=True):
    """The lines of one paper, dealt one after the other."""
    current, answers, first_of, n, out = None, False, {}, 0, []
    for _, pos, _, flag, number, score in sorted(rows, key=lambda r: r[1]):
        kind, owner = flag, None if flag == "blank" else current
        if flag == "header":
            owner = current = None
        elif flag == "marker":
            answers = marks
        elif flag == "text" and score is not None and current is not None:
            kind = "score"
        elif flag == "text" and number is None:
            kind = "orphan" if current is None else "continuation"
        elif flag == "text" and answers and number in first_of:
            kind, owner, current = "merge", first_of[number], None
        elif flag == "text":
            kind, owner, current, answers, n = "start", n, n, False, n + 1
            first_of.setdefault(number, owner)
        out.append((rows[0][0], pos, kind, owner))
    return out


def papers(seed, flags, files=12, most=90):
    r, rows = random.Random(seed), []
    for f in range(files):
        step = r.choice([1, 1, 7, 40])
        for i in range(r.randrange(1, most)):
            flag = r.choice(flags)
            text = flag == "text"
            rows.append((f"p{f}", i * step + r.randrange(step) - 50, f"l{i}", flag, r.randrange(1, 9) if text and r.random() < 0.6 else None, 2.0 if text and r.random() < 0.4 else None))
    r.shuffle(rows)
    return rows


def by_walk(rows, marks=True):
    files = sorted({r[0] for r in rows})
    return sorted((x for f in files for x in walked([r for r in rows if r[0] == f], marks)), key=repr)


def dealt(df):
    return sorted((tuple(r) for r in df.select("file_id", "pos", "kind", "ord").collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_chunks_change_nothing(spark, monkeypatch, seed):
    monkeypatch.setattr(segment, "CHUNK_BITS", 3)
    plain = papers(seed, ["text"] * 6 + ["blank", "header", "answer"])
    assert dealt(segment.deal_by_windows(spark.createDataFrame(plain, SCHEMA))) == by_walk(plain)
    mixed = papers(seed + 10, ["text"] * 8 + ["blank", "header", "answer", "marker"])
    assert dealt(segment.deal_by_fold(spark.createDataFrame(mixed, SCHEMA))) == by_walk(mixed)


def test_points_settle_in_rounds(spark, monkeypatch):
    """Whether a line with points starts its number depends on entries whose number earlier such lines started."""
    monkeypatch.setattr(segment, "CHUNK_BITS", 2)
    rows = [("p", 0, "", "text", 1, None)]
    for k in range(1, 7):
        # An entry of number k closes the question, so the line with points starts (or is an entry of) k + 1.
        rows += [("p", 10 * k, "", "marker", None, None), ("p", 10 * k + 1, "", "text", k, None), ("p", 10 * k + 2, "", "text", k + 1, 5.0), ("p", 10 * k + 3, "", "text", k + 1, 5.0)]
    assert dealt(segment.deal_by_fold(spark.createDataFrame(rows, SCHEMA))) == by_walk(rows)


def test_sticky_types_and_look_ahead_across_chunks(spark, monkeypatch):
    rows = [("p", i * 3, f"line {i}", "text", None, None) for i in range(60)]
    lines = spark.createDataFrame(rows, SCHEMA).withColumn("header_word", F.when(F.col("pos") == 30, "选择题").when(F.col("pos") == 120, "填空题"))
    want = {c: sorted(map(tuple, f(lines).select("pos", c).collect())) for c, f in (("type", segment.with_type), ("entry_analysis", segment.look_ahead))}
    monkeypatch.setattr(segment, "CHUNK_BITS", 2)
    assert sorted(map(tuple, segment.with_type(lines).select("pos", "type").collect())) == want["type"]
    assert sorted(map(tuple, segment.look_ahead(lines).select("pos", "entry_analysis").collect())) == want["entry_analysis"]
    assert want["type"][9][1] == "unknown" and want["type"][10][1] == "single_choice" and want["type"][59][1] == "fill_blank"
    assert want["entry_analysis"][3][1] == " ".join(f"line {i}" for i in range(4, 14)) and want["entry_analysis"][59][1] == ""


def test_one_long_paper(spark):
    """A paper of 200,000 lines is dealt in a hundred chunks, none of which holds more than a chunk's positions."""
    n = 200_000
    lines = spark.range(n).select(F.lit("p").alias("file_id"), F.col("id").cast("int").alias("pos"), F.lit("x").alias("line"), F.when(F.col("id") % 1000 == 0, "header").when(F.col("id") % 70_001 == 70_000, "marker").otherwise("text").alias("flag"), F.when(F.col("id") % 5 == 1, (F.col("id") % 3001).cast("int")).alias("number"), F.when(F.col("id") % 11 == 1, 3.0).alias("score"))
    lines = lines.withColumns({c: F.when(F.col("flag") == "text", F.col(c)) for c in ("number", "score")})
    want = by_walk([tuple(r) for r in lines.collect()])
    assert dealt(segment.deal_by_fold(lines)) == want
    assert lines.transform(segment.with_chunk).groupBy("_chunk").count().agg(F.max("count"), F.count("*")).first() == (2048, 98)


def test_no_lines(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert segment.deal_by_windows(empty).count() == segment.deal_by_fold(empty).count() == segment.look_ahead(empty).count() == 0
