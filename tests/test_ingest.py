"""Incremental ingestion: repeated batches, killed runs, newer, older and unreadable uploads, compaction."""

import datetime as dt
import os

import pytest

from paperloom.streaming import ingest
from tests.test_word import p, package, r, t

UPLOADED = "file_id string, modified timestamp, path string, n int"


def at(day):
    return dt.datetime(2024, 1, day)


def store(spark, table, batch, rows, stream="s"):
    """Uploads that have n questions each; None can't be read."""

    def parse(newest):
        questions = newest.where("n > 0").selectExpr("file_id", "explode(sequence(1, n)) as number", "path as seen")
        return questions, newest.where("n is null").selectExpr("file_id", "'unreadable' as error")

    return ingest.store_batch(table, stream, batch, spark.createDataFrame(rows, UPLOADED), parse)


def held(spark, table):
    questions = sorted(tuple(x) for x in ingest.current_questions(spark, table).select("file_id", "number", "seen").collect())
    papers = sorted(tuple(x) for x in ingest.current_papers(spark, table).select("file_id", "path", "n_questions", "status").collect())
    return questions, papers


def test_the_newest_readable_upload_counts(spark, tmp_path):
    table = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no complete batch"):
        ingest.current_papers(spark, table)
    assert store(spark, table, 0, [("a", at(2), "a1", 2), ("b", at(2), "b1", 1), ("b", at(3), "b2", 2), ("b", at(3), "b2", 2), (None, at(1), "x", 3), ("c", None, "x", 3), ("d", at(1), None, 1)])
    want = [("a", 1, "a1"), ("a", 2, "a1"), ("b", 1, "b2"), ("b", 2, "b2"), ("d", 1, None)], [("a", "a1", 2, "completed"), ("b", "b2", 2, "completed"), ("d", None, 1, "completed")]
    assert held(spark, table) == want
    # The batch again, with other rows: nothing changes. An older upload that comes late: neither.
    assert not store(spark, table, 0, [("a", at(9), "a9", 9)])
    assert store(spark, table, 1, [("a", at(1), "a0", 5)])
    assert held(spark, table) == want
    # One that can't be read leaves the questions, one without questions doesn't.
    assert store(spark, table, 2, [("a", at(4), "a2", None), ("b", at(4), "b3", 0)])
    want = [("a", 1, "a1"), ("a", 2, "a1"), ("d", 1, None)], [("a", "a2", 0, "error"), ("b", "b3", 0, "completed"), ("d", None, 1, "completed")]
    assert held(spark, table) == want
    assert ingest.compact(spark, table) == ingest.compact(spark, table) == "base-000000000000"
    assert held(spark, table) == want
    assert not store(spark, table, 1, [("a", at(9), "a9", 9)])
    assert store(spark, table, 0, [("a", at(5), "a3", 1)], "other-stream") and store(spark, table, 3, [])
    want = [("a", 1, "a3"), ("d", 1, None)], [("a", "a3", 1, "completed"), *want[1][1:]]
    assert held(spark, table) == want
    assert ingest.compact(spark, table) == "base-000000000001" and held(spark, table) == want
    assert not store(spark, table, 0, [("a", at(9), "a9", 9)], "other-stream")


def test_a_batch_that_failed_is_written_anew(spark, tmp_path):
    table = str(tmp_path / "t")
    store(spark, table, 0, [("a", at(1), "a1", 1)])
    found = spark.createDataFrame([("a", at(2), "a2", 3)], UPLOADED)
    broken = spark.createDataFrame([("a", 1)], "file_id string, n int").selectExpr("file_id", "raise_error('lost') as error")
    with pytest.raises(Exception, match="lost"):
        ingest.store_batch(table, "s", 1, found, lambda newest: (newest.selectExpr("file_id", "1 as number", "path as seen"), broken))
    assert held(spark, table)[0] == [("a", 1, "a1")]
    assert store(spark, table, 1, [("a", at(2), "a2", 2)])
    assert held(spark, table)[0] == [("a", 1, "a2"), ("a", 2, "a2")]


def test_packages_as_a_stream(spark, tmp_path):
    folder, table, check = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "check")
    folder.mkdir()

    def upload(name, *lines, data=None):
        (folder / name).write_bytes(data if data is not None else package("".join(p(r(t(x))) for x in lines)))

    def run(parse=ingest.parse_packages):
        query = ingest.ingest(spark, str(folder), table, check, files_per_batch=2, parse=parse)
        query.awaitTermination(120)
        return query.exception()

    upload("a_exam.docx", "1. One", "2. Two")
    upload("b_exam.docx", "1. Uno")
    upload("notes.txt", "1. No")
    assert run() is None

    def lost(newest):
        raise RuntimeError("driver lost")

    upload("b_again.docx", "1. Dos", "2. Tres")
    upload("c_bad.docx", data=b"no archive")
    upload("a_odd.docx", "1. <cut")
    os.utime(folder / "a_odd.docx", (4e9, 4e9))
    os.utime(folder / "b_again.docx", (4e9, 4e9))
    with pytest.raises(Exception, match="driver lost"):
        run(lost)
    names = lambda: sorted(tuple(x) for x in ingest.current_questions(spark, table).select("file_id", "number", "content").collect())
    assert names() == [("a", 1, "One"), ("a", 2, "Two"), ("b", 1, "Uno")]
    # Started again it goes on with the batch that failed.
    assert run() is None and run() is None
    assert names() == [("a", 1, "One"), ("a", 2, "Two"), ("b", 1, "Dos"), ("b", 2, "Tres")]
    assert sorted(tuple(x) for x in ingest.current_papers(spark, table).select("file_id", "n_questions", "status").collect()) == [("a", 0, "error"), ("b", 2, "completed"), ("c", 0, "error")]
