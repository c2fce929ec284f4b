"""Job states: legal changes, timeouts, and a stream that agrees with a replay whatever the order of its events."""

import datetime as dt
import random

from pyspark.sql import functions as F

from paperloom.streaming import machine

START = dt.datetime(2024, 1, 1)
SCHEMA = "file_id string, ts timestamp, seq long, status string, progress int, message string"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def changes_of(spark, rows, until=None):
    found = machine.replay(spark.createDataFrame(rows, SCHEMA), until)
    return [tuple(r) for r in found.orderBy("file_id", "ts", F.col("seq").isNotNull(), "seq").select("seq", "status", "progress", "legal", "attempt").collect()]


def test_legal_and_illegal_changes(spark):
    rows = [("a", at(i), i, s, p, None) for i, (s, p) in enumerate([("completed", 100), ("parsing", 20), ("parsing", 0), ("parsing", 0), ("parsing", 20), ("parsing", 10), ("completed", 100), ("error", 0), ("parsing", 0), ("error", 0), ("odd", 1)])]
    legal = [r[3] for r in changes_of(spark, rows)]
    assert legal == [False, False, True, False, True, False, True, False, True, True, False]
    assert changes_of(spark, rows + rows) == changes_of(spark, rows)


def test_timeouts_and_edge_rows(spark):
    rows = [("a", at(0), 1, "parsing", 0, None), ("a", at(299), 2, "parsing", 50, None), ("a", at(300), 3, "completed", 100, "late"), ("b", at(0), 1, "parsing", 0, None), (None, at(0), 1, "parsing", 0, None), ("c", None, 1, "parsing", 0, None), ("d", at(0), 1, "parsing", None, "")]
    assert changes_of(spark, rows) == [(1, "parsing", 0, True, 1), (2, "parsing", 50, True, 1), (None, "error", 0, True, 1), (3, "completed", 100, False, 1), (1, "parsing", 0, True, 1), (1, "parsing", 0, True, 1)]
    assert changes_of(spark, rows, at(300).replace(tzinfo=dt.UTC))[-1] == (None, "error", 0, True, 1)
    states = {r["file_id"]: tuple(r)[1:] for r in machine.final_states(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert states == {"a": ("error", 0, 1, 1), "b": ("parsing", 0, 1, 0), "d": ("parsing", 0, 1, 0)}
    assert machine.replay(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_stream_of_shuffled_events_agrees_with_the_replay(spark, tmp_path):
    r = random.Random(11)
    rows = [(f"j{r.randrange(12)}", at(r.randrange(1500)), i, *r.choice([("parsing", 0), ("parsing", 0), ("parsing", r.randrange(1, 100)), ("completed", 100), ("error", 0)]), None) for i in range(400)]
    dealt = sorted(rows, key=lambda x: x[1].timestamp() + r.randrange(-250, 250))
    dealt += dealt[40:60]  # repeated, and not yet behind the watermark's reach at the end
    parts = [dealt[i : i + 70] for i in range(0, len(dealt), 70)]
    # Two more files move the watermark beyond all deadlines; their jobs are left out.
    parts += [[("end", at(90_000 + i), 10_000 + i, "completed", 100, None)] for i in range(3)]
    source = tmp_path / "in"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{source}/{i:03}")
        # Files are taken in the order in which they were made.
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    query = machine.changes(stream, "30 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    names = ["file_id", "ts", "seq", "status", "progress", "legal", "attempt"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).where("file_id <> 'end'").select(names).collect()), key=repr)
    want = sorted(map(tuple, machine.replay(spark.createDataFrame(rows, SCHEMA), at(80_000).replace(tzinfo=dt.UTC)).select(names).collect()), key=repr)
    assert got == want and len(want) > 400
