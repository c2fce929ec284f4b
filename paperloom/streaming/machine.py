"""The state machine of parsing jobs, over a stream and as a replay of all events.

A job (file_id) is uploaded (status parsing, progress 0), makes progress, and is completed or fails; it may be uploaded
again after that. A job that is still parsing ``TIMEOUT_US`` after its upload fails. Events may come late, twice and in any
order: a stream keeps those that the watermark hasn't passed yet, and applies them in their order (ts, seq) once it has.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed value: how long a job may be parsing, in microseconds.
TIMEOUT_US = 300_000_000
TIMED_OUT = "解析超时"
#: Times are microseconds since 1970 here, so that no time zone matters.
EVENTS = ["us", "seq", "status", "progress", "message"]
CHANGES = "file_id string, us long, seq long, status string, progress int, message string, legal boolean, attempt int"
#: What is kept of a job: its last change, its attempt's number and deadline, and the events that aren't due.
STATE = "status string, progress int, attempt int, deadline long, last_us long, last_seq long, pending array<struct<us: long, seq: long, status: string, progress: int, message: string>>"


class Job:
    """The state of one job, and the rows that its events make."""

    def __init__(self, status: str | None = None, progress: int = 0, attempt: int = 0, deadline: int | None = None):
        self.status, self.progress, self.attempt, self.deadline = status, progress, attempt, deadline

    def expired(self, now: int) -> tuple | None:
        """The change of a job whose deadline lies at ``now`` or before."""
        if self.status != "parsing" or self.deadline is None or self.deadline > now:
            return None
        at, self.status, self.progress, self.deadline = self.deadline, "error", 0, None
        return at, None, "error", 0, TIMED_OUT, True, self.attempt

    def apply(self, us: int, seq: int, status: str, progress: int, message: str | None) -> tuple:
        """The row of an event: illegal ones are told, and change nothing."""
        upload = status == "parsing" and progress == 0
        if upload:
            legal = self.status != "parsing"
        elif status == "parsing":
            legal = self.status == "parsing" and progress >= self.progress
        else:
            legal = self.status == "parsing" and status in ("completed", "error")
        if legal:
            self.status, self.progress = status, 100 if status == "completed" else 0 if status == "error" else progress
            if upload:
                self.attempt, self.deadline = self.attempt + 1, us + TIMEOUT_US
            elif status != "parsing":
                self.deadline = None
        return us, seq, status, progress, message, legal, self.attempt

    def run(self, events: list[tuple], until: int | None, after: tuple | None) -> Iterator[tuple]:
        """Changes of the events, in their order, up to a time; events not after the (us, seq) ``after``, or repeated, are left out."""
        for event in sorted(events, key=lambda e: e[:2]):
            if after is not None and event[:2] <= after:
                continue
            after = event[:2]
            if (change := self.expired(event[0])) is not None:
                yield change
            yield self.apply(*event)
        if until is not None and (change := self.expired(until)) is not None:
            yield change


def _events(pdf: pd.DataFrame) -> list[tuple]:
    return [(int(us), int(seq), status, int(progress), message) for us, seq, status, progress, message in pdf[EVENTS].itertuples(index=False)]


def _rows(file_id: Any, changes: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(file_id, *c) for c in changes], columns=["file_id", *EVENTS, "legal", "attempt"])
    return out.astype({"seq": "Int64", "progress": "Int32", "attempt": "Int32"}) if len(out) else out


def replay(events: DataFrame, until: dt.datetime | None = None) -> DataFrame:
    """All changes of all jobs from all their events (file_id, ts, seq, status, progress, message).

    Rows: file_id, ts, seq, status, progress, message, legal (false: an event that the job's state doesn't allow, which
    changes nothing) and attempt. Timeouts are rows of their own without seq; those at or before ``until`` come also
    without a later event. Repeated events (one ts and seq) count once. Events of null file_id, ts or seq are left out;
    an empty table gives an empty result. A job's events go to one task: a job has few.
    """

    last = None if until is None else int(until.timestamp() * 1_000_000)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _rows(key[0], list(Job().run(_events(pdf), last, None)))

    return _timed(_clean(events).groupBy("file_id").applyInPandas(run, CHANGES))


def _clean(events: DataFrame) -> DataFrame:
    types = {"ts": "timestamp", "seq": "long", "status": "string", "progress": "int", "message": "string"}
    held = events if "message" in events.columns else events.withColumn("message", F.lit(None))
    held = held.select(F.col("file_id").cast("string"), *(F.col(c).cast(t) for c, t in types.items())).where("file_id is not null and ts is not null and seq is not null")
    return held.withColumns({"us": F.unix_micros("ts"), "progress": F.coalesce("progress", F.lit(0))})


def _timed(rows: DataFrame) -> DataFrame:
    return rows.select("file_id", F.timestamp_micros("us").alias("ts"), *(c for c in rows.columns if c not in ("file_id", "us")))


def changes(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The rows of ``replay`` as a stream (output mode append), each once the watermark (``late`` behind) has passed it.

    Events behind the watermark when they come are dropped; all others give what a replay gives, in whatever order and
    batches they come. State of a job: one row, its events that aren't due, and nothing beyond its last change when it
    has ended.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, progress, attempt, deadline, last_us, last_seq, pending = state.get if state.exists else (None, 0, 0, None, None, None, [])
        held = [tuple(e) for e in pending or []] + [e for pdf in batches for e in _events(pdf)]
        passed = state.getCurrentWatermarkMs() * 1000
        due, rest = [e for e in held if e[0] <= passed], [e for e in held if e[0] > passed]
        job, after = Job(status, progress, attempt, deadline), None if last_us is None else (last_us, last_seq)
        out = list(job.run(due, passed, after))
        if due:
            last_us, last_seq = max([e[:2] for e in due] + ([after] if after else []))
        state.update((job.status, job.progress, job.attempt, job.deadline, last_us, last_seq, rest))
        wake = [e[0] for e in rest] + ([job.deadline] if job.status == "parsing" and job.deadline else [])
        if wake:
            # A timer fires once the watermark is beyond it.
            state.setTimeoutTimestamp(max(-(-min(wake) // 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield _rows(key[0], out)

    return _timed(_clean(events).withWatermark("ts", late).groupBy("file_id").applyInPandasWithState(run, CHANGES, STATE, "append", GroupStateTimeout.EventTimeTimeout))


def final_states(events: DataFrame, until: dt.datetime | None = None) -> DataFrame:
    """(file_id, status, progress, attempts, illegal) of every job after all its events."""
    rows = replay(events, until)
    order = F.struct("ts", F.col("seq").isNotNull(), F.coalesce("seq", F.lit(0)))
    last = F.max_by(F.struct("status", "progress"), F.when(F.col("legal"), order))
    shown = F.when(F.col("_l.status") == "completed", 100).when(F.col("_l.status") == "error", 0).otherwise(F.col("_l.progress"))
    return rows.groupBy("file_id").agg(last.alias("_l"), F.max("attempt").alias("attempts"), F.count_if(~F.col("legal")).alias("illegal")).select("file_id", "_l.status", shown.alias("progress"), "attempts", "illegal")
