"""Every registered query of the papers against its SQL; those without SQL must run and have rows."""

import pytest

from paperloom.plans import queries as core
from tests.conftest import duckdb_rows, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_as_sql(spark, name):
    df = core.queries()[name](spark, SF)
    assert rows_of(df, df.columns) == duckdb_rows(core.oracle_sql()[name], SF, df.columns)


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql()) - {"docx_round_trip"}))
def test_has_rows(spark, name):
    assert core.queries()[name](spark, SF).count() > 0


def test_round_trip_loses_only_what_it_says(spark):
    before = core.paper(spark, SF).select("file_id", "ord", "number", "content", "type_name", "options").orderBy("file_id", "ord").collect()
    again = {(r["file_id"], r["number"]): r for r in core.queries()["docx_round_trip"](spark, SF).collect()}
    lost = set()
    for r in before:
        if (r["file_id"], r["number"]) not in again:
            assert "分" in r["content"]
            lost.add((r["file_id"], r["number"]))
        else:
            back = again[r["file_id"], r["number"]]
            # What follows a lost line counts to the question before.
            assert back["n_options"] >= len(r["options"]) and back["content"].startswith(r["content"])
    assert len(again) + len(lost) == len(before) and len(lost) < len(before) / 20


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[:3] == ["file_id", "id", "number"]
    assert set(e.oracle_sql()) <= set(e.queries())
