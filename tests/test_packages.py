"""The package data source: pushed part names, tasks by size, damaged archives; files written once or not at all."""

import hashlib
import io
import os
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperloom.sources import docx, packages


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("papers")
    (path / "deep").mkdir()
    for i in range(6):
        with zipfile.ZipFile(path / ("deep" if i % 2 else ".") / f"p{i}.docx", "w") as z:
            z.writestr("word/document.xml", f"<d>{i}</d>")
            z.writestr("word/media/image1.png", os.urandom(50_000))
            z.writestr("docProps/app.xml", "x")
    (path / "broken.docx").write_bytes(b"PK rubbish")
    (path / "note.txt").write_text("no package")
    return str(path)


def test_parts_are_those_of_read_packages(spark, folder):
    columns = ["file_id", "part_name", "bytes"]
    want = docx.read_parts(docx.read_packages(spark, folder)).where("error is null").select(columns)
    got = packages.read_part_files(spark, folder).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 12


def test_broken_archives_are_rows(spark, folder):
    packages.register(spark)
    rows = spark.read.format("docx_parts").load(folder)
    bad = rows.where("error is not null").collect()
    assert len(bad) == 1 and bad[0]["path"].endswith("broken.docx") and bad[0]["error"] and rows.count() == 19


def test_part_names_are_pushed(spark, folder, monkeypatch):
    reader = packages.PackageReader({"path": folder})
    left = list(reader.pushFilters([packages.StringStartsWith(("part_name",), "word/"), packages.EqualTo(("size",), 1), packages.In(("part_name",), ("word/document.xml", "a"))]))
    assert [type(x).__name__ for x in left] == ["EqualTo", "In"] and reader.wanted("word/document.xml") and not reader.wanted("word/media/image1.png")
    read = []
    monkeypatch.setattr(packages.zipfile.ZipFile, "read", lambda self, entry, of=zipfile.ZipFile.read: read.append(entry.filename) or of(self, entry))
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert set(read) == {"word/document.xml"} and sum(r[5] is None for r in rows) == 6
    one = packages.read_part_files(spark, folder, ()).where("part_name = 'word/document.xml'")
    assert one.count() == 6
    assert "word/document.xml" in one._jdf.queryExecution().executedPlan().toString()


def test_tasks_by_size(folder):
    assert len(packages.PackageReader({"path": folder, "partitionBytes": "120000"}).partitions()) == 3
    assert len(packages.PackageReader({"path": folder, "partitionBytes": "1"}).partitions()) == 7
    assert len(packages.PackageReader({"path": folder}).partitions()) == 1
    assert [x for p in packages.PackageReader({"path": folder, "partitionBytes": "1"}).partitions() for x in p.files] == packages.PackageReader({"path": folder}).partitions()[0].files


def test_files_are_written_once(spark, tmp_path):
    files = spark.range(20).select(F.concat(F.lit("f"), "id", F.lit(".docx")).alias("name"), F.concat(F.lit("b"), "id").cast("binary").alias("bytes")).repartition(4)
    packages.write_files(files, str(tmp_path))
    held = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    assert held == {f"f{i}.docx": f"b{i}".encode() for i in range(20)}
    with pytest.raises(Exception, match="exist"):
        packages.write_files(files, str(tmp_path))
    packages.write_files(files.where("name = 'f3.docx'").withColumn("bytes", F.lit(None)), str(tmp_path), overwrite=True)
    assert (tmp_path / "f3.docx").read_bytes() == b"" and len(list(tmp_path.iterdir())) == 20
    packages.write_files(files, f"file://{tmp_path}/again")
    assert len(list((tmp_path / "again").iterdir())) == 20


@pytest.mark.parametrize("bad", ["case when id = 7 then raise_error('lost') else concat('f', id) end", "case when id = 7 then 'f1' else concat('f', id) end", "case when id = 7 then '../f' else concat('f', id) end"])
def test_a_failed_job_leaves_nothing(spark, tmp_path, bad):
    files = spark.range(20).repartition(4).select(F.expr(bad).alias("name"), F.lit(b"x").alias("bytes"))
    with pytest.raises(Exception):
        packages.write_files(files, str(tmp_path))
    assert list(tmp_path.iterdir()) == []


def test_exported_papers_become_files(spark, tmp_path):
    from paperloom.operators.export import export_papers
    from paperloom.plans.queries import paper

    made = export_papers(paper(spark, "/root/testdata/sf0.001").where("file_id in ('Brand#11', 'Brand#12')"), title="T")
    packages.write_packages(made, str(tmp_path / "out"))
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names == sorted(f"{r['file_id']}.docx" for r in made.select("file_id").collect()) and names
    parts = packages.read_part_files(spark, str(tmp_path / "out"), ("word/document.xml",))
    assert parts.where(F.contains(F.decode("bytes", "UTF-8"), F.lit("T"))).count() == len(names)


def test_lines_are_written_as_they_come():
    import tracemalloc

    from paperloom.operators.export import docx_bytes

    lines = (("stem", f"{i}. 求 $x_{i}$ 的值") for i in range(60_000))
    tracemalloc.start()
    size, peak = len(docx_bytes(lines)), tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All paragraphs, their text and its bytes were held beside the package before.
    assert peak < 2.5 * size


def _questions(spark, papers, each):
    """Papers of ``each`` questions, their rows mixed; texts that don't compress much."""
    columns = ["concat('p', id % {0}) as file_id".format(papers), "cast(id div {0} as int) as ord".format(papers), "cast(id div {0} + 1 as int) as number".format(papers), "'' as type_name", "concat(sha2(cast(id as string), 512), ' $x$') as content"]
    empty = ["array(named_struct('label', 'A', 'content', 'a'), named_struct('label', 'B', 'content', 'b')) as options", "'A' as answer", "'' as analysis", "array('i.png', 'gone.png') as images"]
    return spark.range(papers * each).selectExpr(*columns, *empty).repartition(4)


def test_packages_in_pieces_are_the_packages(spark):
    from paperloom.operators.export import PIECE_BYTES, export_papers, export_pieces

    q = _questions(spark, 3, 1500)
    media = spark.sql("select concat('p', id) as file_id, 'i.png' as filename, cast(concat('image', id) as binary) as bytes from range(2)")
    made = {r["file_id"]: bytes(r["bytes"]) for r in export_papers(q, "T", "W", include_answer=True, media=media).collect()}
    held = export_pieces(q, "T", "W", include_answer=True, media=media).cache()
    rows = held.collect()
    assert len(made) == 3 and max(len(r["bytes"]) for r in rows) == PIECE_BYTES and len(rows) > 6
    for file_id, data in made.items():
        own = sorted((r["n"], bytes(r["bytes"])) for r in rows if r["file_id"] == file_id)
        assert [n for n, _ in own] == list(range(len(own)))
        with zipfile.ZipFile(io.BytesIO(b"".join(x for _, x in own))) as a, zipfile.ZipFile(io.BytesIO(data)) as b:
            assert {n: a.read(n) for n in a.namelist()} == {n: b.read(n) for n in b.namelist()}
            assert ("word/media/i.png" in a.namelist()) == (file_id != "p2")
    # Read again, in whatever order the pieces come.
    want = docx.paragraphs(docx.read_parts(spark.createDataFrame(list(made.items()), "file_id string, content binary")))
    got = docx.piece_paragraphs(held.orderBy(F.rand(1)))
    assert got.columns == want.columns and got.where("exists(content_items, x -> x.image.filename = 'p1_i.png')").count() == 1500
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_damaged_packages_in_pieces_are_errors(spark):
    from paperloom.operators.export import docx_bytes

    good = docx_bytes([("stem", "1. a")])
    no_document = io.BytesIO()
    with zipfile.ZipFile(no_document, "w") as z:
        z.writestr("word/other.xml", "<a/>")
    broken = io.BytesIO()
    with zipfile.ZipFile(broken, "w") as z:
        z.writestr("word/document.xml", "<d><body><p><t>1</t></p>")
    rows = [("good", 1, good[500:]), ("good", 0, good[:500]), ("cut", 0, good[:-30]), ("none", 0, no_document.getvalue()), ("open", 0, broken.getvalue()), (None, 0, good)]
    pieces = spark.createDataFrame(rows, "file_id string, n long, bytes binary")
    assert sorted(repr(r["file_id"]) for r in docx.piece_paragraphs(pieces).collect()) == ["'good'", "None"]
    errors = docx.raw_piece_paragraphs(pieces.orderBy("file_id", "n").coalesce(1).select("file_id", "bytes")).where("error is not null").collect()
    assert {r["file_id"]: r["error"].split(":")[0] for r in errors} == {"cut": "BadZipFile", "open": "ParseError"}


def test_a_long_paper_is_never_held_whole():
    import tracemalloc

    import pyarrow as pa

    from paperloom.operators import export

    def batches(lines):
        for i in range(0, lines, 1000):
            yield pa.RecordBatch.from_pydict({"file_id": ["p"] * 1000, "kind": ["stem"] * 1000, "text": [f"{k}. {hashlib.sha256(str(k).encode()).hexdigest()}" for k in range(i, i + 1000)], "bytes": pa.nulls(1000, pa.binary())})

    def peak(lines):
        tracemalloc.start()
        try:
            for file_id, f in export._package_files(batches(lines), "", "", True):
                frames = docx._piece_files(pd.DataFrame({"file_id": [file_id], "bytes": [x]}) for x in iter(lambda f=f: f.read(export.PIECE_BYTES), b""))
                for _, again in frames:
                    with zipfile.ZipFile(again) as z:
                        assert sum(map(len, docx._raw_rows("p", lambda z=z: docx._read_paragraphs(lambda: z.open(docx.DOCUMENT))))) == lines
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    peak(1000)
    small = peak(4000)
    # A package and its document were one value each before: four times the lines took four times the memory.
    assert peak(16_000) < 1.3 * small


def test_round_trip_takes_packages_in_pieces(spark, monkeypatch):
    from paperloom.operators import export
    from paperloom.plans import queries as core

    def whole(*_, **__):
        raise AssertionError("a package would be one value")

    monkeypatch.setattr(export, "export_papers", whole)
    monkeypatch.setattr(docx, "read_parts", whole)
    assert core.queries()["docx_round_trip"](spark, "/root/testdata/sf0.001").count() > 0
