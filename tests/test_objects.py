"""Compound files and equation records: by rule, damaged, and from a package."""

import random
import struct

import pytest

from paperloom.functions import equations as E
from paperloom.plans import objects as O
from paperloom.sources import media, ole


def test_streams_of_any_size_and_scatter():
    r = random.Random(7)
    for scatter in (1, 2, 3, 5):
        want = {f"s{i}": r.randbytes(n) for i, n in enumerate((0, 1, 63, 64, 65, 4095, 4096, 4097, 70_000))}
        found = ole.CompoundFile(O.compound(want, scatter))
        assert {path: found.read(i) for path, i in found.streams()} == want
    assert list(ole.CompoundFile(O.compound({})).streams()) == []


def test_a_table_of_more_than_one_sector_chain():
    # 109 sectors of the table are named in the header; this file needs 2, so chains cross them.
    want = {"big": random.Random(1).randbytes(120_000)}
    found = ole.CompoundFile(O.compound(want, 3))
    assert found.read(dict(found.streams())["big"]) == want["big"]


@pytest.mark.parametrize("damage", [lambda b: b[:600], lambda b: b[:8] + b"\0" * 504, lambda b: b[:30] + b"\x20\0" + b[32:], lambda b: b[:48] + struct.pack("<I", 5000) + b[52:], lambda b: b"", lambda b: b[:512] + struct.pack("<128I", *range(128)) + b[1024:]])
def test_damage_is_an_error(damage):
    data = O.compound({"Equation Native": O.stream(O._records(7, 3)), "x": bytes(9000)})
    with pytest.raises(ole.DamagedFile):
        found = ole.CompoundFile(damage(data))
        [found.read(i) for _, i in found.streams()]


def test_random_damage_never_loops_or_crashes():
    r, data = random.Random(3), O.compound({"Equation Native": O.stream(O._records(8, 3)), "x": bytes(9000)}, 2)
    for _ in range(3000):
        cut = bytearray(data)
        for _ in range(r.randint(1, 8)):
            cut[r.choice([r.randrange(512), r.randrange(512, 1024), r.randrange(len(cut))])] = r.randrange(256)
        try:
            found = ole.CompoundFile(bytes(cut))
            for _, i in found.streams():
                assert len(found.read(i)) <= len(cut)
        except ole.DamagedFile:
            pass


def latex(records):
    return E.equation_latex(O.stream(records))


@pytest.mark.parametrize(
    ("records", "expected"),
    [
        (O.line(O.template(E.FRACTION, O.line("a"), O.line("b"))), r"\frac{a}{b}"),
        (O.line(O.template(E.FRACTION, O.line("a"), O.line("b"), variation=2)), "a/b"),
        (O.line(O.template(E.ROOT, O.line("x"), O.NULL_LINE)), r"\sqrt{x}"),
        (O.line(O.char("x") + O.template(E.SUP, O.NULL_LINE, O.line("2"))), "x^{2}"),
        (O.line(O.char("x") + O.template(E.SUB, O.line("i"), O.NULL_LINE)), "x_{i}"),
        (O.line(O.char("α", 4) + O.char("x")), r"\alpha x"),
        (O.line(b"".join(O.char(c, E.FUNCTION) for c in "sin") + O.char("x")), r"\sin x"),
        (O.line(b"".join(O.char(c, E.TEXT) for c in "if") + O.char("x")), r"\text{if}x"),
        (O.line(O.char("v", E.VECTOR)), r"\mathbf{v}"),
        (O.line(bytes([E.CHAR, E.EMBELLISHED, 131, ord("x"), 0, E.EMBELLISHMENT, 0, 9, E.END])), r"\hat{x}"),
        (O.line(bytes([E.CHAR, E.EMBELLISHED, 131, ord("f"), 0, E.EMBELLISHMENT, 0, 5, E.END])), "f'"),
        (O.line(O.template(3, O.line("x"), variation=1)), r"\left[x\right."),
        (O.line(O.template(E.LIMIT, O.line("l"), O.line("n"), O.NULL_LINE)), "l_{n}"),
        (O.line(O.template(O.E.INTEGRAL, O.line("x"), O.line("0"), O.line("1"))), r"\int_{0}^{1} x"),
        (bytes([E.PILE, 0, 1, 1]) + O.line("a") + O.line("b") + bytes([E.END]), r"\begin{array}{l}a \\ b\end{array}"),
        (O.line(O.template(13, O.line("z"))), r"\overline{z}"),
        # Records that show nothing: font, encoding and style definitions, preferences, colours, sizes, rulers, nudges.
        (bytes([E.FONT_DEF, 1]) + b"Times\0" + bytes([E.ENCODING_DEF]) + b"Win\0" + bytes([E.FONT_STYLE, 1, 0, E.SIZE, 101, 1, 0, E.SIZE, 100, 1, 1, 0, E.SIZE, 1, 2, E.RULER, 1, 0, 5, 0, E.COLOR, 1, E.COLOR_DEF, 4]) + bytes(6) + b"red\0" + bytes([E.FULL]) + O.line("q"), "q"),
        (bytes([E.PREFERENCES, 0, 2, 0x12, 0xF3, 0x4F, 1, 0x2F, 2, 0, 1, 5]) + O.line("q"), "q"),
        (O.line(bytes([E.CHAR, E.NUDGED, 128, 128, 0, 0, 0, 0, 131, ord("x"), 0])), "x"),
        (bytes([E.FUTURE + 55, 255, 3, 0, 9, 9, 9]) + O.line("q"), "q"),
        (O.line("a{b%"), r"a\{b\%"),
    ],
)
def test_records_by_case(records, expected):
    assert latex(records) == expected


@pytest.mark.parametrize("records", [bytes([E.LINE, 0] * 100), bytes([E.TEMPLATE]), bytes([99]), bytes([E.FUTURE, 250]), bytes([E.FONT_DEF, 1, 65])])
def test_broken_records_are_errors(records):
    with pytest.raises(E.BrokenEquation):
        # Without the builder's final end record.
        E.equation_latex(O.stream(records)[:-1])


def test_objects_of_a_package(spark):
    good = O.compound({ole.EQUATION: O.stream(O.line(O.template(E.FRACTION, O.line("a"), O.line("b"))))})
    rows = [("f", "a.bin", "ole", good), ("f", "b.bin", "ole", b"rubbish"), ("f", "c.bin", "ole", O.compound({"x": b"1"})), ("f", "d.png", "media", good), ("f", "e.bin", "ole", O.compound({ole.EQUATION: b"\x1c\0"})), ("f", "g.bin", "ole", None)]
    found = media.equations(spark.createDataFrame(rows, "file_id string, original_filename string, kind string, bytes binary"))
    got = {r["original_filename"]: (r["latex"], r["error"]) for r in found.collect()}
    assert got["a.bin"] == (r"\frac{a}{b}", None) and set(got) == {"a.bin", "b.bin", "e.bin", "g.bin"}
    assert all(got[x][0] is None and got[x][1] for x in ("b.bin", "e.bin", "g.bin"))


def test_streams_carry_columns(spark):
    files = spark.createDataFrame([(1, O.compound({"a": b"xy", "b": b""}), "was"), (2, None, "was")], "id long, bytes binary, stream string")
    got = sorted(map(tuple, ole.ole_streams(files).collect()), key=repr)
    assert [g[:4] for g in got] == [(1, "a", 2, b"xy"), (1, "b", 0, b""), (2, None, None, None)] and got[2][4]
    assert ole.ole_streams(files.limit(0)).collect() == []


def test_objects_of_one_file_are_dealt_to_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    # One file with one group of rows can't be split, so all objects were one task's.
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").coalesce(1).write.parquet(str(tmp_path / "part"))
    made = O.equation_objects(spark.read.parquet(str(tmp_path / "part")))
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def test_streams_in_batches_keep_their_files(spark, monkeypatch):
    monkeypatch.setattr(ole, "BATCH_BYTES", 10)
    files = [(i, f"n{i}", None if i % 7 == 6 else O.compound({"a": bytes([i]) * i, "b": b""})) for i in range(40)]
    got = ole.ole_streams(spark.createDataFrame(files, "id long, name string, bytes binary").coalesce(1)).collect()
    want = [(i, f"n{i}", s, n, d) for i, _, b in files for s, n, d in ((("a", i, bytes([i]) * i), ("b", 0, b"")) if b else ((None, None, None),))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
