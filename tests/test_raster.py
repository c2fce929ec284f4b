"""Boxes of PNG images against the pixels they were made from; damaged and hostile bytes."""

import random

import numpy as np
import pandas as pd
import pytest

from paperloom.plans import rasters
from paperloom.sources import raster


def brute_box(pixels):
    unlike = (pixels != pixels[0, 0]).any(axis=2)
    ys, xs = np.flatnonzero(unlike.any(axis=1)), np.flatnonzero(unlike.any(axis=0))
    height, width = unlike.shape
    return (width, height, None, None, 0, 0) if not len(xs) else (width, height, int(xs[0]), int(ys[0]), int(xs[-1] - xs[0] + 1), int(ys[-1] - ys[0] + 1))


@pytest.mark.parametrize(("colour", "depth"), rasters.KINDS)
def test_boxes(colour, depth):
    r = np.random.default_rng(colour * 100 + depth)
    samples = raster.SAMPLES[colour][0]
    for case in range(40):
        height, width = (int(x) for x in r.integers(1, 20, 2))
        pixels = np.full((height, width, samples), int(r.integers(0, 1 << depth)), np.int64)
        if case % 4:
            y, x = int(r.integers(0, height)), int(r.integers(0, width))
            pixels[y : y + 5, x : x + 6] = r.integers(0, 1 << depth, pixels[y : y + 5, x : x + 6].shape)
        data = rasters.png(pixels, colour, depth, case % 2 == 1, case)
        assert raster.drawn_box(data) == brute_box(pixels)


def test_damaged_images(spark):
    good = rasters.png(np.arange(48).reshape(4, 4, 3), 2, 8)
    r, bad = random.Random(3), [b"", b"\x89PNG", raster.SIGNATURE, good[:20], good[:-30], good.replace(b"IHDR", b"XXXX")]
    assert all(x[6] for x in (y["b"] for y in spark.createDataFrame([(x,) for x in bad], "d binary").select(raster.png_box("d").alias("b")).collect()))
    for _ in range(400):
        data = bytearray(good)
        data[r.randrange(8, len(data))] = r.randrange(256)
        try:
            raster.drawn_box(bytes(data))
        except (raster.DamagedImage, raster.zlib.error):
            pass


def test_ratios_carry_other_columns(spark):
    pixels = np.zeros((10, 20, 1), np.int64)
    blank, pixels[2:7, 5:9] = rasters.png(pixels, 0, 8), 200
    rows = spark.createDataFrame([("a", rasters.png(pixels, 0, 8), 7), ("b", blank, 7), ("c", None, 7), ("d", b"x", 7)], "file_id string, bytes binary, width int")
    got = [tuple(x) for x in raster.with_ratios(rows).orderBy("file_id").select("file_id", "width", "height", "left", "top", "fill_ratio", "height_ratio", "normalise").collect()]
    assert got == [("a", 20, 10, 5, 2, 0.2, 0.5, True), ("b", 20, 10, None, None, 0.0, 0.0, False), ("c", *[None] * 7), ("d", *[None] * 7)]
    assert raster.with_ratios(rows.limit(0)).count() == 0


def test_images_of_one_file_are_dealt_to_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    # One file with one group of rows, as small tables are: it can't be split, so all images were one task's.
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").coalesce(1).write.parquet(str(tmp_path / "part"))
    made = rasters.images(spark.read.parquet(str(tmp_path / "part")))
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def test_filters_on_boxes_read_no_image_twice(spark):
    from pyspark.sql.functions import pandas_udf

    seen = spark.sparkContext.accumulator(0)

    @pandas_udf("binary")
    def made(data: pd.Series) -> pd.Series:
        seen.add(len(data))
        return data

    rows = [(i, rasters._image(i, i)) for i in range(1, 41)]
    found = raster.with_ratios(spark.createDataFrame(rows, "id long, bytes binary").select("id", made("bytes").alias("bytes")))
    got = found.where("error is null").select("id", "fill_ratio").collect()
    assert sorted(r["id"] for r in got) == [i for i, _ in rows if i % 11] and seen.value == len(rows)


def test_bands_of_rows_join(monkeypatch):
    r = np.random.default_rng(5)
    for colour, depth in rasters.KINDS:
        pixels = np.zeros((37, 29, raster.SAMPLES[colour][0]), np.int64)
        pixels[3:31, 4:20] = r.integers(0, 1 << depth, pixels[3:31, 4:20].shape)
        for band in (1, 100, 1 << 20):
            monkeypatch.setattr(raster, "BAND", band)
            assert all(raster.drawn_box(rasters.png(pixels, colour, depth, interlaced, 2)) == brute_box(pixels) for interlaced in (False, True))


def test_all_filters_undo_what_was_filtered():
    r = np.random.default_rng(6)
    for step in (1, 3, 8):
        raw = r.integers(0, 256, (10, 12 * step)).astype(np.int16)
        raw[5:] //= 100
        held = np.frombuffer(rasters._filtered(raw, 3, step), np.uint8).reshape(10, -1)
        above = np.zeros(12 * step, np.uint8)
        for line, want in zip(held, raw, strict=True):
            above = raster.unfiltered(int(line[0]), line[1:], above, step)
            assert (above == want).all()
