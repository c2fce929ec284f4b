"""Sizes of PNG images and of what is drawn on them, decoded row by row in Arrow batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from paperloom.operators.stats import needs_normalising

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Samples of a pixel by colour type, with the bit depths allowed.
SAMPLES = {0: (1, (1, 2, 4, 8, 16)), 2: (3, (8, 16)), 3: (1, (1, 2, 4, 8)), 4: (2, (8, 16)), 6: (4, (8, 16))}
# The passes of an interlaced image as first column, first row, and the steps of both.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Bytes of rows that are unpacked at once, a row at least.
BAND = 1 << 20
SIZES = ("width", "height", "left", "top", "trimmed_width", "trimmed_height")
BOX = StructType([*(StructField(c, IntegerType()) for c in SIZES), StructField("error", StringType())])


class DamagedImage(ValueError):
    """Bytes that are no PNG image, or end too early."""


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            raise DamagedImage("a chunk goes beyond the end")
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def unfiltered(rule: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row's bytes from the filtered ones and the row above; ``step`` is the distance to the pixel on the left."""
    if rule == 0:
        return row
    if rule == 1:
        return row.reshape(-1, step).cumsum(axis=0, dtype=np.uint8).ravel()
    if rule == 2:
        return row + above
    if rule not in (3, 4):
        raise DamagedImage(f"filter {rule}")
    out, up = bytearray(step) + row.tobytes(), bytes(step) + above.tobytes()
    if rule == 3:
        for i in range(step, len(out)):
            out[i] = (out[i] + ((out[i - step] + up[i]) >> 1)) & 255
        return np.frombuffer(out, np.uint8)[step:]
    for i in range(step, len(out)):
        left, over, corner = out[i - step], up[i], up[i - step]
        # The neighbour nearest to left + over - corner; of equals the left one, then the upper.
        if left == corner:
            guess = over
        elif over == corner:
            guess = left
        else:
            across, down, both = abs(over - corner), abs(left - corner), abs(left + over - 2 * corner)
            guess = left if across <= down and across <= both else over if down <= both else corner
        out[i] = (out[i] + guess) & 255
    return np.frombuffer(out, np.uint8)[step:]


def drawn_box(data: bytes) -> tuple:
    """(width, height, left, top, trimmed width, trimmed height): the box of all pixels unlike the first one.

    Samples are compared as they are stored, palette entries by number. An image of one colour has a box of 0 by 0 at
    null. Rows are unpacked in bands of about a megabyte, so a small file that holds a huge image takes its rows' time, not
    their memory.
    """
    if not data.startswith(SIGNATURE):
        raise DamagedImage("no PNG signature")
    parts = list(chunks(data))
    if not parts or parts[0][0] != b"IHDR" or len(parts[0][1]) != 13:
        raise DamagedImage("no header")
    width, height, depth, colour, packing, filtering, interlaced = struct.unpack(">IIBBBBB", parts[0][1])
    samples, depths = SAMPLES.get(colour, (0, ()))
    if not (0 < width < 2**31 and 0 < height < 2**31 and depth in depths) or packing or filtering or interlaced > 1:
        raise DamagedImage("header out of range")
    bits = samples * depth
    step = max(1, bits // 8)
    packed = zlib.decompressobj()
    waiting = b"".join(body for kind, body in parts if kind == b"IDAT")

    def take(size: int) -> bytes:
        nonlocal waiting
        got = packed.decompress(waiting, size)
        waiting = packed.unconsumed_tail
        while len(got) < size:
            more = packed.decompress(waiting, size - len(got))
            waiting = packed.unconsumed_tail
            if not more:
                raise DamagedImage("image data end early")
            got += more
        return got

    first, columns, rows = None, [], []
    for x0, y0, dx, dy in PASSES if interlaced else ((0, 0, 1, 1),):
        wide = -(-(width - x0) // dx)
        if wide <= 0:
            continue
        size = -(-wide * bits // 8)
        above, ys, some = np.zeros(size, np.uint8), range(y0, height, dy), max(1, BAND // (size + 1))
        for at in range(0, len(ys), some):
            n = len(ys[at : at + some])
            raw = np.frombuffer(take(n * (size + 1)), np.uint8).reshape(n, size + 1)
            lines = np.empty((n, size), np.uint8)
            for i, rule in enumerate(raw[:, 0].tolist()):
                above = lines[i] = unfiltered(rule, raw[i, 1:], above, step)
            pixels = np.unpackbits(lines, axis=1)[:, : wide * bits].reshape(n, wide, bits) if bits < 8 else lines.reshape(n, wide, step)
            first = pixels[0, 0].copy() if first is None else first
            unlike = pixels != first
            down = np.flatnonzero(unlike.reshape(n, -1).any(axis=1))
            if len(down):
                across = np.flatnonzero(unlike.any(axis=0).any(axis=1))
                columns = [min([x0 + dx * int(across[0]), *columns[:1]]), max([x0 + dx * int(across[-1]), *columns[1:]])]
                rows = [min([ys[at + int(down[0])], *rows[:1]]), max([ys[at + int(down[-1])], *rows[1:]])]
    if not columns:
        return width, height, None, None, 0, 0
    return width, height, columns[0], rows[0], columns[1] - columns[0] + 1, rows[1] - rows[0] + 1


@pandas_udf(BOX)
def png_box(data: pd.Series) -> pd.DataFrame:
    """``drawn_box`` of each image, or an error; null for null bytes."""
    found = []
    for x in data:
        try:
            found.append((None,) * 7 if x is None else (*drawn_box(x), None))
        except (DamagedImage, zlib.error) as e:
            found.append((*(None,) * 6, f"{type(e).__name__}: {e}"))
    out = pd.DataFrame(found, columns=[*SIZES, "error"])
    return out.astype(dict.fromkeys(SIZES, "Int32"))


# Called deterministic, it would be pushed down with filters on its fields: images would be read once for the filter, in
# tasks as few as the files, and once more for the fields.
png_box = png_box.asNondeterministic()


def with_ratios(images: DataFrame, column: str = "bytes") -> DataFrame:
    """``images`` with the fields of ``png_box``, fill_ratio, height_ratio and normalise in place of ``column``.

    The ratios are the drawn part's width and height to the image's; 0 where nothing is drawn, null for damaged images.
    """
    new = [*SIZES, "error"]
    kept = [F.col(f"`{c}`") for c in images.columns if c not in {*new, column, "fill_ratio", "height_ratio", "normalise"}]
    out = images.select(*kept, png_box(F.col(column)).alias("_box")).select(*kept, *[F.col(f"_box.{c}").alias(c) for c in new])
    out = out.withColumns({"fill_ratio": F.col("trimmed_width") / F.col("width"), "height_ratio": F.col("trimmed_height") / F.col("height")})
    return out.withColumn("normalise", needs_normalising(F.col("fill_ratio"), F.col("height_ratio")))
