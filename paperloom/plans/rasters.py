"""PNG images built by rule, of all colour types, filters and both orders of rows."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from paperloom.session import spread
from paperloom.sources.raster import PASSES, SAMPLES, SIGNATURE

KINDS = [(colour, depth) for colour, (_, depths) in SAMPLES.items() for depth in depths]
#: The images' sizes and what is drawn on them by the part's key, as SQL; ``_image`` draws the same.
BOXES = """
    select p_partkey, p_brand as file_id, p_size as name, p_partkey % 11 = 0 as damaged, 24 + p_size % 40 as width, 8 + p_partkey % 13 as height,
        1 + p_partkey % 7 as "left", p_partkey % 3 as top, 1 + p_size % 12 as wide, 1 + p_partkey % 5 as high
    from part"""


def _filtered(raw: np.ndarray, rule: int, step: int) -> bytes:
    """The rows of ``raw`` (int16), each behind its filter's number: from ``rule`` on, in turn."""
    out = np.zeros((len(raw), raw.shape[1] + 1), np.int16)
    out[:, 0] = (rule + np.arange(len(raw))) % 5
    above, left, corner = np.zeros((3, *raw.shape), np.int16)
    above[1:], left[:, step:], corner[1:, step:] = raw[:-1], raw[:, :-step], raw[:-1, :-step]
    of = [slice((k - rule) % 5, None, 5) for k in range(5)]
    guess = np.zeros_like(raw)
    guess[of[1]], guess[of[2]], guess[of[3]] = left[of[1]], above[of[2]], (left[of[3]] + above[of[3]]) >> 1
    a, b, c = left[of[4]], above[of[4]], corner[of[4]]
    across, down, both = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    guess[of[4]] = np.where((across <= down) & (across <= both), a, np.where(down <= both, b, c))
    out[:, 1:] = (raw - guess) & 255
    return out.astype(np.uint8).tobytes()


def _packed(pixels: np.ndarray, depth: int) -> np.ndarray:
    """The bytes of rows of pixels (rows, columns, samples)."""
    rows = pixels.reshape(len(pixels), -1)
    if depth == 8:
        return rows.astype(np.int16)
    if depth == 16:
        return rows.astype(">u2").view(np.uint8).astype(np.int16)
    bits = (rows[:, :, None] >> np.arange(depth - 1, -1, -1)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(len(rows), -1), axis=1).astype(np.int16)


def png(pixels: np.ndarray, colour: int, depth: int, interlaced: bool = False, rule: int = 0) -> bytes:
    """A PNG of ``pixels`` (rows, columns, samples); the filters follow one another from ``rule`` on."""
    height, width, samples = pixels.shape
    step, body = max(1, samples * depth // 8), b""
    for x0, y0, dx, dy in PASSES if interlaced else ((0, 0, 1, 1),):
        part = pixels[y0::dy, x0::dx]
        body += _filtered(_packed(part, depth), rule, step) if part.size else b""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    packed = zlib.compress(body)
    palette = chunk(b"PLTE", bytes(3 * 2**depth)) if colour == 3 else b""
    halves = chunk(b"IDAT", packed[: len(packed) // 2]) + chunk(b"IDAT", packed[len(packed) // 2 :])
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + palette + halves + chunk(b"IEND", b"")


def _image(key: int, size: int) -> bytes:
    colour, depth = KINDS[key % len(KINDS)]
    samples = SAMPLES[colour][0]
    pixels = np.full((8 + key % 13, 24 + size % 40, samples), key % 2, np.int64)
    left, top = 1 + key % 7, key % 3
    # The last sample tells what is drawn from the ground.
    pixels[top : top + 1 + key % 5, left : left + 1 + size % 12, -1] = (1 << depth) - 1 if key % 2 == 0 else 0
    found = png(pixels, colour, depth, key % 4 == 3, key)
    return found[: len(found) * 2 // 3] if key % 11 == 0 else found


@pandas_udf(BinaryType())
def _images(key: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([_image(int(k), int(n)) for k, n in zip(key, size, strict=True)])


def images(part: DataFrame) -> DataFrame:
    """(p_partkey, file_id, name, bytes): an image for each part; every eleventh ends early."""
    part = spread(part.select("p_partkey", "p_brand", "p_size"), "p_partkey")
    return part.select("p_partkey", F.col("p_brand").alias("file_id"), F.col("p_size").alias("name"), _images(F.col("p_partkey"), F.col("p_size")).alias("bytes"))
