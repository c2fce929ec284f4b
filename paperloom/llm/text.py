"""Byte-level tokenisation shared by the operators that scan texts in Arrow batches.

All rules are ASCII-only (other code points are word characters), so UTF-8 bytes can be handled without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A-Z to lower case; everything outside 0-9, a-z and non-ASCII bytes to a space.
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(WORD_BYTES).split()


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` text bytes (one row at least), so that memory doesn't depend on Arrow's batch size."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = [len(x) if x is not None else 0 for x in texts.cast(pa.binary()).to_pylist()] if texts.nbytes > limit else []
        if not sizes:
            if batch.num_rows:
                yield batch
            continue
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total + n > limit and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def set_aside(docs: DataFrame, own: list[str], replaced: list[str] = ()) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but ``own`` under names that no operator uses, without ``replaced``; and the names' meaning."""
    columns = [c for c in docs.columns if c not in replaced]
    names = {c if c in own else f"_carried_{i}": c for i, c in enumerate(columns)}
    return docs.select(*(F.col(f"`{c}`").alias(k) for k, c in names.items())), names


def bring_back(df: DataFrame, names: dict[str, str], new: list[str] = ()) -> DataFrame:
    """The columns that set_aside renamed, under their own names again, and ``new`` ones."""
    return df.select(*(F.col(k).alias(c) for k, c in names.items()), *new)
