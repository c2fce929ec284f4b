"""Compound files (the containers of embedded objects): their streams as rows.

A compound file is a header, and sectors chained by an allocation table. Small streams lie in mini sectors, inside one
stream of their own with a table of its own. A directory names the streams and orders them as trees of siblings. Every
chain and tree is walked with a bound on its steps and positions, so a damaged file ends in an error, never in a loop.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: signature, and the sector numbers that end chains or mark no entry.
SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
LAST_SECTOR, END_OF_CHAIN, NO_ENTRY = 0xFFFFFFFA, 0xFFFFFFFE, 0xFFFFFFFF
HEADER_ENTRIES, ENTRY_BYTES = 109, 128
STORAGE, STREAM, ROOT = 1, 2, 5

#: Bytes of streams that are handed on together, a file's at least.
BATCH_BYTES = 4 << 20
#: The stream of an embedded equation.
EQUATION = "Equation Native"


class DamagedFile(ValueError):
    """A compound file whose tables contradict each other or its size."""


class CompoundFile:
    """The streams of a compound file held in memory."""

    def __init__(self, data: bytes):
        if len(data) < 512 or data[:8] != SIGNATURE:
            raise DamagedFile("no compound file")
        self.data = memoryview(data)
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or not 1 <= mini_shift < shift:
            raise DamagedFile(f"sectors of 2**{shift} and 2**{mini_shift} bytes")
        self.sector, self.mini = 1 << shift, 1 << mini_shift
        self.sectors = -(-(len(data) - self.sector) // self.sector) if len(data) > self.sector else 0
        first_directory, = struct.unpack_from("<I", data, 48)
        self.cutoff, first_mini, _, first_more, _ = struct.unpack_from("<5I", data, 56)
        self.table = self._allocation(first_more)
        self.entries = self._directory(self._chain(first_directory, self.table, self.sectors))
        root = self.entries[0] if self.entries else None
        if root is None or root["kind"] != ROOT:
            raise DamagedFile("no root entry")
        self._mini_table = self._numbers(self._chain(first_mini, self.table, self.sectors))
        self._mini_stream = self._read(root["first"], root["size"], self.table, self.sector, self._sector_at)

    def _sector_at(self, i: int) -> memoryview:
        if i >= self.sectors:
            raise DamagedFile(f"sector {i} of {self.sectors}")
        # The header takes a whole sector; the last sector may be cut short.
        return self.data[(i + 1) * self.sector : (i + 2) * self.sector]

    def _mini_at(self, i: int) -> memoryview:
        part = self._mini_stream[i * self.mini : (i + 1) * self.mini]
        if not part:
            raise DamagedFile(f"mini sector {i} beyond the mini stream")
        return memoryview(part)

    @staticmethod
    def _chain(first: int, table: tuple[int, ...], bound: int) -> Iterator[int]:
        """The sectors of a chain; more than ``bound`` of them are a cycle."""
        steps = 0
        while first != END_OF_CHAIN and first != NO_ENTRY:
            steps += 1
            if steps > bound or first > LAST_SECTOR:
                raise DamagedFile("a chain without an end")
            yield first
            if first >= len(table):
                raise DamagedFile(f"sector {first} isn't allocated")
            first = table[first]

    def _numbers(self, chain: Iterator[int]) -> tuple[int, ...]:
        out: list[int] = []
        for i in chain:
            part = self._sector_at(i)
            out += struct.unpack(f"<{len(part) // 4}I", part[: len(part) // 4 * 4])
        return tuple(out)

    def _allocation(self, more: int) -> tuple[int, ...]:
        """The allocation table: its sectors are named in the header, then in a chain of sectors that link to the next."""
        named = list(struct.unpack_from(f"<{HEADER_ENTRIES}I", self.data, 76))
        for _ in range(self.sectors + 1):
            if more > LAST_SECTOR:
                break
            part = self._numbers(iter([more]))
            named += part[:-1]
            more = part[-1]
        else:
            raise DamagedFile("a chain without an end")
        # A sector may be named once only, so the table is no longer than the file.
        known = [x for x in named if x <= LAST_SECTOR]
        if len(set(known)) != len(known):
            raise DamagedFile("a sector of the allocation table is named twice")
        return self._numbers(iter(known))

    def _directory(self, chain: Iterator[int]) -> list[dict]:
        raw = b"".join(self._sector_at(i) for i in chain)
        out = []
        for at in range(0, len(raw) - ENTRY_BYTES + 1, ENTRY_BYTES):
            name_bytes, kind = struct.unpack_from("<HB", raw, at + 64)
            left, right, child = struct.unpack_from("<3I", raw, at + 68)
            first, low, high = struct.unpack_from("<3I", raw, at + 116)
            name = raw[at : at + max(0, min(64, name_bytes) - 2)].decode("utf-16-le", "replace")
            # Files of small sectors may leave rubbish in the upper half of a size.
            size = low if self.sector == 512 else low | high << 32
            out.append({"name": name, "kind": kind, "left": left, "right": right, "child": child, "first": first, "size": size})
        return out

    def _read(self, first: int, size: int, table: tuple[int, ...], unit: int, at) -> bytes:
        """``size`` bytes of a chain; no more sectors are read than they take."""
        if size > len(self.data):
            raise DamagedFile(f"a stream of {size} bytes in a file of {len(self.data)}")
        parts, left = [], size
        for i in self._chain(first, table, len(table) + 1):
            if left <= 0:
                break
            parts.append(bytes(at(i)[: min(unit, left)]))
            left -= len(parts[-1])
        if left > 0:
            raise DamagedFile(f"a stream ends {left} bytes early")
        return b"".join(parts)

    def streams(self) -> Iterator[tuple[str, int]]:
        """(path, entry) of all streams, by path; each entry of the directory is visited once at most."""
        seen, found = {0}, []
        stack = [("", self.entries[0]["child"])]
        while stack:
            path, i = stack.pop()
            if i == NO_ENTRY:
                continue
            if i >= len(self.entries) or i in seen:
                raise DamagedFile("the directory is no tree")
            seen.add(i)
            entry = self.entries[i]
            stack += [(path, entry["left"]), (path, entry["right"])]
            if entry["kind"] == STORAGE:
                stack.append((f"{path}{entry['name']}/", entry["child"]))
            elif entry["kind"] == STREAM:
                found.append((path + entry["name"], i))
        return iter(sorted(found))

    def read(self, entry: int) -> bytes:
        e = self.entries[entry]
        if e["size"] < self.cutoff:
            return self._read(e["first"], e["size"], self._mini_table, self.mini, self._mini_at)
        return self._read(e["first"], e["size"], self.table, self.sector, self._sector_at)


def ole_streams(files: DataFrame, names: tuple[str, ...] | None = None, column: str = "bytes") -> DataFrame:
    """``files`` with stream, size, data and error: a row for each stream of the compound files in ``column``.

    ``names`` keeps streams with such a last name (null: all). A file that is none, or is damaged, gives one row with
    an error in place of the streams that can't be read; null bytes are no file. A file without such streams gives no
    row. Other columns are carried; clashing names are replaced.
    """
    new = ["stream", "size", "data", "error"]
    kept = [c for c in files.columns if c not in new]
    others = [c for c in kept if c != column]
    files = files.select(*(F.col(f"`{c}`") for c in kept))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            rows: list[tuple] = []
            of: list[int] = []

            def made() -> pa.RecordBatch:
                kept = batch.select(others).take(pa.array(of, pa.int32()))  # noqa: B023
                values = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True)]  # noqa: B023
                return pa.RecordBatch.from_arrays([*kept.columns, *values], names=[*others, *new])

            held = 0
            for i in range(batch.num_rows):
                try:
                    data = batch.column(at)[i].as_py()
                    found = CompoundFile(data or b"")
                    for path, entry in found.streams():
                        if names is None or path.rpartition("/")[2] in names:
                            rows.append((path, found.entries[entry]["size"], found.read(entry), None))
                            held += len(rows[-1][2])
                except (DamagedFile, struct.error) as e:
                    rows.append((None, None, None, f"{type(e).__name__}: {e}"))
                of += [i] * (len(rows) - len(of))
                if held > BATCH_BYTES or len(rows) >= 1000:
                    yield made()
                    rows, of, held = [], [], 0
            if rows:
                yield made()

    carried = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in files.schema if f.name != column)
    return files.mapInArrow(read, carried + "stream string, size long, data binary, error string")
