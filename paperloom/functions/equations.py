"""Equation records (the binary form of embedded equations, version 5) to LaTeX: bytes to a tree, the tree to text."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from paperloom.functions.omml import DELIMITERS, FUNCTIONS, escaped

# Fixed values of the format: record types.
END, LINE, CHAR, TEMPLATE, PILE, MATRIX, EMBELLISHMENT, RULER, FONT_STYLE, SIZE = range(10)
FULL, SUB_SYMBOL, COLOR, COLOR_DEF, FONT_DEF, PREFERENCES, ENCODING_DEF = 10, 14, 15, 16, 17, 18, 19
FUTURE = 100
# Option bits.
NUDGED, LINE_NULL, RULED, LINE_SPACED, EMBELLISHED, ENCODED_8, ENCODED_16, NO_CODE, CMYK, NAMED = 0x08, 0x01, 0x02, 0x04, 0x01, 0x04, 0x10, 0x20, 0x01, 0x04
# Typefaces (less 128) of texts, functions and vectors.
TEXT, FUNCTION, VECTOR = 1, 2, 7
# Template selectors.
FENCES = {0: ("⟨", "⟩"), 1: ("(", ")"), 2: ("{", "}"), 3: ("[", "]"), 4: ("|", "|"), 5: ("‖", "‖"), 6: ("⌊", "⌋"), 7: ("⌈", "⌉"), 8: ("[", "]"), 9: ("(", "]")}
ROOT, FRACTION, UNDER_BAR, OVER_BAR, INTEGRAL, LIMIT, SUB, SUP, SUB_SUP = 10, 11, 12, 13, 15, 23, 27, 28, 29
BIG = {15: r"\int", 16: r"\sum", 17: r"\prod", 18: r"\coprod", 19: r"\bigcup", 20: r"\bigcap", 21: r"\int", 22: r"\sum"}
OVER = {31: "overrightarrow", 32: "widetilde", 33: "widehat", 34: "overset{\\frown}", 12: "underline", 13: "overline", 37: "boxed"}
# Embellishments as commands around the character, and as marks behind it.
AROUND = {2: "dot", 3: "ddot", 4: "dddot", 8: "tilde", 9: "hat", 10: "not", 11: "vec", 12: "overleftarrow", 13: "overleftrightarrow", 17: "bar"}
BEHIND = {5: "'", 6: "''", 7: "`", 18: "'''"}
# Codes of blanks.
BLANKS = {0xEF02: r"\,", 0xEF04: r"\;", 0xEF05: r"\quad "}
#: Records nested deeper than this are no equation that was ever written.
DEPTH = 64


class BrokenEquation(ValueError):
    """Equation data that ends early, nests too deep, or isn't of version 5."""


@dataclass
class Node:
    kind: int
    selector: int = 0
    variation: int = 0
    #: Of a matrix: its number of columns.
    columns: int = 0
    code: int = 0
    children: list[Node | None] = field(default_factory=list)


class Records:
    """Reads nested records. Definitions, sizes, rulers and colours are skipped by their form, unknown records by their length."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        # A version, four bytes about the program, its key as a text, an option.
        self.version = self.byte()
        if self.version != 5:
            raise BrokenEquation(f"version {self.version}")
        self.skip(4)
        self.text()
        self.skip(1)

    def byte(self) -> int:
        if self.at >= len(self.data):
            raise BrokenEquation("the data ends early")
        self.at += 1
        return self.data[self.at - 1]

    def skip(self, n: int) -> None:
        if self.at + n > len(self.data):
            raise BrokenEquation("the data ends early")
        self.at += n

    def short(self) -> int:
        return self.byte() | self.byte() << 8

    def number(self) -> int:
        """A byte, or 255 and two bytes."""
        first = self.byte()
        return self.short() if first == 255 else first

    def text(self) -> None:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise BrokenEquation("a text without an end")
        self.at = end + 1

    def options(self) -> int:
        """The options of a record, and its nudge: two bytes, or two of 128 and four more."""
        found = self.byte()
        if found & NUDGED and (self.byte(), self.byte()) == (128, 128):
            self.skip(4)
        return found

    def nibbles(self, arrays: int) -> None:
        """Dimensions of half bytes (a unit, then digits up to 15), padded to whole bytes."""
        half: list[int] = []
        for _ in range(arrays):
            while True:
                if not half:
                    b = self.byte()
                    half = [b >> 4, b & 15]
                if half.pop(0) == 15:
                    break

    def ruler(self) -> None:
        self.skip(3 * self.byte())

    def objects(self, depth: int = 0) -> list[Node | None]:
        """The objects up to an end record, or the end of the data."""
        if depth > DEPTH:
            raise BrokenEquation("records nest too deep")
        out: list[Node | None] = []
        while self.at < len(self.data):
            kind = self.byte()
            if kind == END:
                return out
            if kind in (LINE, CHAR, TEMPLATE, PILE, MATRIX, EMBELLISHMENT):
                out.append(self.object(kind, depth))
            else:
                self.aside(kind)
        if depth:
            raise BrokenEquation("the data ends early")
        return out

    def object(self, kind: int, depth: int) -> Node | None:
        options = self.options()
        if kind == LINE:
            if options & LINE_SPACED:
                self.short()
            if options & RULED:
                self.skip(1)
                self.ruler()
            return None if options & LINE_NULL else Node(LINE, children=self.objects(depth + 1))
        if kind == CHAR:
            face = self.byte()
            code = 0 if options & NO_CODE else self.short()
            if options & ENCODED_8:
                place = self.byte()
                code = code or place
            if options & ENCODED_16:
                place = self.short()
                code = code or place
            return Node(CHAR, selector=face - 128, code=code, children=self.objects(depth + 1) if options & EMBELLISHED else [])
        if kind == TEMPLATE:
            selector, variation = self.byte(), self.byte()
            if variation & 0x80:
                variation = variation & 0x7F | self.byte() << 8
            self.skip(1)
            return Node(TEMPLATE, selector, variation, children=self.objects(depth + 1))
        if kind == PILE:
            self.skip(2)
            if options & RULED:
                self.skip(1)
                self.ruler()
            return Node(PILE, children=self.objects(depth + 1))
        if kind == MATRIX:
            self.skip(3)
            rows, columns = self.byte(), self.byte()
            # Two bits for each partition line.
            self.skip((rows + 4) // 4 + (columns + 4) // 4)
            return Node(MATRIX, columns=columns, children=self.objects(depth + 1))
        return Node(EMBELLISHMENT, selector=self.byte())

    def aside(self, kind: int) -> None:
        """Skip a record that shows nothing."""
        if kind >= FUTURE:
            self.skip(self.number())
        elif kind == RULER:
            self.ruler()
        elif kind == FONT_STYLE:
            self.number()
            self.skip(1)
        elif kind == SIZE:
            first = self.byte()
            self.skip(2 if first == 101 else 3 if first == 100 else 1)
        elif kind == COLOR:
            self.number()
        elif kind == COLOR_DEF:
            options = self.byte()
            self.skip(8 if options & CMYK else 6)
            if options & NAMED:
                self.text()
        elif kind == FONT_DEF:
            self.number()
            self.text()
        elif kind == PREFERENCES:
            self.skip(1)
            self.nibbles(self.byte())
            self.nibbles(self.byte())
            for _ in range(self.byte()):
                if self.byte():
                    self.skip(1)
        elif kind == ENCODING_DEF:
            self.text()
        elif not FULL <= kind <= SUB_SYMBOL:
            raise BrokenEquation(f"record {kind}")


def _character(node: Node) -> str:
    shown = BLANKS.get(node.code) or escaped(chr(node.code))
    shown = rf"\mathbf{{{shown}}}" if node.selector == VECTOR else shown
    for mark in node.children:
        if mark is not None and mark.kind == EMBELLISHMENT:
            shown = rf"\{AROUND[mark.selector]}{{{shown}}}" if mark.selector in AROUND else shown + BEHIND.get(mark.selector, "")
    return shown


def _slot(node: Node | None) -> str:
    return "" if node is None else _row([node])


def _template(node: Node) -> str:
    slots = [c for c in node.children if c is None or c.kind in (LINE, PILE)]
    part = [_slot(x) for x in slots] + [""] * 3
    if node.selector in FENCES:
        left, right = FENCES[node.selector]
        left, right = left if node.variation & 1 else "", right if node.variation & 2 else ""
        return rf"\left{DELIMITERS.get(left, left)}{part[0]}\right{DELIMITERS.get(right, right)}"
    if node.selector == FRACTION:
        return f"{part[0]}/{part[1]}" if node.variation & 2 else rf"\frac{{{part[0]}}}{{{part[1]}}}"
    if node.selector == ROOT:
        return rf"\sqrt{f'[{part[1]}]' if part[1] else ''}{{{part[0]}}}"
    if node.selector in (SUB, SUP, SUB_SUP):
        return (f"_{{{part[0]}}}" if part[0] else "") + (f"^{{{part[1]}}}" if part[1] else "")
    if node.selector in BIG or node.selector == LIMIT:
        low, high = (f"_{{{part[1]}}}" if part[1] else ""), (f"^{{{part[2]}}}" if part[2] else "")
        return f"{part[0]}{low}{high}" if node.selector == LIMIT else f"{BIG[node.selector]}{low}{high} {part[0]}"
    if node.selector in OVER:
        return rf"\{OVER[node.selector]}{{{part[0]}}}"
    return "".join(part)


def _row(nodes: list[Node | None]) -> str:
    """Objects side by side; neighbouring characters of a function or text make one name."""
    out: list[str] = []
    i = 0
    while i < len(nodes):
        node = nodes[i]
        i += 1
        if node is None:
            continue
        if node.kind == CHAR and node.selector in (FUNCTION, TEXT) and not node.children:
            name = chr(node.code)
            while i < len(nodes) and (x := nodes[i]) is not None and x.kind == CHAR and x.selector == node.selector and not x.children:
                name += chr(x.code)
                i += 1
            known = node.selector == FUNCTION and name in FUNCTIONS
            out.append(f"\\{name} " if known else (rf"\text{{{name}}}" if node.selector == TEXT else escaped(name)))
        elif node.kind == CHAR:
            shown = _character(node)
            # A command is set apart from a letter after it.
            if out and shown[:1].isalpha() and out[-1].startswith("\\") and out[-1][-1:].isalpha():
                out.append(" ")
            out.append(shown)
        elif node.kind == TEMPLATE:
            out.append(_template(node))
        elif node.kind == PILE:
            out.append(r"\begin{array}{l}" + r" \\ ".join(_slot(x) for x in node.children) + r"\end{array}")
        elif node.kind == MATRIX:
            cells, n = [_slot(x) for x in node.children], max(1, node.columns)
            out.append(r"\begin{matrix}" + r" \\ ".join(" & ".join(cells[k : k + n]) for k in range(0, len(cells), n)) + r"\end{matrix}")
        elif node.kind == LINE:
            out.append(_row(node.children))
    return "".join(out)


def equation_latex(data: bytes) -> str:
    """LaTeX of an equation stream: a header that gives its own length, then the records."""
    if len(data) < 2:
        raise BrokenEquation("the data ends early")
    header = int.from_bytes(data[:2], "little")
    return _row(Records(data[header:]).objects()).strip()


SHOWN = StructType([StructField("latex", StringType()), StructField("version", IntegerType()), StructField("error", StringType())])


def _equations(data: pd.Series) -> pd.DataFrame:
    rows = []
    for x in data:
        try:
            rows.append((None, None, None) if x is None else (equation_latex(x), 5, None))
        except BrokenEquation as e:
            rows.append((None, None, str(e)))
    return pd.DataFrame({"latex": [r[0] for r in rows], "version": pd.Series([r[1] for r in rows], dtype="Int32"), "error": [r[2] for r in rows]})


def equation(data: Column) -> Column:
    """LaTeX and version of equation streams; null and an error where one can't be read, all null for null."""
    # Made anew: a function that was used holds its session, and this module is sent to tasks as a whole.
    return pandas_udf(_equations, SHOWN)(data)
