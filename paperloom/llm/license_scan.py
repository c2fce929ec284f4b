"""License scans: exact phrases by word, and short notices with bounded errors.

A notice of L characters may differ by k = L // 10 edits. Cut into k + 1 pieces, one piece at least is untouched
(pigeonhole), so an Aho-Corasick scan for all pieces finds every place where a notice may stand. A bit-parallel edit
distance, linear in these places' characters, leaves those where some stretch is within k edits; the regex library's
bounded-error matching then verifies the window around each such place and reports span and edits. The words that tell
licenses apart have a bound of their own (KEYS), so that no other license's name passes for an edit.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.llm.text import small_batches, text_bytes, words

# Exact phrases, and short notices in normalised form (lower case, words with one space between).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = (
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under a creative commons attribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Words that must stand in the text as words of their own, with one edit at most from KEY_EDIT letters on, else with none.
KEYS = set("gnu general lesser affero apache mit hereby granted free source binary without mozilla public creative commons attribution copy modify distribute any unencumbered".split())
KEY_EDIT = 6
SCHEMA_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<struct<label: string, first: int, end: int, edits: int>>"


def allowed(notice: str) -> int:
    return len(notice) // 10


def pieces(notice: str) -> list[tuple[int, str]]:
    """(offset, piece): allowed + 1 pieces of nearly equal length."""
    n = allowed(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def keyed(notice: str) -> str:
    """A pattern of the notice with its KEYS bounded one by one; its edits in all are for the caller to bound."""
    out, rest = "", ""

    def fuzzy(x: str) -> str:
        return f"(?:{x}){{e<={allowed(notice)}}}" if x else ""

    for i, word in enumerate(notice.split()):
        rest += " " if i else ""
        if word in KEYS:
            out += fuzzy(rest) + rf"(?<![^ ])(?:{word}){'{e<=1}' if len(word) >= KEY_EDIT else ''}(?![^ ])"
            rest = ""
        else:
            rest += word
    return out + fuzzy(rest)


def base_places(tokens: list[bytes], spaced: bytes) -> list[tuple[int, str]]:
    """(word index, label) of every place of a phrase; ``spaced``: the words with one space before, between and after."""
    found = []
    for phrase, label in PHRASES.items():
        sought, at = f" {phrase} ".encode(), -1
        while (at := spaced.find(sought, at + 1)) >= 0:
            found.append((spaced.count(b" ", 0, at + 1) - 1, label))
    return sorted(found)


class Scanner:
    def __init__(self):
        import ahocorasick
        import regex

        self.masks = [{c: sum(1 << j for j, x in enumerate(notice) if x == c) for c in notice} for _, notice in NOTICES]
        # Key words that allow no edit must stand in a match as they are.
        self.fixed = [[f" {w} " for w in notice.split() if w in KEYS and len(w) < KEY_EDIT] for _, notice in NOTICES]
        self.keyed = [regex.compile(f"(?b){keyed(notice)}") for _, notice in NOTICES]
        held: dict[str, list[tuple[int, int]]] = {}
        for i, (_, notice) in enumerate(NOTICES):
            for offset, piece in pieces(notice):
                held.setdefault(piece, []).append((i, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, places in held.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()

    def ends(self, i: int, text: str, a: int, b: int) -> list[int]:
        """Where in text[a:b] a stretch ends that is the notice with the edits allowed, or fewer.

        The columns of the edit-distance table are kept as bits of their steps up and down, and one sum carries the
        steps from row to row, so that a character takes a few operations on integers of the notice's length.
        """
        masks, n, k = self.masks[i], len(NOTICES[i][1]), allowed(NOTICES[i][1])
        every, top = (1 << n) - 1, 1 << (n - 1)
        up, down, distance, out = every, 0, n, []
        for j in range(a, min(b, len(text))):
            equal = masks.get(text[j], 0)
            level = equal | down
            cross = (((equal & up) + up) ^ up) | equal
            right, left = down | (every & ~(cross | up)), up & cross
            if right & top:
                distance += 1
            elif left & top:
                distance -= 1
            right, left = right << 1 & every, left << 1 & every
            up, down = left | (every & ~(level | right)), right & level
            if distance <= k:
                out.append(j + 1)
        return out

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """Places that may hold a notice; each is whole in one of them, and none is wide enough for two."""
        found: dict[int, set[int]] = {}
        for last, (length, places) in self.seeds.iter(text):
            for i, offset in places:
                found.setdefault(i, set()).add(last + 1 - length - offset)
        out = {}
        for i, starts in found.items():
            n, k = len(NOTICES[i][1]), allowed(NOTICES[i][1])
            merged: list[list[int]] = []
            for s in sorted(starts):
                if merged and s - merged[-1][0] <= n // 4:
                    merged[-1][1] = s
                else:
                    merged.append([s, s])
            places = [(max(0, a - k), b + n + k) for a, b in merged]
            # Windows overlap; each stretch of them is read once.
            joined: list[list[int]] = []
            for a, b in places:
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            ends = [e for a, b in joined for e in self.ends(i, text, a, b)]
            out[i] = [(a, b) for a, b in places if (at := bisect_left(ends, a + n - k)) < len(ends) and ends[at] <= b]
        return out

    def best(self, i: int, text: str, a: int, b: int) -> tuple[int, int, int, int, int] | None:
        """(edits, first, end, a, b) of the notice's best match in text[a:b]."""
        # Searched in the text itself: a part may begin within a word, which the lookbehind must see.
        part = f" {text[max(0, a - 1) : b + 1]} "
        if not all(w in part for w in self.fixed[i]) or not (m := self.keyed[i].search(text, a, min(b, len(text)))):
            return None
        edits = sum(m.fuzzy_counts)
        return (edits, m.start(), m.end(), a, b) if edits <= allowed(NOTICES[i][1]) else None

    def spans(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(label, first and end character of the normalised text, edits, notice's length): the matches of each notice that don't overlap better ones."""
        found = []
        for i, windows in sorted(self.windows(text).items()):
            label, notice = NOTICES[i]
            heap = [m for a, b in windows if (m := self.best(i, text, a, b))]
            heapify(heap)
            taken: list[tuple[int, int, int]] = []
            while heap:
                edits, first, end, a, b = heappop(heap)
                at = bisect_left(taken, (first,))
                near = [t for t in taken[max(0, at - 1) : at + 1] if t[0] < end and first < t[1]]
                if not near:
                    insort(taken, (first, end, edits))
                    continue
                # What is left of the window beside the better match may hold another one.
                for c, d in ((a, near[0][0]), (near[0][1], b)):
                    if d - c >= len(notice) - allowed(notice) and (m := self.best(i, text, c, d)):
                        heappush(heap, m)
            found += [(label, *t, len(notice)) for t in taken]
        return found


def scan_licenses(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all but its text, unless named) with the scan's result.

    n_words; n_base, first_word, last_word: places of the exact phrases (first and last null without any); base_labels,
    labels: sorted distinct arrays, labels with those of notices; score: 1 with a phrase, else 1 - edits / length of
    the best notice, else 0; spans: notices found, as characters of the normalised text. Null or empty text: no words,
    no labels, score 0. Clashing column names are replaced. Every row stands alone, so repeats are scanned alike, and long
    texts are scanned whole, in time about linear in their words and in the notices found.
    """
    names = [c for c in columns or docs.columns if c not in SCHEMA_NAMES and (columns or c != "text")]
    docs = docs.drop(*SCHEMA_NAMES)
    kept = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in small_batches(batches):
            out = [[] for _ in SCHEMA_NAMES]
            for text in text_bytes(batch.column(batch.schema.get_field_index("text"))):
                tokens = words(text)
                spaced = b" " + b" ".join(tokens) + b" "
                base = base_places(tokens, spaced)
                spans = scanner.spans(spaced[1:-1].decode("utf-8", "replace"))
                own = sorted({label for _, label in base})
                score = 1.0 if base else max((1 - edits / length for *_, edits, length in spans), default=0.0)
                row = (len(tokens), len(base), base[0][0] if base else None, base[-1][0] if base else None, own, sorted({*own, *(s[0] for s in spans)}), score, [dict(zip(("label", "first", "end", "edits"), s[:4], strict=True)) for s in spans])
                for values, value in zip(out, row, strict=True):
                    values.append(value)
            strings = pa.list_(pa.string())
            kinds = [pa.int64()] * 4 + [strings, strings, pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names=[*names, *SCHEMA_NAMES])

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, "".join(f"`{c}` {kept[c]}, " for c in names) + SCHEMA)
