"""Periodic runs of words, by a suffix automaton and link-cut access.

The automaton of a word sequence has, as its suffix links, a tree: the path from the state of a prefix to the root
holds all its suffixes, longest first. Every state knows where its words last ended. Appending word ``i`` recolours the
path of prefix ``i`` with ``i``; the path falls into segments that shared an earlier end ``e`` so far. Up to ``L`` words
(the longest of a segment) ended at ``e`` and end at ``i`` again: with the distance ``d = i - e`` and ``L >= d`` that is
a square of period ``d``, and with ``L`` words to its left the repetition that ends at ``i`` starts at
``i - d - L + 1``. The greatest end seen for a start and a period is the run's end.

The preferred paths of the link-cut tree are splay trees by depth; all of a path has one colour, kept at its splay root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.llm.text import bring_back, set_aside, small_batches, text_bytes

#: Rounds of narrowing in ``repetitive_parts``; each only leaves out words that no run can touch.
ROUNDS = 6


class Automaton:
    """The suffix automaton of a sequence: ``length`` and suffix ``link`` of each state, and the state of each prefix.

    Most states have one transition, kept in two lists; only states with more have a dictionary.
    """

    def __init__(self, sequence: list[int]):
        self.length, self.link = [0], [-1]
        self.word, self.target, self.more = [-1], [0], {}
        self.ends = []
        last = 0
        for w in sequence:
            last = self._append(last, w)
            self.ends.append(last)

    def _next(self, state: int, w: int) -> int:
        """The state after ``w``, or -1."""
        if self.word[state] == w:
            return self.target[state]
        held = self.more.get(state)
        return -1 if held is None else held.get(w, -1)

    def _set(self, state: int, w: int, target: int) -> None:
        if self.word[state] == w or self.word[state] == -1:
            self.word[state], self.target[state] = w, target
        else:
            self.more.setdefault(state, {})[w] = target

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.word.append(-1)
        self.target.append(0)
        return len(self.length) - 1

    def _append(self, last: int, w: int) -> int:
        new, at = self._state(self.length[last] + 1, 0), last
        while at != -1 and (q := self._next(at, w)) == -1:
            self._set(at, w, new)
            at = self.link[at]
        if at == -1:
            return new
        if self.length[q] == self.length[at] + 1:
            self.link[new] = q
            return new
        copy = self._state(self.length[at] + 1, self.link[q])
        self.word[copy], self.target[copy] = self.word[q], self.target[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        self.link[q] = self.link[new] = copy
        while at != -1 and self._next(at, w) == q:
            self._set(at, w, copy)
            at = self.link[at]
        return new


class LastEnds:
    """A link-cut tree over the automaton's suffix links, whose preferred paths are coloured with their words' last end."""

    def __init__(self, automaton: Automaton):
        n = len(automaton.length)
        self.length = automaton.length
        # States are counted from 1 here; 0 is nobody. At first every state is a path of its own below its link.
        self.parent = [0] + [x + 1 for x in automaton.link]
        self.left, self.right = [0] * (n + 1), [0] * (n + 1)
        self.colour = [-1] * (n + 1)

    def _splay(self, x: int) -> int:
        """Make ``x`` the root of its splay tree; returns the path's colour."""
        parent, left, right = self.parent, self.left, self.right
        y = x
        while (p := parent[y]) and (left[p] == y or right[p] == y):
            y = p
        colour = self.colour[y]
        while (p := parent[x]) and (left[p] == x or right[p] == x):
            g = parent[p]
            if g and (left[g] == p or right[g] == p):
                # The lower edge turns last, the upper one or the same one first.
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)
        return colour

    def _rotate(self, x: int) -> None:
        parent, left, right = self.parent, self.left, self.right
        p = parent[x]
        g = parent[p]
        if left[p] == x:
            inner = right[x]
            left[p], right[x] = inner, p
        else:
            inner = left[x]
            right[p], left[x] = inner, p
        if inner:
            parent[inner] = p
        parent[p], parent[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """Recolour the path from ``state`` to the root with ``end``; (earlier end, longest length) of its segments, longest first."""
        parent, right, colour = self.parent, self.right, self.colour
        segments, below, x = [], 0, state + 1
        while x:
            held = self._splay(x)
            if held >= 0:
                segments.append((held, self.length[x - 1]))
            lower = right[x]
            if lower:
                colour[lower] = held
            right[x] = below
            below, x = x, parent[x]
        colour[below] = end
        return segments


def runs_of(sequence: list[int], least: int, exponent: int) -> dict[tuple[int, int], int]:
    """{(start, period): end} of the runs of at least ``least`` words and ``exponent`` (at least 2) periods."""
    automaton = Automaton(sequence)
    tree, found, fewer = LastEnds(automaton), {}, exponent - 1
    for i, state in enumerate(automaton.ends):
        for e, length in tree.access(state, i):
            period = i - e
            if length >= fewer * period and length + period >= least:
                found[i - period - length + 1, period] = i
    return found


def repetitive_parts(ids: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Disjoint parts (first, end) that together hold every run, in order.

    In a run of period q, every pair of words from the run's word q on stood at most q words before. So there are
    ``length - q - 1`` such pairs in a row, each at a distance of at most q, and a row of m pairs holds only runs of
    (exponent - 1) * q - 1 <= m. Pairs farther from their predecessor than that cannot belong to a run's row; leaving
    them out shortens rows, so the rule is applied again.
    """
    if len(ids) < least:
        return []
    pairs = ids[:-1] * (int(ids.max()) + 1) + ids[1:]
    order = np.argsort(pairs, kind="stable")
    distance = np.full(len(pairs), len(ids), np.int64)
    same = pairs[order[1:]] == pairs[order[:-1]]
    distance[order[1:][same]] = (order[1:] - order[:-1])[same]
    held = distance < len(ids)
    for _ in range(ROUNDS):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], held.astype(np.int8), [0])))).reshape(-1, 2)
        most = (edges[:, 1] - edges[:, 0] + 1) // (exponent - 1)
        kept = np.zeros(len(held) + 1, np.int64)
        kept[edges[:, 0]] = most
        kept[edges[:, 1]] -= most
        narrowed = held & (distance <= np.cumsum(kept[:-1]))
        if narrowed.sum() == held.sum():
            break
        held = narrowed
    edges = np.flatnonzero(np.diff(np.concatenate(([0], held.astype(np.int8), [0])))).reshape(-1, 2)
    reach = (edges[:, 1] - edges[:, 0] + 1) // (exponent - 1)
    out: list[tuple[int, int]] = []
    for first, end in sorted((max(0, a - q), b + 1) for (a, b), q in zip(edges.tolist(), reach.tolist(), strict=True) if q):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((first, end))
    return [(a, b) for a, b in out if b - a >= least]


def find_runs(ids: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    found = set()
    for first, end in repetitive_parts(ids, least, exponent):
        for (start, period), last in runs_of(ids[first:end].tolist(), least, exponent).items():
            start, last = start + first, last + first
            # A part's border is no border of the text.
            if start == first:
                while start and ids[start - 1] == ids[start - 1 + period]:
                    start -= 1
            if last == end - 1:
                while last + 1 < len(ids) and ids[last + 1] == ids[last + 1 - period]:
                    last += 1
            found.add((start, last - start + 1, period))
    return sorted(found, key=lambda x: (x[0], x[2]))


SCHEMA = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, runs array<struct<start: long, length: long, period: long>>, collapsed_text string"
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """``docs`` with the periodic runs of their words.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch with smallest period q and at least
    ``max(least, exponent * q)`` words that can't be extended with that period. Added: n_words, n_runs; start, length,
    period and exponent_milli (floor(1000 * length / period)) of the longest run (ties: smallest start, then period;
    null without runs); runs (by start, then period) and runs_sha256 of their lines ``start,length,period``;
    collapsed_text, the words joined by one space without those that any run holds after its first q words.

    Null and empty texts have no words, no runs and an empty collapsed text. Rows that repeat count apiece; an empty
    table gives an empty result. Other columns are carried, clashing names replaced. Texts are taken whole; a task holds
    about 0.4 KB for each word of the longest stretch that repeats closely, and much less for other words.
    """
    if exponent < 2 or least < 3:
        raise ValueError("runs have at least two periods and three words")
    new = ["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "runs", "collapsed_text"]
    docs, names = set_aside(docs, ["text"], new)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = [_row(text, least, exponent) for text in text_bytes(batch.column(batch.schema.get_field_index("text")))]
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.string()), pa.array(columns[7], RUNS)]
            texts = pa.array(columns[8], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays, texts], names=[*batch.schema.names, *new])

    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return bring_back(docs.mapInArrow(scan, f"{carried}, {SCHEMA}"), names, new)


def _row(text: bytes, least: int, exponent: int) -> tuple:
    words = text.split()
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    runs = find_runs(ids, least, exponent)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    if runs:
        edges = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs:
            edges[s + q] += 1
            edges[s + n] -= 1
        words = [w for w, gone in zip(words, (np.cumsum(edges) > 0).tolist(), strict=False) if not gone]
    first = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    listed = [{"start": s, "length": n, "period": q} for s, n, q in runs]
    return (len(ids), len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), listed, b" ".join(words))
