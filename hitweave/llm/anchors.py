"""Winnowed anchors in numpy, for operators that look for repeated windows of words or bytes.

A text is a sequence of units (words or bytes) with a 64-bit hash each.  Every window of
``window`` units selects its least k-gram hash (the leftmost of equals): the window's *anchor*.
That depends on the window alone, so equal windows have equal anchors at equal places.  Windows
that follow each other with the same anchor form a *segment*; it reaches ``window - 1`` units past
its last window's start, and any window of it can be compared by the hash of its units.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

PIECE = 1 << 20  # units put through numpy together; longer texts go in pieces that overlap by a window
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)
_INDEX = np.uint64((1 << 24) - 1)
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Rolling:
    """Hashes of any span of a sequence of 64-bit numbers, from prefix sums modulo 2^64."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        powers = np.cumprod(np.full(n, _ODD, np.uint64))
        self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(units * powers)))
        self._back = np.cumprod(np.full(n + 1, _BACK, np.uint64))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sums[end] - self._sums[start]) * self._back[start])


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


def byte_units(data: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(data, np.uint8)]


def word_units(data: bytes) -> np.ndarray:
    """Hash of each word; words lie between the ASCII white space of ``bytes.split``."""
    raw = np.frombuffer(b" " + data + b" ", np.uint8)
    blank = BLANKS[raw]
    begin = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return Rolling(_BYTES[raw]).spans(begin, end)


@dataclass
class Segments:
    """Segments of some texts, in order: number of the text, first window's start, number of
    windows, anchor hash, and a hash of all units and the anchor's place."""
    text: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span:]) if width > span else values


def anchor_places(rolling: Rolling, n: int, gram: int, window: int, largest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a sequence of ``n`` units, the place of its least k-gram hash (with
    ``largest``, of its largest), and the hashes of all k-grams."""
    at = np.arange(n - gram + 1, dtype=np.uint64)
    h = rolling.spans(at.astype(np.int64), at.astype(np.int64) + gram)
    order = ~h if largest else h
    least = _least((order & ~_INDEX) | at, window - gram + 1)
    return (least & _INDEX).astype(np.int64), h


def segments(texts: list[np.ndarray], gram: int, window: int) -> Segments:
    """Segments of texts given as arrays of unit hashes."""
    parts: list[tuple[np.ndarray, ...]] = []
    for numbers, shifts, units in _groups(texts, window):
        sizes = np.array([len(u) for u in units])
        joined, ends = np.concatenate(units), np.cumsum(sizes)
        rolling = Rolling(joined)
        place, h = anchor_places(rolling, len(joined), gram, window)
        inside = np.repeat(ends, sizes)[: len(place)] - np.arange(len(place)) >= window  # windows of one text
        valid = np.flatnonzero(inside)
        if not len(valid):
            continue
        anchor = place[valid]
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        count = np.diff(np.concatenate((first, [len(valid)])))
        start, anchor = valid[first], anchor[first]
        content = rolling.spans(start, start + count + (window - 1))
        content = mixed(content + count.astype(np.uint64) * np.uint64(_ODD) + ((anchor - start).astype(np.uint64) << np.uint64(32)))
        group = np.searchsorted(ends, start, "right")
        parts.append((np.array(numbers)[group], start - (ends - sizes)[group] + np.array(shifts)[group], count, h[anchor], content))
    if not parts:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    return Segments(*(np.concatenate(x) for x in zip(*parts)))


def _groups(texts: list[np.ndarray], window: int) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
    """Texts with a window, several at a time; each with its number and the place it begins at."""
    numbers, shifts, units, size = [], [], [], 0
    for i, u in enumerate(texts):
        for at in range(0, max(len(u) - window + 1, 0), PIECE):
            piece = u[at:at + PIECE + window - 1]
            numbers.append(i)
            shifts.append(at)
            units.append(piece)
            size += len(piece)
            if size >= PIECE // 4:
                yield numbers, shifts, units
                numbers, shifts, units, size = [], [], [], 0
    if units:
        yield numbers, shifts, units


def first_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order: whether a row is the first with its values, and how many rows have them."""
    mix = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        mix = mixed(mix * np.uint64(_ODD) + c.astype(np.uint64))
    _, first, inverse, count = np.unique(mix, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(mix), bool)
    is_first[first] = True
    return is_first, count[inverse]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as disjoint, ordered intervals that do not touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(start) - 1]))
    return start[new], end[last]
