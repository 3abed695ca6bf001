"""Words and their hashes over Arrow string columns, vectorised; shared by the text operators.

A word is a run of bytes outside a separator set; every set used here is ASCII, so UTF-8 is never cut inside a
character.  Words are hashed by a 64-bit polynomial over random byte codes, windows by a polynomial over word
hashes, both through prefix sums, so the cost does not depend on the window length.  Work goes over slices of
about a megabyte of text; one longer text is one slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tidemeter.llm.memo import per_process

SLICE = 1 << 20
BASE, WINDOW_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_CODES = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def byte_set(members) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


SPACES = byte_set([0x20, *range(0x09, 0x0E)])
#: Everything in ASCII but digits and letters.
MARKS = byte_set([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


@lru_cache(maxsize=None)
def _codes(lower: bool) -> np.ndarray:
    out = _CODES.copy()
    if lower:
        out[65:91] = out[97:123]
    return out


def _power_table(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    ups, downs = (np.full(size, x, dtype=np.uint64) for x in (base, pow(base, -1, 2**64)))
    ups[0] = downs[0] = 1
    return np.cumprod(ups), np.cumprod(downs)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``base`` and of its inverse, modulo 2**64; those for a slice are kept by the process."""
    size = max(SLICE + 2, n)
    if size > SLICE + 2:
        return _power_table(base, n)
    up, down = per_process(("powers", base, size), lambda: _power_table(base, size))
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(values: np.ndarray, up: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) \
        if len(column) else np.zeros(1, dtype=np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)), off


def slices(off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; every row is in exactly one."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of rows ``i`` to ``j``: ``start`` and ``end`` in ``data``, ``row`` (from 0), ``first`` word of each row."""

    def __init__(self, data: np.ndarray, off: np.ndarray, i: int, j: int, separators: np.ndarray = SPACES, lower: bool = False):
        base = off[i]
        self.data = data[base:off[j]]
        self.off = off[i:j + 1] - base
        self.lower = lower
        inside = ~separators[self.data]
        n = len(inside)
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        if n:
            cuts = self.off[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < n)]
            opens[cuts] = inside[cuts]
            closes[cuts - 1] = inside[cuts - 1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(j - i), self.counts)
        self._hash: np.ndarray | None = None
        self._window: tuple | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            up, down = powers(BASE, len(self.data))
            sums = _sums(_codes(self.lower)[self.data], up)
            self._hash = mix((sums[self.end] - sums[self.start]) * down[self.start]) if len(self) else np.zeros(0, dtype=np.uint64)
        return self._hash

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``size`` words inside one row, and their hashes."""
        n = len(self) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.row[:n] == self.row[size - 1:])
        return at, self.span_hash(at, size)

    def span_hash(self, at: np.ndarray, size) -> np.ndarray:
        """Hashes of the word runs from ``at``, ``size`` words each."""
        up, down = powers(WINDOW_BASE, len(self) + 1)
        if self._window is None:
            self._window = (_sums(self.hash, up[:len(self)]),)
        sums = self._window[0]
        return mix((sums[at + size] - sums[at]) * down[at] + np.asarray(size).astype(np.uint64))

    def text(self, k: int) -> bytes:
        return self.data[self.start[k]:self.end[k]].tobytes()


def anchors(words: Words, size: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Content-selected anchors: of any ``reach`` neighbouring windows of ``size`` words, the one of least hash (leftmost if equal).

    Returns the starts of all runs of ``reach`` windows, that is of size + reach - 1 words, the anchor of each
    run, the sorted distinct anchors, and their hashes.  Equal runs have their anchor at the same place.
    """
    at, h = words.windows(size)
    none = np.zeros(0, dtype=np.int64)
    if len(at) < reach:
        return none, none, none, np.zeros(0, dtype=np.uint64)
    full = np.full(len(words), np.iinfo(np.uint64).max, dtype=np.uint64)
    full[at] = h
    runs = np.flatnonzero(words.row[:len(words) - size - reach + 2] == words.row[size + reach - 2:])
    if not len(runs):
        return none, none, none, np.zeros(0, dtype=np.uint64)
    # Van Herk's sliding minimum over values whose ties go to the left.
    best = full.copy()
    where = np.arange(len(full))
    width = 1
    while width < reach:
        step = min(width, reach - width)
        a, b = best[:-step], best[step:]
        right = b < a
        best, where = np.where(right, b, a), np.where(right, where[step:], where[:-step])
        width += step
    owner = where[runs]
    picked = np.unique(owner)
    return runs, owner, picked, full[picked]
