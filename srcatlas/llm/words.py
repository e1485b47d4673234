"""Vectorised words, word hashes and word windows over Arrow string columns.

A word is a maximal run of characters other than space, tab, LF, VT, FF and CR.
Those six are ASCII, so words are found on the UTF-8 bytes of a whole Arrow
column at once. Hashes are 64 bits wide; all arithmetic wraps modulo 2**64.

A word's hash is the sum of a random number for each (place, byte) in it: tabulation
hashing, under which any two words of whatever structure meet with probability 2**-64.
Other salts give hashes that are independent of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of text handled at once; a longer document is handled alone, whole.
CHUNK_BYTES = 1 << 19

#: Places in a word whose random numbers are kept in a table; those beyond are computed.
_PLACES = 64
_SPAN_BASE = 0xC2B2AE3D27D4EB4F


class _Powers:
    """Growing tables of base**i and base**-i modulo 2**64."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            self.up, self.down = (self._table(b, size) for b in (self.base, pow(self.base, -1, 1 << 64)))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_SPANS = _Powers(_SPAN_BASE)
_TABLES: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers(index: np.ndarray, salt: int) -> np.ndarray:
    return mix(mix(index + np.uint64(0x9E3779B97F4A7C15)) + np.uint64(salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))


class Words(NamedTuple):
    """Words of documents lo..hi of a column. first has one entry more than there are documents."""

    lo: int
    hi: int
    data: np.ndarray  # bytes of these documents
    bounds: np.ndarray  # byte bounds of each document in data
    start: np.ndarray  # byte bounds of each word in data
    end: np.ndarray
    first: np.ndarray  # index of each document's first word

    def hashes(self, salt: int = 0) -> np.ndarray:
        if salt not in _TABLES:
            _TABLES[salt] = _numbers(np.arange(_PLACES << 8, dtype=np.uint64), salt)
        at = np.arange(len(self.data))
        begin = np.zeros(len(self.data), np.int64)
        begin[self.start] = self.start
        place = at - np.maximum.accumulate(begin)  # of a byte in its word; of no use between words
        index = place << 8 | self.data
        number = _TABLES[salt][np.minimum(index, (_PLACES << 8) - 1)]
        if len(self.start) and int((self.end - self.start).max()) > _PLACES:
            far = np.flatnonzero(place >= _PLACES)
            number[far] = _numbers(index[far].astype(np.uint64), salt)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(number, out=total[1:])
        return mix((total[self.end] - total[self.start]) + (self.end - self.start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts())


def spans(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each sequence of words start..end, over word hashes."""
    x = hashes
    up, down = _SPANS.of(len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def window_starts(first: np.ndarray, k: int, short: bool = False) -> np.ndarray:
    """Starts of all windows of k words inside one document; with short, also of a shorter document's only one."""
    n = int(first[-1])
    last = np.repeat(first[1:], np.diff(first))
    at = np.arange(n)
    keep = at + k <= last
    if short:
        keep[first[:-1][np.diff(first) > 0]] = True
    return at[keep]


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, independent hash) of each k-word shingle; a document of fewer words has one, of all its words."""
    start = window_starts(words.first, k, short=True)
    last = np.repeat(words.first[1:], words.counts())
    end = np.minimum(start + k, last[start]) if len(start) else start
    return words.doc()[start], spans(words.hashes(), start, end), spans(words.hashes(1), start, end)


#: For language models: runs of ASCII letters and of all bytes beyond ASCII are words, and ASCII letters lose their case.
NOT_LETTER = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])
FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def tokenized(column: pa.Array | pa.ChunkedArray, chunk: int = CHUNK_BYTES, breaks: np.ndarray = IS_SPACE, fold: np.ndarray | None = None) -> Iterator[Words]:
    """The words of every document of a string column, some documents at a time; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk, "right")) - 1)
        own = data[offsets[lo] : offsets[hi]]
        yield _words(lo, hi, own if fold is None else fold[own], offsets[lo : hi + 1] - offsets[lo], breaks)
        lo = hi


def _words(lo: int, hi: int, data: np.ndarray, bounds: np.ndarray, breaks: np.ndarray) -> Words:
    ink = ~breaks[data]
    opens, closes = ink.copy(), ink.copy()
    opens[1:] &= ~ink[:-1]
    closes[:-1] &= ~ink[1:]
    inner = bounds[1:-1]
    at = inner[(inner > 0) & (inner < len(data))]  # a word ends where its document does
    opens[at] |= ink[at]
    closes[at - 1] |= ink[at - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(lo, hi, data, bounds, start, end, np.searchsorted(start, bounds, "left"))
