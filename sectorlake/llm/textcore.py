"""Vectorised text primitives over Arrow string columns.

All functions work on a *chunk*: the UTF-8 bytes of several whole texts laid end to end with their offsets.
A text is never cut; a text longer than the chunk limit is a chunk of its own.  Nulls count as empty texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive runs of rows with about ``limit`` bytes each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of ``[^\\x20\\x09-\\x0D]`` inside a text."""
    word = np.empty(len(data) + 1, bool)
    np.logical_not(_SPACE[data], out=word[:-1])
    word[-1] = False
    start = word[:-1].copy()
    start[1:] &= ~word[:-2]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[begins] = word[begins]
    starts = np.flatnonzero(start)
    end = word[:-1].copy()
    end &= ~word[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[last] = word[last]
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every ``\\n``-separated line, without the newline; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    rows = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    row_s = np.concatenate([np.arange(len(offsets) - 1), rows])
    row_e = np.concatenate([rows, np.arange(len(offsets) - 1)])
    a, b = np.lexsort((starts, row_s)), np.lexsort((ends, row_e))
    return starts[a], ends[b], row_s[a]


_KEY, _ROUND = U64(0x3C79AC492BA7B653), U64(0x1C69B3F74AC4AE35)
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], U64)  # masks of the first n bytes
LONG = 1024  # bytes; longer spans are hashed and compared one by one


class Spans:
    """Byte spans of a chunk: keyed 64-bit hashes, and the exact groups of equal spans.

    A hash takes eight bytes at a time and mixes after each step, so it is no polynomial that regular texts could cancel.
    Where equality within a chunk decides a result, ``groups`` compares the bytes as well."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        self.words = np.ndarray((len(data) + 1,), "<u8", self.data, strides=(1,))  # the eight bytes from each byte on

    def hash(self, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
        n = ends - starts
        h = mix(n.astype(U64) ^ _KEY ^ U64(key))
        some = np.flatnonzero((n > 0) & (n <= LONG))
        left, at = n[some], starts[some]
        while len(some):  # one step for all spans that still have bytes
            x = (h[some] ^ (self.words[at] & _FIRST[np.minimum(left, 8)])) * _ROUND
            h[some] = x ^ (x >> U64(29))
            more = left > 8
            some, left, at = some[more], left[more] - 8, at[more] + 8
        for i in np.flatnonzero(n > LONG).tolist():
            part = hashlib.blake2b(memoryview(self.data)[starts[i] : ends[i]], digest_size=8, key=int(key).to_bytes(8, "little")).digest()
            h[i] = int.from_bytes(part, "little")
        return mix(h)

    def equal(self, starts: np.ndarray, ends: np.ndarray, starts2: np.ndarray, ends2: np.ndarray) -> np.ndarray:
        """Whether the two spans of each row hold the same bytes."""
        left = ends - starts
        good = left == ends2 - starts2
        for i in np.flatnonzero(good & (left > LONG) & (starts != starts2)).tolist():
            good[i] = np.array_equal(self.data[starts[i] : ends[i]], self.data[starts2[i] : ends2[i]])
        some = np.flatnonzero(good & (left > 0) & (left <= LONG) & (starts != starts2))
        left, at, at2 = left[some], starts[some], starts2[some]
        while len(some):
            same = ((self.words[at] ^ self.words[at2]) & _FIRST[np.minimum(left, 8)]) == 0
            good[some[~same]] = False
            more = same & (left > 8)
            some, left, at, at2 = some[more], left[more] - 8, at[more] + 8, at2[more] + 8
        return good

    def groups(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first span of each group of equal spans, and the group of each span."""
        _, first, group = np.unique(self.hash(starts, ends), return_index=True, return_inverse=True)
        if self.equal(starts, ends, starts[first[group]], ends[first[group]]).all():
            return first, group
        known: dict[bytes, int] = {}  # two different spans have one hash: by the bytes alone
        raw = self.data.tobytes()
        group = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        return np.unique(group, return_index=True)[1], group


def run_hashes(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of words, given the hash of each word; the runs' lengths are few and bounded."""
    size = end - first
    h = mix(size.astype(U64) ^ _KEY)
    for k in range(int(size.max()) if len(size) else 0):
        some = np.flatnonzero(size > k)
        x = (h[some] ^ words[first[some] + k]) * _ROUND
        h[some] = x ^ (x >> U64(29))
    return mix(h)


_STEP = [U64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word shingles of one text; of a text of 1 to k-1 words, the hash of all its words."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    total = np.full(n - width + 1, U64(width), U64)
    for j in range(width):
        total = (total ^ (words[j : n - width + 1 + j] >> U64(7))) * _STEP[j % 5] + words[j : n - width + 1 + j]
    return mix(total)


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each of n rows in a sorted array of row numbers."""
    return np.searchsorted(rows, np.arange(n + 1))
