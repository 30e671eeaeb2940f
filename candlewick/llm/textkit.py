"""Words, windows and hashes of many texts at once, in numpy.

A *word* is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return (``[^\\x20\\x09-\\x0D]+``); as these are ASCII, bytes of
UTF-8 texts may be used.  Null texts count as empty.  Work is done on slices of
whole texts of about ``SLICE`` bytes (a longer text is a slice of its own), so
memory does not depend on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 2 << 20
KEPT = (1 << 19) + 4096  # powers that a process keeps, of each base: those of slices of 512 kB
_P, _G = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_PI, _GI = (np.uint64(pow(int(x), -1, 1 << 64)) for x in (_P, _G))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** n`` modulo 2**64, not to be written to."""
    return _first_powers(int(base))[:n + 1] if n < KEPT else _powers(base, n)


@cache
def _first_powers(base: int) -> np.ndarray:
    return _powers(np.uint64(base), KEPT - 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    done, step = 1, int(base)
    while done <= n:  # what is there, times the power that comes next
        more = min(done, n + 1 - done)
        np.multiply(out[:more], np.uint64(step), out=out[done:done + more])
        done, step = done + more, step * step % (1 << 64)
    return out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each text begins (one more at the end)."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0]:offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    data, off = flat(column)
    at, n = 0, len(off) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, end, data[off[at]:off[end]], off[at:end + 1] - off[at]
        at = end


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


class Words:
    """Words of consecutive texts: ``start``/``end`` byte positions, ``doc`` the
    number of the text, ``first`` the number of each text's first word (one more
    at the end)."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        n = len(data)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.ones(n + 1, bool)
        before[1:] = blank
        after = np.ones(n + 1, bool)
        after[:n] = blank
        self.blank = blank
        self.start = np.flatnonzero(~after & (before | edge))
        self.end = np.flatnonzero(~before & (after | edge))
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(_P, len(self.data))[:-1], out=total[1:], dtype=np.uint64)
        back = powers(_PI, len(self.data))
        return mix((total[self.end] - total[self.start]) * back[self.start])


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive hashes (of all, whatever text they are of)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(_G, n)[:-1], out=total[1:], dtype=np.uint64)
    return mix((total[k:] - total[:n - k + 1]) * powers(_GI, n)[:n - k + 1])


def within(words: Words, k: int) -> np.ndarray:
    """Numbers of the words at which ``k`` words of one text begin."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.int64)
    return np.flatnonzero(words.doc[:n - k + 1] == words.doc[k - 1:])


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct ``k``-word shingles, sorted; a text of
    fewer words is one shingle, one without words none."""
    words = Words(lower(data), off)
    hashes = words.hashes()
    n = words.counts()
    short = (n > 0) & (n < k)
    many = np.where(short, 1, np.maximum(0, n - k + 1))
    begin = np.concatenate([[0], np.cumsum(many)])
    owner = np.repeat(np.arange(len(n)), many)
    value = np.empty(len(owner), np.uint64)
    value[~short[owner]] = windows(hashes, k)[within(words, k)]
    for size in range(1, k):
        some = np.flatnonzero(n == size)
        if len(some):
            value[begin[some]] = windows(hashes, size)[words.first[some]] ^ np.uint64(size)
    several = np.flatnonzero(many > 1)
    for b, e in zip(begin[several].tolist(), begin[several + 1].tolist(), strict=True):  # far faster than one sort by text and hash
        value[b:e].sort()
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def ids(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    """An integer column as numpy; it holds no nulls."""
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as a bigint column."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
