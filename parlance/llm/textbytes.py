"""Vectorised kernels over the UTF-8 bytes of Arrow string columns.

Texts stay in Arrow's own buffers: no Python string is made for a document or a word. Every
function works on a block of whole documents, and ``blocks`` bounds a block by its bytes (a longer
document is a block of its own).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15

#: Classes of bytes. SPACED: all but \x20 and \x09-\x0D, so words are runs between blanks.
#: ALNUM: digits, ASCII letters and every byte of a non-ASCII character.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Lower case of A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give freed memory back to the system: an idle worker then holds no more than its modules."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def blocks(batches, column: str | int, limit: int = 1 << 18, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold ``limit`` bytes of ``column`` (a name, or a place) and ``rows``
    rows at most, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.columns[column] if isinstance(column, int) else batch.column(column)), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        at, before = 0, 0
        while at < n:
            upto = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + limit, "right"))))
            yield batch.slice(at, upto - at)
            at, before = upto, int(ends[upto - 1])
    batch = lengths = ends = None
    release()


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each run of bytes of ``kind``; a run ends with its document."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = kind[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection on 64-bit words."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


class HashTable:
    """64-bit keys (sorted or not, distinct) to positions, by open addressing in numpy.

    ``find`` returns the position of each key in the array given, or -1.
    """

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, U)
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, np.int32)
        self.keys = keys
        left, at, self.probes = np.arange(len(keys), dtype=np.int32), self._home(keys), 0
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]  # of several for one slot the last stays
            rest = self.slot[at] != left
            left, at = left[rest], (at[rest] + 1) & self.mask
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(_BASE)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, U)
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys) or not len(keys):
            return out
        at, idx = self._home(keys), None
        for _ in range(self.probes):
            got = self.slot[at]
            hit = (got >= 0) & (self.keys[got] == keys)
            if idx is None:
                out[hit] = got[hit]
                idx = np.flatnonzero((got >= 0) & ~hit)
            else:
                out[idx[hit]] = got[hit]
                idx = idx[(got >= 0) & ~hit]
            if not len(idx):
                break
            keep = (got >= 0) & ~hit
            at, keys = (at[keep] + 1) & self.mask, keys[keep]
        return out


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often (or with what total weight) each occurs."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(weights[order], first)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: int = 0x20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs one after the other with one ``gap`` byte behind each, and where each now lies."""
    length = ends - starts
    new = np.cumsum(length + 1) - (length + 1)
    n = int(length.sum())
    before = np.cumsum(length) - length
    out = np.full(n + len(starts), gap, np.uint8)
    within = np.arange(n)
    out[within + np.repeat(new - before, length)] = data[within + np.repeat(starts - before, length)]
    return out, new, new + length


_X1, _X2, _X3, _X4, _X5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Runs of more bytes go through the C library one by one.
_LONG = 192


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of each run of bytes (the published algorithm, all runs in step)."""
    import xxhash

    n, length = len(starts), ends - starts
    if not n:
        return np.zeros(0, U)
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", held, strides=(1,))
    with np.errstate(over="ignore"):
        s = U(seed)
        h = np.full(n, s + _X5, U)
        at = starts.copy()
        wide = np.flatnonzero((length >= 32) & (length <= _LONG))
        if len(wide):
            lanes = [np.full(len(wide), v, U) for v in (s + _X1 + _X2, s + _X2, s, s - _X1)]
            stripes = length[wide] // 32
            for k in range(int(stripes.max())):
                on = np.flatnonzero(stripes > k)
                for j in range(4):
                    lanes[j][on] = _turn(lanes[j][on] + eight[starts[wide[on]] + 32 * k + 8 * j] * _X2, 31) * _X1
            top = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
            for j in range(4):
                top = (top ^ (_turn(lanes[j] * _X2, 31) * _X1)) * _X1 + _X4
            h[wide] = top
            at[wide] += 32 * stripes
        h += length.astype(U)
        left = np.where(length > _LONG, 0, ends - at)
        for k in range(int(left.max()) // 8):
            on = np.flatnonzero(left >= 8 * (k + 1))
            h[on] = _turn(h[on] ^ (_turn(eight[at[on] + 8 * k] * _X2, 31) * _X1), 27) * _X1 + _X4
        at += left // 8 * 8
        left %= 8
        on = np.flatnonzero(left >= 4)
        h[on] = _turn(h[on] ^ ((eight[at[on]] & U(0xFFFFFFFF)) * _X1), 23) * _X2 + _X3
        at[on] += 4
        left[on] -= 4
        for k in range(3):
            on = np.flatnonzero(left > k)
            h[on] = _turn(h[on] ^ (held[at[on] + k].astype(U) * _X5), 11) * _X1
        h ^= h >> U(33)
        h *= _X2
        h ^= h >> U(29)
        h *= _X3
        h ^= h >> U(32)
    for k in np.flatnonzero(length > _LONG).tolist():
        h[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes(), seed)
    return h
