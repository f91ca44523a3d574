"""Vectorised text primitives on Arrow buffers: blocks of UTF-8 bytes, words, shingles, per-document sets.

Everything works on the raw value buffer of a string column, so no Python string is made for a row.
A null text counts as empty.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (fixed constants of the public splitmix64 generator)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if give:
        give(0)


def lean(run):
    """``run`` over batches, after which the worker, which lives on for other tasks, gives freed memory back to the system."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as the longest block so far."""

    def __init__(self):
        self.up = np.ones(1, U)
        self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n += n >> 3
            step = np.full(n, BASE, U)
            step[0] = 1
            self.up = np.cumprod(step, dtype=U)
            step[1:] = pow(BASE, -1, 1 << 64)
            self.down = np.cumprod(step, dtype=U)
        return self.up, self.down


#: Spans of more bytes are hashed by BLAKE2b, one by one; the rest eight bytes at a time, all spans together.
LONG_SPAN = 1024
_HEAD = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], U)


def lanes(block: np.ndarray) -> np.ndarray:
    """For each byte, and for the end, the number that it and the seven bytes after it make; zeros follow the block."""
    return np.ndarray(len(block) + 1, "<u8", np.concatenate((block, np.zeros(8, np.uint8))), strides=(1,))


def span_hashes(block: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes. Every eight bytes pass a bijective finaliser, so no algebraic identity between texts
    (as polynomial hashes have) makes spans collide."""
    eight = lanes(block)
    h = lengths.astype(U) * U(0xD6E8FEB86659FD93)
    h = mix(h ^ (eight[starts] & _HEAD[np.minimum(lengths, 8)]))
    live, at = np.flatnonzero((lengths > 8) & (lengths <= LONG_SPAN)), 8
    while len(live):
        h[live] = mix((h[live] * U(BASE)) ^ (eight[starts[live] + at] & _HEAD[np.minimum(lengths[live] - at, 8)]))
        at += 8
        live = live[lengths[live] > at]
    for i in np.flatnonzero(lengths > LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(block[starts[i] : starts[i] + lengths[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def same_spans(block: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans that start at ``a`` and at ``b`` hold the same bytes."""
    eight, out = lanes(block), np.ones(len(a), bool)
    live, at = np.flatnonzero((a != b) & (lengths > 0) & (lengths <= LONG_SPAN)), 0
    while len(live):
        same = ((eight[a[live] + at] ^ eight[b[live] + at]) & _HEAD[np.minimum(lengths[live] - at, 8)]) == 0
        out[live[~same]] = False
        at += 8
        live = live[same & (lengths[live] > at)]
    for i in np.flatnonzero((a != b) & (lengths > LONG_SPAN)).tolist():
        out[i] = np.array_equal(block[a[i] : a[i] + lengths[i]], block[b[i] : b[i] + lengths[i]])
    return out


def bit_at(packed: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Bits of a map packed by numpy at the given places, without unpacking it."""
    return (packed[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).astype(bool)


def blocks(batch: pa.RecordBatch, column: str, max_rows: int = 1024, max_bytes: int = 1 << 20):
    """Yield (first row, offsets, bytes) for runs of rows: at most max_rows rows and about max_bytes bytes.

    A text longer than max_bytes makes a block of its own; texts are never cut.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = pa.nulls(len(col), pa.string())
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if not n:
        return
    _, offsets, data = col.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    lengths = np.diff(ends)
    if col.null_count:
        lengths = np.where(np.asarray(col.is_null()), 0, lengths)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        upto = np.cumsum(lengths[i : i + max_rows])
        j = i + max(1, int(np.searchsorted(upto, max_bytes, "right")))
        span = lengths[i:j]
        own = np.concatenate(([0], np.cumsum(span)))
        if own[-1] == ends[j] - ends[i]:
            block = raw[ends[i] : ends[j]]
        else:  # null rows may hold bytes
            block = np.concatenate([raw[ends[k] : ends[k] + lengths[k]] for k in range(i, j)])
        yield i, own, block
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(offsets: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each word [^\\x20\\x09-\\x0D]+ of the block's rows."""
    n = len(block)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    solid = ~_SPACE[block]
    head = np.empty(n + 1, bool)
    head[0], head[n] = True, True
    np.logical_not(solid[:-1], out=head[1:n])
    edges = offsets[offsets < n]
    head[edges] = True
    starts = np.flatnonzero(solid & head[:-1])
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = ~solid[1:]
    cut = edges[edges > 0] - 1
    last[cut] = True
    ends = np.flatnonzero(solid & last) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, row


def word_hashes(block: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word, A-Z lower-cased: equal words hash alike wherever they stand."""
    return span_hashes(_LOWER[block] if lower else block, starts, ends - starts)


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first word and number of words of each shingle of k words; a row of fewer words, but at least one, has its whole sequence as one."""
    count = np.bincount(row, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64)
    out = []
    acc = h
    for length in range(1, k + 1):
        if len(h) < length:
            break
        if length > 1:
            acc = mix(acc[: len(h) - length + 1]) * U(31) + h[length - 1 :]
        if length < k:
            rows = np.flatnonzero(count == length)
            at = first[rows]
        else:
            at = np.flatnonzero(row[: len(h) - k + 1] == row[k - 1 :])
            rows = row[at]
        out.append((mix(acc[at] + U(length * 0x51ED27)), rows, at, np.full(len(at), length)))
    if not out:
        return np.zeros(0, U), *(np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
