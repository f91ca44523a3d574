"""Removal of byte strings of a fixed length that also start in a document with a smaller id.

Equal strings of ``length`` bytes hold the same least hash of their ``GRAM``-byte substrings, so consecutive start
positions with the same least hash form runs, about one in fourteen positions, and only runs that share it can hold
equal strings. Texts lie in a table of chunks that every pass reads again; what passes tell one another is
keyed by chunk, so no text is shuffled and a string that very many documents share counts once a chunk.

1. Hashes of whole texts meet. A text that a row with a smaller id has too goes whole and takes no further part.
2. Least hashes of each chunk meet by hash range; those of one chunk and one document alone are done.
3. The rest meet with a hash of their run's whole context: if an earlier document has the same context, every
   start position of the run repeats. If all contexts of a least hash are the same, that decides it.
4. Runs whose contexts differ (at the edges of shared passages) meet as byte strings, each distinct one once. Their
   suffixes are sorted: a merge sort whose comparisons find the common extension of two suffixes by binary
   search over prefix polynomial hashes. Neighbours that agree on ``length`` bytes are verified byte by byte;
   the least id of each class goes back to the chunks. Where a least hash has many contexts, its strings, one for
   each start position, meet by hash instead: as bytes, fifty for each position, they would fill the disks.

Shuffle files of a pass are given up before the next one. What a worker holds does not grow with the table: strings that meet
are sorted range by range of their hashes, and the ranges that groups are made of follow the number of chunks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textkit import Powers, U, blocks, lean, mix, trim

LENGTH = 50
GRAM = 24
CHUNK_BYTES = 4 << 20
#: Hash arrays are eight times as large as the text, so they are made for so many bytes at a time.
PIECE_BYTES = 1 << 20
CHUNK_ROWS = 1 << 15
#: Runs with more start positions, and least hashes with more contexts, are taken apart into hashes of single strings,
#: so that no group of strings that meet grows with how common a gram is.
LONG_RUN = 64
MANY_CONTEXTS = 64
#: Least hashes are dealt into so many ranges that one holds the runs of about so many chunks, whatever the session's partitions.
CHUNKS_IN_BUCKET = 4
#: Sorting takes about a hundred bytes a position, so strings that meet are sorted so many bytes, or single ones, at a time.
SORT_BYTES = 1 << 20
SORT_SINGLES = 1 << 18
NO_ID = -(1 << 63)


def _chunks(id_col, text_col):
    """Rows packed into chunks: (chunk, ids, nulls of ids, lengths, 128-bit hashes of texts, text)."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64())
            for first, offsets, block in blocks(batch, text_col, CHUNK_ROWS, CHUNK_BYTES):
                own = ids.slice(first, len(offsets) - 1)
                whole = b"".join(hashlib.blake2b(block[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
                cols = own.fill_null(NO_ID).to_numpy().tobytes(), np.asarray(own.is_null()).tobytes(), np.diff(offsets).tobytes(), whole, block.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in cols)], ["chunk", "ids", "none", "lengths", "whole", "text"])
                number += 1

    return run


def _runs(offsets, block, powers, length, first_row=0):
    """Runs of start positions that share a least hash: row, first and last position, least hash, context hash."""
    n = len(block)
    gram = min(GRAM, length)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(U), none.view(U)
    sums = _sums(block, powers)
    _, down = powers.to(n + 1)
    m = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    m *= U(0xD6E8FEB86659FD93)
    m ^= m >> U(32)
    width, want = 1, length - gram + 1
    while width * 2 <= want:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < want:
        m = np.minimum(m[: len(m) - (want - width)], m[want - width :])
    size = np.diff(offsets)
    filled = size >= length
    delta = np.zeros(n + 2, np.int32)
    np.add.at(delta, offsets[:-1][filled], 1)
    np.add.at(delta, offsets[1:][filled] - length + 1, -1)
    valid = np.cumsum(delta[: len(m)]) > 0
    other = np.concatenate(([True], m[1:] != m[:-1]))
    start = valid & (other | np.concatenate(([True], ~valid[:-1])))
    stop = valid & np.concatenate((other[1:] | ~valid[1:], [True]))
    a, b = np.flatnonzero(start), np.flatnonzero(stop)
    row = np.searchsorted(offsets, a, "right") - 1 + first_row
    context = mix((sums[b + length] - sums[a]) * down[a] + (b - a).astype(U) * U(0x9E3779B97F4A7C15))
    return row, a, b, mix(m[a]), context


def _sums(block, powers):
    up, _ = powers.to(len(block) + 1)
    out = np.empty(len(block) + 1, U)
    out[0] = 0
    np.cumsum((block.astype(U) + U(1)) * up[: len(block)], out=out[1:])
    return out


def _strings(sums, at, length, powers):
    """Hash of the string of ``length`` bytes at each position."""
    _, down = powers.to(len(sums))
    return mix((sums[at + length] - sums[at]) * down[at] + U(0x2545F4914F6CDD1D))


def _singles(c, runs, length, powers):
    """Hash of the string at each start position of a chunk's runs, the run's place in ``runs`` and the position."""
    runs = np.asarray(runs)
    order = np.argsort(c.a[runs], kind="stable")
    first, count = c.a[runs][order], (c.b - c.a)[runs][order] + 1
    ends = np.cumsum(count)
    h, which, pos = np.empty(int(count.sum()), np.uint64), np.empty(int(count.sum()), np.int32), np.empty(int(count.sum()), np.int32)
    i = done = 0
    while i < len(first):  # a piece at a time: the hash arrays are eight times its size
        j = int(np.searchsorted(first, first[i] + PIECE_BYTES, "right"))
        at, lo = _reach(first[i:j], count[i:j]), int(first[i])
        sums = _sums(c.block[lo : int((first[i:j] + count[i:j]).max()) + length], powers)
        h[done : ends[j - 1]], pos[done : ends[j - 1]] = _strings(sums, at - lo, length, powers), at
        which[done : ends[j - 1]] = np.repeat(order[i:j], count[i:j])
        i, done = j, int(ends[j - 1])
    return h, which, pos


def _parts(h):
    """Places of hashes, range by range of them, so that few are sorted at a time."""
    n = 1 + len(h) // SORT_SINGLES
    part = _bucket(h, n).astype(np.int32)
    for i in range(n):
        yield i, n, np.flatnonzero(part == i)


class _Wholes:
    """A chunk's rows that hold a string, in order of their text's hash and id, with the distinct texts numbered."""

    def __init__(self, row: dict, length: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        at = np.flatnonzero(np.frombuffer(row["lengths"], np.int64) >= length)
        h = np.frombuffer(row["whole"], np.uint64).reshape(-1, 2)[at]
        order = np.lexsort((self.ids[at], h[:, 1], h[:, 0]))
        self.at, h = at[order], h[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]).any(1)))[: len(at)]
        head = np.flatnonzero(new)
        self.no, self.h, self.first = np.cumsum(new) - 1, h[head], self.ids[self.at[head]]

    def copies(self, told, buckets: int) -> np.ndarray:
        """For each row whether one with a smaller id has the same text."""
        out = np.zeros(len(self.ids), bool)
        out[self.at] = _aligned(told, self.h[:, 0], buckets, bool, True)[self.no] | (self.ids[self.at] > self.first[self.no])
        return out


class _Chunk:
    """A chunk's runs in order of least hash, context and id, with the distinct ones numbered; copies have none."""

    def __init__(self, row: dict, powers, length: int, buckets: int):
        self.copy = _Wholes(row, length).copies(row["copies"], buckets)
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.none = np.frombuffer(row["none"], bool)
        self.offsets = np.concatenate(([0], np.cumsum(np.frombuffer(row["lengths"], np.int64))))
        self.block = np.frombuffer(row["text"], np.uint8)
        parts = []
        for i, j, lo, hi in self.pieces():
            r, a, b, m, c = _runs(self.offsets[i : j + 1] - lo, self.block[lo:hi], powers, length, i)
            parts.append((r, a + lo, b + lo, m, c))
        r, a, b, m, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        r, a, b, m, c = (x[~self.copy[r]] for x in (r, a, b, m, c))
        order = np.lexsort((self.ids[r], c, m))
        self.row, self.a, self.b, self.least, self.context = r[order], a[order], b[order], m[order], c[order]
        new = np.concatenate(([True], self.least[1:] != self.least[:-1])) if len(r) else np.zeros(0, bool)
        self.least_at = np.flatnonzero(new)
        self.least_no = np.cumsum(new) - 1
        own = self.ids[self.row]
        if len(r):
            self.alone = np.minimum.reduceat(own, self.least_at) == np.maximum.reduceat(own, self.least_at)
        else:
            self.alone = np.zeros(0, bool)

    def pieces(self):
        """First row, row after the last, and their bytes, of a piece at a time: arrays of numbers are eight times its size."""
        i = 0
        while i < len(self.ids):
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + PIECE_BYTES, "right")) - 1)
            yield i, j, int(self.offsets[i]), int(self.offsets[j])
            i = j

    def select(self, bits: np.ndarray):
        """Keep the runs whose least hash may repeat; number the distinct pairs of least hash and context."""
        keep = (bits | ~self.alone)[self.least_no]
        self.row, self.a, self.b, self.least, self.context = (x[keep] for x in (self.row, self.a, self.b, self.least, self.context))
        new = np.concatenate(([True], (self.least[1:] != self.least[:-1]) | (self.context[1:] != self.context[:-1]))) if keep.any() else np.zeros(0, bool)
        self.pair_at = np.flatnonzero(new)
        self.pair_no = np.cumsum(new) - 1


def _bucket(h, buckets):
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _part(h, buckets):
    """Which of 256 ranges of its bucket a hash lies in."""
    return (((h >> np.uint64(32)) * np.uint64(buckets) & np.uint64(0xFFFFFFFF)) >> np.uint64(24)).astype(np.uint8)


def _slices(h, buckets):
    """(bucket, first, last) of the runs of a sorted hash array."""
    cut = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1, dtype=np.uint64))
    at = np.flatnonzero(np.diff(cut))
    return [(int(i), int(cut[i]), int(cut[i + 1])) for i in at]


def _aligned(told, h, buckets, dtype, unpack=False):
    """What the reducers told of a sorted hash array, slice by slice; zero where they told nothing."""
    out = np.zeros(len(h), dtype)
    by = {x["bucket"]: x["told"] for x in told or ()}
    for i, a, b in _slices(h, buckets):
        if i in by:
            got = np.frombuffer(by[i], np.uint8)
            out[a:b] = np.unpackbits(got)[: b - a] if unpack else got
    return out


def _low(h):
    """The low 40 bits of hashes, five bytes each; the bucket tells some of the others."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :5])


def _wide(parts):
    """Numbers from the bytes of :func:`_low`."""
    low = np.concatenate([np.frombuffer(x, np.uint8) for x in parts]).reshape(-1, 5)
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, :5] = low
    return wide.reshape(-1).view(np.uint64)


def _narrow(ids, least):
    """Ids as distances from ``least`` in as few bytes as they all need."""
    far = ids.view(np.uint64) - np.uint64(least & (1 << 64) - 1)
    return far.astype(np.min_scalar_type(far.max(initial=0)))


def _ids(parts, least, counts):
    """Ids from the bytes of :func:`_narrow`: each part has its least id and its count."""
    return np.concatenate([(np.frombuffer(x, f"u{len(x) // n}").astype(np.uint64) + np.uint64(a & (1 << 64) - 1)).view(np.int64) for x, a, n in zip(parts, least, counts, strict=True)])


def _rows(batch):
    for i in range(batch.num_rows):
        yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def _tell_texts(length, buckets):
    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                t = _Wholes(row, length)
                cut = _slices(t.h[:, 0], buckets)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in cut], pa.int32()), pa.array([row["chunk"]] * len(cut), pa.int64()), *(pa.array([x[a:b].tobytes() for _, a, b in cut], pa.binary()) for x in (t.h, t.first))], ["bucket", "chunk", "texts", "first"])

    return run


def _meet_texts(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which texts a row of another chunk with a smaller id has: a bit for each, chunk by chunk."""
    chunks, texts, first = [], [], []
    for batch in groups:
        chunks += batch.column("chunk").to_pylist()
        texts += [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in batch.column("texts").to_pylist()]
        first += [np.frombuffer(x, np.int64) for x in batch.column("first").to_pylist()]
    h, own = np.concatenate(texts), np.concatenate(first)
    order = np.lexsort((own, h[:, 1], h[:, 0]))
    new = np.concatenate(([True], (h[order][1:] != h[order][:-1]).any(1)))
    earlier = np.empty(len(h), bool)
    earlier[order] = own[order] > own[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    ends = np.cumsum([len(x) for x in first])
    out = [(c, np.packbits(earlier[e - len(x) : e]).tobytes()) for c, x, e in zip(chunks, first, ends, strict=True) if earlier[e - len(x) : e].any()]
    if out:
        yield _answers([c for c, _ in out], [t for _, t in out], key[0].as_py())


def _tell_least(length, buckets):
    def run(batches):
        powers = Powers()
        for batch in batches:
            for row in _rows(batch):
                c = _Chunk(row, powers, length, buckets)
                h = c.least[c.least_at]
                low = _low(h)
                cut = _slices(h, buckets)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in cut], pa.int32()), pa.array([row["chunk"]] * len(cut), pa.int64()), pa.array([low[a:b].tobytes() for _, a, b in cut], pa.binary())], ["bucket", "chunk", "least"])

    return run


def _answers(chunks, told, bucket):
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([bucket] * len(chunks), pa.int32()), pa.array(told, pa.binary())], ["chunk", "bucket", "told"])


def _meet_least(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which least hashes come from two chunks or more: a bit for each, chunk by chunk."""
    chunks, parts = [], []
    for batch in groups:
        chunks += batch.column("chunk").to_pylist()
        parts += batch.column("least").to_pylist()
    h = _wide(parts)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    more = np.zeros(len(h), bool)
    more[order[1:][same]] = True
    more[order[:-1][same]] = True
    sizes = [len(p) // 5 for p in parts]
    out = [(c, np.packbits(more[e - n : e]).tobytes()) for c, n, e in zip(chunks, sizes, np.cumsum(sizes), strict=True) if more[e - n : e].any()]
    if out:
        yield _answers([c for c, _ in out], [t for _, t in out], key[0].as_py())


def _tell_contexts(length, buckets):
    def run(batches):
        powers = Powers()
        for batch in batches:
            for row in _rows(batch):
                c = _Chunk(row, powers, length, buckets)
                c.select(_aligned(row["repeats"], c.least[c.least_at], buckets, bool, True))
                at = c.pair_at
                h, context = c.least[at], c.context[at]
                base = int(c.ids.min(initial=0))
                first = _narrow(c.ids[c.row[at]], base)
                long = (c.b[at] - c.a[at] >= LONG_RUN).astype(np.uint8)
                cut = _slices(h, buckets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _, _ in cut], pa.int32()), *(pa.array([x] * len(cut), pa.int64()) for x in (row["chunk"], base)), *(pa.array([x[a:b].tobytes() for _, a, b in cut], pa.binary()) for x in (_low(h), context, first, long))],
                    ["bucket", "chunk", "base", "least", "context", "first", "long"],
                )

    return run


EARLIER, RAGGED, MANY = 1, 2, 4


def _meet_contexts(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk's pairs: an earlier document has the context; the least hash has other contexts; many or long ones."""
    chunks, base, least, context, first, long = [], [], [], [], [], []
    for batch in groups:
        for name, to in (("chunk", chunks), ("base", base), ("least", least), ("first", first)):
            to += batch.column(name).to_pylist()
        for name, to, kind in (("context", context, np.uint64), ("long", long, np.uint8)):
            to += [np.frombuffer(x, kind) for x in batch.column(name).to_pylist()]
    sizes = [len(x) for x in context]
    m, c, f = _wide(least), np.concatenate(context), _ids(first, base, sizes)
    order = np.lexsort((f, c, m))
    m, c, f, wide = m[order], c[order], f[order], np.concatenate(long)[order]
    new_m = np.concatenate(([True], m[1:] != m[:-1]))
    new = new_m | np.concatenate(([True], c[1:] != c[:-1]))
    head = np.flatnonzero(new)
    no = np.cumsum(new) - 1
    m_head, m_no = np.flatnonzero(new_m), np.cumsum(new_m) - 1
    contexts = np.add.reduceat(new.astype(np.int64), m_head)[m_no]
    many = (contexts > MANY_CONTEXTS) | (np.maximum.reduceat(wide, m_head)[m_no] > 0)
    told = (f > f[head][no]) * EARLIER + (contexts > 1) * RAGGED + many * MANY
    back = np.empty(len(told), np.uint8)
    back[order] = told
    out = [(k, back[e - n : e].tobytes()) for k, n, e in zip(chunks, sizes, np.cumsum(sizes), strict=True) if back[e - n : e].any()]
    if out:
        yield _answers([k for k, _ in out], [t for _, t in out], key[0].as_py())


def _decided(row, powers, length, buckets):
    """A chunk, and for its selected runs whether they repeat whole, and what was told of their pair."""
    c = _Chunk(row, powers, length, buckets)
    c.select(_aligned(row["repeats"], c.least[c.least_at], buckets, bool, True))
    told = _aligned(row["contexts"], c.least[c.pair_at], buckets, np.uint8)
    first = c.ids[c.row[c.pair_at]]
    whole = ((told & EARLIER) > 0)[c.pair_no] | (c.ids[c.row] > first[c.pair_no])
    return c, whole, told


def _reach(start, count):
    """Positions from each start on, as many as its count."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def _tell_strings(length, buckets):
    def run(batches):
        powers = Powers()
        for batch in batches:
            for row in _rows(batch):
                c, _, told = _decided(row, powers, length, buckets)
                sent = np.flatnonzero(((told & RAGGED) > 0) & ((told & EARLIER) == 0))
                at = c.pair_at[sent]
                single = (told[sent] & MANY) > 0
                rows = at[~single]
                start, stop, own, to, part = c.a[rows], c.b[rows] + length, c.ids[c.row[rows]], _bucket(c.least[rows], buckets), _part(c.least[rows], buckets)
                order = np.argsort(to, kind="stable")
                start, stop, own, to, part = start[order], stop[order], own[order], to[order], part[order]
                size = stop - start
                text, edge = c.block[_reach(start, size)], np.concatenate(([0], np.cumsum(size)))
                cut = np.searchsorted(to, np.arange(buckets + 1, dtype=np.uint64))
                rows = at[single]
                # Each distinct single string once, for the least id that has it.
                all_h, which, _ = _singles(c, rows, length, powers)
                kept = []
                for _, _, some in _parts(all_h):
                    h, run = all_h[some], rows[which[some]]
                    least, whose = c.least[run], c.ids[c.row[run]]
                    order = np.lexsort((whose, least, h))
                    h, least, whose = h[order], least[order], whose[order]
                    new = np.concatenate(([True], (h[1:] != h[:-1]) | (least[1:] != least[:-1])))[: len(h)]
                    kept.append((h[new], least[new], whose[new]))
                h, least, whose = (np.concatenate(x) for x in zip(*kept, strict=True))
                base = int(c.ids.min(initial=0))
                low, whose = _low(least), _narrow(whose, base)
                once = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1, dtype=np.uint64))
                some = np.flatnonzero(np.diff(cut) + np.diff(once)).tolist()
                if not some:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), *(pa.array([x] * len(some), pa.int64()) for x in (row["chunk"], base)), *(pa.array([x[to[i] : to[i + 1]].tobytes() for i in some], pa.binary()) for x, to in ((size, cut), (own, cut), (part, cut), (text, edge[cut]), (h, once), (low, once), (whose, once)))],
                    ["bucket", "chunk", "base", "sizes", "docs", "part", "text", "hashes", "least", "whose"],
                )

    return run


class Suffixes:
    """Order of the suffixes at given positions by their first ``length`` bytes."""

    def __init__(self, text: np.ndarray, length: int, powers):
        self.text, self.length = text, length
        self.sums = _sums(text, powers)
        self.down = powers.to(len(text) + 1)[1]

    def common(self, a: np.ndarray, b: np.ndarray, least: int = 0) -> np.ndarray:
        """Length of the common extension of suffixes, up to ``length``: binary search over prefix hashes."""
        lo, hi = np.full(len(a), least), np.full(len(a), self.length)
        base_a, base_b, down_a, down_b = self.sums[a], self.sums[b], self.down[a], self.down[b]
        for _ in range(int(self.length - least).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = (self.sums[a + mid] - base_a) * down_a == (self.sums[b + mid] - base_b) * down_b
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def compare(self, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
        """Sign of suffix a against suffix b."""
        n = self.common(a, b, least)
        at = np.minimum(n, self.length - 1)
        return np.where(n == self.length, 0, np.sign(self.text[a + at].astype(np.int16) - self.text[b + at]))

    def sort(self, at: np.ndarray) -> np.ndarray:
        """Positions in suffix order: by eight bytes, then by merge sort within what these leave equal."""
        head = min(8, self.length)
        key = np.zeros(len(at), np.uint64)
        for i in range(head):
            key = key << np.uint64(8) | self.text[at + i].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(at)))
        many = size > 1
        group = np.repeat(start[many], size[many])
        end = np.repeat((start + size)[many], size[many])
        slot = np.arange(len(group)) - np.repeat(np.cumsum(size[many]) - size[many], size[many]) + group
        width, most = 1, int(size.max(initial=1))
        while width < most:
            inner = slot - group
            base = group + inner // (2 * width) * (2 * width)
            mid, stop = np.minimum(base + width, end), np.minimum(base + 2 * width, end)
            busy = mid < stop
            s, b, m, e = slot[busy], base[busy], mid[busy], stop[busy]
            left = s < m
            lo, hi = np.where(left, m, b), np.where(left, e, m)
            first = lo.copy()
            live = np.flatnonzero(lo < hi)
            while len(live):
                probe = (lo[live] + hi[live]) >> 1
                sign = self.compare(at[probe], at[s[live]], head)
                before = (sign < 0) | ((sign == 0) & ~left[live])
                lo[live] = np.where(before, probe + 1, lo[live])
                hi[live] = np.where(before, hi[live], probe)
                live = live[lo[live] < hi[live]]
            moved = at.copy()
            moved[b + (s - np.where(left, b, m)) + (lo - first)] = at[s]
            at = moved
            width *= 2
        return at

    def classes(self, at: np.ndarray) -> np.ndarray:
        """Class number of each of the sorted positions: neighbours with a common extension of ``length`` that verifies."""
        same = self.common(at[:-1], at[1:]) == self.length
        pairs = np.flatnonzero(same)
        for i in range(0, len(pairs), 1 << 16):
            p = pairs[i : i + (1 << 16)]
            reach = np.arange(self.length)
            same[p] = (self.text[at[p][:, None] + reach] == self.text[at[p + 1][:, None] + reach]).all(1)
        return np.concatenate(([0], np.cumsum(~same))) if len(at) else np.zeros(0, np.int64)


def _meet_strings(length):
    def of_runs(chunk, size, doc, text, powers):
        """Chunk, hash and least id of the strings of runs that a smaller id has too."""
        starts = size - length + 1
        which = np.repeat(np.arange(len(size)), starts)
        at = _reach(np.cumsum(size) - size, starts)
        whose = np.empty(len(text), np.int64)
        whose[at] = which
        suffixes = Suffixes(text, length, powers)
        at = suffixes.sort(at)
        no = suffixes.classes(at)
        docs = doc[whose[at]]
        least = np.minimum.reduceat(docs, np.flatnonzero(np.concatenate(([True], no[1:] != no[:-1]))))[no]
        later = np.flatnonzero(least < docs)
        return chunk[whose[at[later]]], _strings(suffixes.sums, at[later], length, powers), least[later]

    def of_singles(chunk, doc, h, least):
        """The same of single strings, equal where both hashes are."""
        order = np.lexsort((doc, least, h))
        chunk, doc, h, least = chunk[order], doc[order], h[order], least[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (least[1:] != least[:-1])))
        first = doc[new][np.cumsum(new) - 1]
        later = first < doc
        return chunk[later], h[later], first[later]

    def all_runs(got):
        """Runs with the same least hash stand in one part of the bucket; whole parts are sorted together, few at a time."""
        size, doc = (np.concatenate([np.frombuffer(x[name], np.int64) for x in got]) for name in ("sizes", "docs"))
        chunk = np.repeat([x["chunk"] for x in got], [len(x["part"]) for x in got])
        part, text = (np.frombuffer(b"".join(x[name] for x in got), np.uint8) for name in ("part", "text"))
        start, order, powers = np.cumsum(size) - size, np.argsort(part, kind="stable"), Powers()
        ends = np.append(np.flatnonzero(np.diff(part[order])) + 1, len(order))
        upto, lo = np.concatenate(([0], np.cumsum(size[order]))), 0
        while lo < len(order):
            hi = int(ends[max(np.searchsorted(ends, lo, "right"), np.searchsorted(upto[ends], upto[lo] + SORT_BYTES, "right") - 1)])
            some, lo = order[lo:hi], hi
            yield of_runs(chunk[some], size[some], doc[some], text[_reach(start[some], size[some])], powers)

    def all_singles(got):
        """Each row's hashes are in order, so a range of them is a slice of every row."""
        h = [np.frombuffer(x["hashes"], np.uint64) for x in got]
        lo, hi = min(int(x[0]) for x in h), max(int(x[-1]) for x in h)
        n = 1 + sum(map(len, h)) // SORT_SINGLES
        bounds = np.array([lo + (hi - lo) * i // n for i in range(1, n)], np.uint64)
        cuts = [[0, *np.searchsorted(x, bounds).tolist(), len(x)] for x in h]
        for i in range(n):
            some = [(x, k, to[i], to[i + 1]) for x, k, to in zip(got, h, cuts, strict=True) if to[i] < to[i + 1]]
            if some:
                count = [b - a for _, _, a, b in some]
                wide = [len(x["whose"]) // len(k) for x, k, _, _ in some]
                doc = _ids([x["whose"][a * w : b * w] for (x, _, a, b), w in zip(some, wide, strict=True)], [x["base"] for x, _, _, _ in some], count)
                yield of_singles(np.repeat([x["chunk"] for x, _, _, _ in some], count), doc, np.concatenate([k[a:b] for _, k, a, b in some]), _wide([x["least"][5 * a : 5 * b] for x, _, a, b in some]))

    def run(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [row for batch in groups for row in _rows(batch)]
        found = []
        if runs := [x for x in got if x["sizes"]]:
            found += all_runs(runs)
        if singles := [x for x in got if x["hashes"]]:
            found += all_singles(singles)
        trim()
        to, h, least = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((h, to))
        to, h, least = to[order], h[order], least[order]
        if len(to):
            cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            ends = np.append(cut[1:], len(to))
            yield pa.RecordBatch.from_arrays([pa.array(to[cut]), pa.array([h[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()), pa.array([least[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())], ["chunk", "strings", "least"])

    return run


def _remove(length, buckets, texts):
    def run(batches):
        powers = Powers()
        for batch in batches:
            for row in _rows(batch):
                c, whole, told = _decided(row, powers, length, buckets)
                n = len(c.block)
                delta = np.zeros(n + 1, np.int32)
                np.add.at(delta, c.a[whole], 1)
                np.add.at(delta, c.b[whole] + length, -1)
                np.add.at(delta, c.offsets[:-1][c.copy], 1)
                np.add.at(delta, c.offsets[1:][c.copy], -1)
                open_ = np.flatnonzero((((told & RAGGED) > 0) & ((told & EARLIER) == 0))[c.pair_no])
                if len(open_) and not whole[open_].all():
                    mine, which, pos = _singles(c, open_, length, powers)
                    # The least id with a string is in this chunk or among what was told of other chunks.
                    told_h, told_least = (np.frombuffer(b"".join(x[name] for x in row["strings"] or ()), kind) for name, kind in (("strings", np.uint64), ("least", np.int64)))
                    for i, of, some in _parts(mine):
                        h, own = mine[some], c.ids[c.row[open_[which[some]]]]
                        others = np.flatnonzero(_bucket(told_h, of) == i)
                        asked, least = np.concatenate((h, told_h[others])), np.concatenate((own, told_least[others]))
                        order = np.lexsort((least, asked))
                        asked, least = asked[order], least[order]
                        new = np.concatenate(([True], asked[1:] != asked[:-1]))[: len(asked)]
                        hit = pos[some][least[new][np.searchsorted(asked[new], h)] < own]
                        np.add.at(delta, hit, 1)
                        np.add.at(delta, hit + length, -1)
                removed, spans, rest, under = [], [], [], 0
                for i, j, lo, hi in c.pieces():
                    gone = np.cumsum(delta[lo:hi], dtype=np.int32) + under > 0
                    under += int(delta[lo:hi].sum())
                    at = c.offsets[i : j + 1] - lo
                    begins = gone.copy()
                    begins[1:] &= ~gone[:-1]
                    inner = at[:-1][at[:-1] < hi - lo]
                    begins[inner] = gone[inner]
                    removed.append(np.diff(np.concatenate(([0], np.cumsum(gone)))[at]))
                    spans.append(np.diff(np.concatenate(([0], np.cumsum(begins)))[at]))
                    rest += [c.block[lo + x : lo + y][~gone[x:y]].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                cols = [pa.array(c.ids, pa.int64(), mask=c.none), pa.array(np.diff(c.offsets)), pa.array(np.concatenate(removed)), pa.array(np.concatenate(spans)), pa.array([hashlib.sha256(x).hexdigest() for x in rest], pa.string())]
                names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if texts:
                    cols.append(pa.array(rest, pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, texts: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, the bytes kept.

    Each byte covered by a string of ``length`` bytes that also starts in a row with a smaller id goes; strings are
    those of the input. Texts are UTF-8 bytes, null counts as empty, and strings never cross texts. Rows with the
    same id do not clear one another; a null id counts as smaller than any. Texts shorter than ``length`` stay
    whole. An empty table gives an empty result. Whole texts are compared by 128 bits of hash, contexts and strings of
    very common grams by 104, other strings byte by byte.
    """
    spark = docs.sparkSession
    scratch.bounded_batches(spark)
    n = scratch.partitions(spark)
    name = f"suffix_chunks_{uuid.uuid4().hex}"
    packed = docs.select(id_col, text_col).mapInArrow(lean(_chunks(id_col, text_col)), "chunk long, ids binary, none binary, lengths binary, whole binary, text binary")
    # Stored by chunk: the passes below join what they are told without an exchange of text.
    packed.write.bucketBy(n, "chunk").option("compression", "zstd").saveAsTable(name)
    chunks = spark.table(name)
    buckets = max(n, chunks.count() // CHUNKS_IN_BUCKET)

    def gathered(answers, as_name, *cols):
        # A chunk gets at most one answer for each bucket, so these lists are bounded by the chunk's size.
        out = scratch.table(answers.groupBy("chunk").agg(F.collect_list(F.struct(*cols)).alias(as_name)), f"suffix-{as_name}")
        scratch.release(spark)
        return out

    whole = chunks.drop("text").mapInArrow(lean(_tell_texts(length, buckets)), "bucket int, chunk long, texts binary, first binary")
    copies = gathered(whole.groupBy("bucket").applyInArrow(_meet_texts, "chunk long, bucket int, told binary"), "copies", "bucket", "told")
    chunks = chunks.join(copies, "chunk", "left")
    least = chunks.mapInArrow(lean(_tell_least(length, buckets)), "bucket int, chunk long, least binary")
    repeats = gathered(least.groupBy("bucket").applyInArrow(_meet_least, "chunk long, bucket int, told binary"), "repeats", "bucket", "told")
    known = chunks.join(repeats, "chunk", "left")
    pairs = known.mapInArrow(lean(_tell_contexts(length, buckets)), "bucket int, chunk long, base long, least binary, context binary, first binary, long binary")
    contexts = gathered(pairs.groupBy("bucket").applyInArrow(_meet_contexts, "chunk long, bucket int, told binary"), "contexts", "bucket", "told")
    known = known.join(contexts, "chunk", "left")
    strings = known.mapInArrow(lean(_tell_strings(length, buckets)), "bucket int, chunk long, base long, sizes binary, docs binary, part binary, text binary, hashes binary, least binary, whose binary")
    found = gathered(strings.groupBy("bucket").applyInArrow(_meet_strings(length), "chunk long, strings binary, least binary"), "strings", "strings", "least")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    out = scratch.table(known.join(found, "chunk", "left").mapInArrow(lean(_remove(length, buckets, texts)), schema), "suffix-result")
    scratch.drop(copies, repeats, contexts, found)
    spark.sql(f"DROP TABLE {name}")
    return out.withColumnRenamed("id", id_col)
