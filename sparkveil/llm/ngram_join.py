"""Exact Jaccard self-join of word-shingle sets by rare-first prefix filtering.

1. Words and shingles of all documents are counted in sketches of a fixed number of cells. Shingles whose cell holds far
   more than its share are common and stand last; the others stand in order of the mean log count of their words. Any
   order that depends on content alone makes prefix filtering exact; this one puts rare shingles first.
2. Each document becomes its set size, a 128-bit signature of the set, its prefix (rarest shingles) and parities
   of its set over 1,024 hash cells. Documents with equal sets are one class; its smallest id stands for it.
3. Prefix shingles are dealt by range and sorted, so that a task streams whole posting lists, a very long one lies over several
   tasks, and lists of one member go at once. Each member is paired with its neighbour, in an order of like size and
   otherwise scattered: round one.
4. Round two pairs all members of a list that are in different components so far. So a large family of near copies
   costs pairs in proportion to its size, and yet no link between components is lost. Both rounds apply the length,
   positional and suffix filters, and each pair is verified once, by intersecting the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .exact_dedup import fitting_bits, maybe_repeated, settled
from .textkit import U, bit_at, blocks, lean, mix, shingles, word_hashes, words

#: Cells of the sketches of words and of shingles.
CELLS = 1 << 20
SHINGLE_CELLS = 1 << 21
#: A shingle is common if its cell holds so many times the mean of all cells, and at least so many.
COMMON, COMMON_LEAST = 8, 16
SEGMENTS = 64
BLOCK_ROWS = 256
BLOCK_BYTES = 1 << 18
PARITY = 16
#: Cells of the parities that pairs are sifted by once more before whole sets travel.
FINE = 1 << 13


def _small(counts: np.ndarray) -> bytes:
    """Counts as a byte each, then cells and counts of those that a byte does not hold."""
    over = np.flatnonzero(counts > 254)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + over.astype(np.uint32).tobytes() + counts[over].astype(np.uint32).tobytes()


def _add_small(total: np.ndarray, packed: bytes) -> None:
    low = np.frombuffer(packed, np.uint8, len(total)).astype(np.int64)
    over, counts = np.frombuffer(packed, np.uint32, offset=len(total)).reshape(2, -1)
    low[over] = counts
    total += low


def _count(text_col: str, k: int):
    def run(batches):
        total = np.zeros(CELLS, np.uint32), np.zeros(SHINGLE_CELLS, np.uint32)
        for batch in batches:
            for _, offsets, block in blocks(batch, text_col, 4096, BLOCK_BYTES):
                starts, ends, row = words(offsets, block)
                h = word_hashes(block, starts, ends)
                for sums, x in zip(total, (h, shingles(h, row, len(offsets) - 1, k)[0]), strict=True):
                    cell, times = np.unique((x & U(len(sums) - 1)).astype(np.uint32), return_counts=True)
                    sums[cell] += times.astype(np.uint32)
        parts = [(kind * SEGMENTS + i, x) for kind, sums in enumerate(total) for i, x in enumerate(sums.reshape(SEGMENTS, -1)) if x.any()]
        for i in range(0, len(parts), 16):
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts[i : i + 16]], pa.int32()), pa.array([_small(p[1]) for p in parts[i : i + 16]], pa.binary())], ["segment", "counts"])

    return run


def _level(counts) -> np.ndarray:
    return np.minimum(np.log2(1 + np.asarray(counts)) * 6, 255).astype(np.uint8)


def _sum_counts(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    segment = key[0].as_py()
    total = np.zeros((SHINGLE_CELLS if segment >= SEGMENTS else CELLS) // SEGMENTS, np.int64)
    for batch in groups:
        for x in batch.column("counts"):
            _add_small(total, x.as_py())
    yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([int(total.sum())], pa.int64()), pa.array([_level(total).tobytes()], pa.binary())], ["segment", "total", "level"])


def rarities(docs: DataFrame, text_col: str, k: int) -> tuple[bytes, bytes, int]:
    """Log counts of the cells of words and of shingles, one byte each whatever the data, and the level from which a shingle is common."""
    counts = docs.select(text_col).mapInArrow(lean(_count(text_col, k)), "segment int, counts binary")
    out, total = (np.zeros((SEGMENTS, CELLS // SEGMENTS), np.uint8), np.zeros((SEGMENTS, SHINGLE_CELLS // SEGMENTS), np.uint8)), 0
    for segment, n, level in counts.groupBy("segment").applyInArrow(_sum_counts, "segment int, total long, level binary").collect():
        out[segment // SEGMENTS][segment % SEGMENTS] = np.frombuffer(level, np.uint8)
        total += n if segment >= SEGMENTS else 0
    return out[0].tobytes(), out[1].tobytes(), int(_level(max(COMMON * total / SHINGLE_CELLS, COMMON_LEAST)))


def _ordered_sets(offsets, block, k, rarity=None):
    """Distinct shingles of each row, rare first: (row, hash), in order of row, rarity and hash."""
    starts, ends, row = words(offsets, block)
    h = word_hashes(block, starts, ends)
    sh, srow, at, length = shingles(h, row, len(offsets) - 1, k)
    place = np.zeros(len(sh), U)
    if rarity:
        of_words, of_shingles, common = rarity
        upto = np.concatenate(([0], np.cumsum(of_words[(h & U(CELLS - 1)).astype(np.int64)], dtype=np.int64)))
        own = of_shingles[(sh & U(SHINGLE_CELLS - 1)).astype(np.int64)]
        place = np.where(own >= common, 128 + (own >> 1), (upto[at + length] - upto[at]) // (2 * np.maximum(length, 1))).astype(U)
    key = (srow.astype(U) << U(56)) | (place << U(48)) | (sh >> U(16))
    order = np.argsort(key)
    key, sh = key[order], sh[order]
    if ((key[1:] == key[:-1]) & (sh[1:] != sh[:-1])).any():  # hardly ever: the low bits decide
        order = np.lexsort((sh, key))
        key, sh = key[order], sh[order]
    if len(key):
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (sh[1:] != sh[:-1])))
        key, sh = key[new], sh[new]
    return (key >> U(56)).astype(np.int64), sh


def prefix_length(n, num: int, den: int):
    """Shingles of a set of n that must hold one of any set with Jaccard similarity of num/den or more."""
    return n - (n * num + den - 1) // den + 1


def _profile(id_col, text_col, k, num, den, rarity):
    def run(batches):
        of_words, of_shingles, common = rarity.value
        order = np.frombuffer(of_words, np.uint8), np.frombuffer(of_shingles, np.uint8), common
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_col))
            for first, offsets, block in blocks(batch, text_col, BLOCK_ROWS, BLOCK_BYTES):
                n_rows = len(offsets) - 1
                row, h = _ordered_sets(offsets, block, k, order)
                n = np.bincount(row, minlength=n_rows)
                edge = np.concatenate(([0], np.cumsum(n)))
                sums = [np.concatenate((np.zeros(1, U), np.cumsum(mix(h + U(c)), dtype=U))) for c in (0x1234567, 0x89ABCDEF01)]
                s1, s2 = ((s[edge[1:]] - s[edge[:-1]]).view(np.int64) for s in sums)
                odd = np.bincount(row * (PARITY * 64) + (h & U(PARITY * 64 - 1)).astype(np.int64), minlength=n_rows * PARITY * 64).astype(np.uint8) & 1
                parity = np.packbits(odd.reshape(n_rows, -1), axis=1).view(np.int64)
                cut = np.where(n > 0, prefix_length(n, num, den), 0)
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(cut))), pa.int32()), pa.array(h[np.arange(len(h)) - edge[row] < cut[row]].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, n_rows).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(s1), pa.array(s2), prefix, *(pa.array(np.ascontiguousarray(parity[:, i])) for i in range(PARITY))],
                    ["id", "n", "s1", "s2", "prefix", *(f"p{i}" for i in range(PARITY))],
                )

    return run


def _possible(n, pos, m, at, num, den):
    """Length and positional filter of two sets of n and m that share the elements at these places."""
    need = -(-num * (n + m) // (num + den))
    return (np.minimum(n, m) * den >= np.maximum(n, m) * num) & (np.minimum(pos, at) + np.minimum(n - pos, m - at) >= need)


def _lists(num: int, den: int):
    """From sorted postings (token, id, n, pos) the lists of two members or more, each member with its neighbour before (null if
    no link is possible). The first and last list of a task may go on in another, so they stay whatever their size."""

    def run(batches):
        first = held = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            tied, partner, paired = np.zeros(1, bool), np.zeros(1, np.int64), np.zeros(1, bool)
            if held is not None:
                cols = [np.concatenate((x, y)) for x, y in zip(held[0], cols, strict=True)]
                tied, partner, paired = held[1]
            token, at, n, pos = cols
            if not len(token):
                continue
            first = token[0] if first is None else first
            same = token[1:] == token[:-1]
            tied = np.concatenate((tied, same))
            partner = np.concatenate((partner, at[:-1]))
            paired = np.concatenate((paired, same & (at[1:] != at[:-1]) & _possible(n[1:], pos[1:], n[:-1], pos[:-1], num, den)))
            live = tied[:-1] | same | (token[:-1] == first)
            held = [x[-1:] for x in cols], (tied[-1:], partner[-1:], paired[-1:])
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:-1][live]) for x in cols), pa.array(partner[:-1][live], mask=~paired[:-1][live])], ["token", "id", "n", "pos", "beside"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in held[0]), pa.array(held[1][1], mask=~held[1][2])], ["token", "id", "n", "pos", "beside"])

    return run


def _whole_sets(id_col, text_col, k, wanted, bits):
    """Sets of the rows whose id hits the bit map, as 64-bit hashes; a task gives equal rows once."""

    def run(batches):
        want, seen = np.frombuffer(wanted.value, np.uint8), set()
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64())
            batch = batch.filter(pa.array(_hit(want, ids, bits)))
            ids = batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64())
            for first, offsets, block in blocks(batch, text_col, BLOCK_ROWS, BLOCK_BYTES):
                row, h = _ordered_sets(offsets, block, k)
                edge = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(offsets) - 1)))).tolist()
                rows = zip(ids.slice(first, len(offsets) - 1).to_pylist(), (h[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)), strict=True)
                rows = [(i, x) for i, x in rows if x and (mark := (i, len(x), hash(x))) not in seen and not seen.add(mark)]
                odd = [np.packbits(np.bincount((np.frombuffer(x, U) & U(FINE - 1)).astype(np.int64), minlength=FINE).astype(np.uint8) & 1).tobytes() for _, x in rows]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([len(x) // 8 for _, x in rows], pa.int64()), pa.array(odd, pa.binary()), pa.array([x for _, x in rows], pa.binary())], ["id", "n", "odd", "hashes"])

    return run


def _maybe(hit, bits: int):
    """Function of a column of ids: whether they hit the broadcast bit map. Other columns stay in the JVM."""

    @F.arrow_udf("boolean")
    def maybe(ids: pa.Array) -> pa.Array:
        return pa.array(_hit(np.frombuffer(hit.value, np.uint8), ids, bits))

    return maybe


def _hit(want: np.ndarray, ids, bits: int) -> np.ndarray:
    slot = (mix(ids.fill_null(0).to_numpy(zero_copy_only=False).view(U)) >> U(64 - bits)).astype(np.int64)
    return bit_at(want, slot) & np.asarray(ids.is_valid())


def _wanted_bits(bits: int):
    def run(batches):
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            for i in range(batch.num_columns):
                seen[(mix(batch.column(i).to_numpy(zero_copy_only=False).view(U)) >> U(64 - bits)).astype(np.int64)] = True
        width = (1 << bits) // SEGMENTS
        parts = [(s, p) for s in range(SEGMENTS) if (p := seen[s * width : (s + 1) * width]).any()]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int32()), pa.array([np.packbits(p).tobytes() for _, p in parts], pa.binary())], ["segment", "bits"])

    return run


def _or_bits(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = None
    for batch in groups:
        for x in batch.column("bits").to_pylist():
            x = np.frombuffer(x, np.uint8)
            out = x.copy() if out is None else out | x
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["segment", "bits"])


def _id_bits(ids: DataFrame, bits: int) -> bytes:
    """Bit map that every id in any column hits: 2**bits / 8 bytes whatever the data."""
    seen = ids.mapInArrow(lean(_wanted_bits(bits)), "segment int, bits binary").groupBy("segment").applyInArrow(_or_bits, "segment int, bits binary")
    size = (1 << bits) // SEGMENTS // 8
    out = bytearray(size * SEGMENTS)
    for segment, x in seen.collect():
        out[segment * size : (segment + 1) * size] = x
    return bytes(out)


def _sift(num: int, den: int):
    """Pairs whose fine parities differ in no more cells than a link has differing shingles."""

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), U).reshape(len(na), FINE // 64) for i in (4, 5))
            apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(apart <= na + nb - 2 * (-(-num * (na + nb) // (num + den)))))

    return run


def _verify(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                both = np.concatenate((np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(same * den >= num * (len(both) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _near(pairs: DataFrame, classes: DataFrame, num: int, den: int, bits: int) -> DataFrame:
    """The pairs (a, b) that pass the suffix filter: cells of odd difference are no more than the differing shingles, of which a link has few."""
    hit = pairs.sparkSession.sparkContext.broadcast(_id_bits(pairs.select("a", "b"), bits))
    asked = classes.where(_maybe(hit, bits)(F.col("rep"))).select("rep", "n", *(f"p{i}" for i in range(PARITY)))
    left, right = (asked.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), *(F.col(f"p{i}").alias(f"{x}{i}") for i in range(PARITY))) for x in "ab")
    apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(PARITY)), F.lit(0))
    need = F.ceil(F.lit(num) * (F.col("na") + F.col("nb")) / F.lit(num + den))
    near = pairs.join(left, "a").join(right, "b").where(apart <= F.col("na") + F.col("nb") - 2 * need).select("a", "b")
    return scratch.table(near, "ngram-near")


def _links(near: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, bits: int) -> DataFrame:
    """Those of the pairs (a, b) that are links by their whole sets, as a table. Fine parities come first: they are small, and
    few pairs but links are left for the whole sets."""
    wanted = near.sparkSession.sparkContext.broadcast(_id_bits(near.select("a", "b"), bits))
    sets = scratch.table(docs.select(id_col, text_col).mapInArrow(lean(_whole_sets(id_col, text_col, k, wanted, bits)), "id long, n long, odd binary, hashes binary"), "ngram-sets")
    x, y = sets.select("id", "n", "odd").alias("x"), sets.select("id", "n", "odd").alias("y")
    both = near.select("a", "b").join(x, F.col("a") == F.col("x.id")).select("a", "b", F.col("x.n").alias("na"), F.col("x.odd").alias("x")).join(y, F.col("b") == F.col("y.id"))
    likely = scratch.table(both.select("a", "b", "na", F.col("y.n").alias("nb"), "x", F.col("y.odd").alias("y")).mapInArrow(lean(_sift(num, den)), "a long, b long").distinct(), "ngram-likely")
    # The sets still asked for are written first: in one plan with the joins, where these broadcast, the filter would run beside
    # the verification, in workers of its own.
    wanted = near.sparkSession.sparkContext.broadcast(_id_bits(likely, bits))
    asked = scratch.table(sets.where(_maybe(wanted, bits)(F.col("id"))).select("id", "hashes"), "ngram-asked")
    scratch.drop(sets, near)
    x, y = asked.alias("x"), asked.alias("y")  # one exchange serves both joins
    full = likely.join(x, F.col("a") == F.col("x.id")).select("a", "b", F.col("x.hashes").alias("x")).join(y, F.col("b") == F.col("y.id"))
    links = scratch.table(full.select("a", "b", "x", F.col("y.hashes").alias("y")).mapInArrow(lean(_verify(num, den)), "a long, b long").distinct(), "ngram-links")
    scratch.drop(asked, likely)
    return links


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, bits: int = 24) -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    Two documents link when ``den * |intersection| >= num * |union|`` of their sets of k-word shingles (words
    ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; fewer than k words: the whole sequence as one shingle).
    ``component_id`` is the smallest id reachable by links, itself included. A null, empty or blank text has no
    shingle and links with nothing. Rows of equal sets are one class however many. Rows that share an id are one document:
    it links with whatever the text of any of them links with. A null id joins nothing: its component_id is null. An empty
    table gives an empty result. Only components come out: links inside one are not all verified, and there is no list or
    count of links. Sets are compared by 64-bit hashes of shingles. ``bits`` sizes the bit map, 2**bits / 8 bytes, that tells
    which texts must be read again; beyond its capacity more are read, and the result stays the same.
    """
    spark = docs.sparkSession
    scratch.bounded_batches(spark)
    rarity = rarities(docs, text_col, k)
    rarity = spark.sparkContext.broadcast(rarity)
    schema = "id long, n long, s1 long, s2 long, prefix array<long>, " + ", ".join(f"p{i} long" for i in range(PARITY))
    profile = scratch.table(docs.select(id_col, text_col).mapInArrow(lean(_profile(id_col, text_col, k, num, den, rarity)), schema), "ngram-profile")
    rarity.unpersist()
    # Of rows that may have an equal set elsewhere, one stands for each set; the others pass straight through.
    data = [F.struct("prefix", *(f"p{i}" for i in range(PARITY))).alias("x")]
    filled = maybe_repeated(profile.where("n > 0 and id is not null"), "s1", fitting_bits(profile.count()))
    once = filled.where("maybe").groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.first(*data).alias("x")).select("rep", "n", "s1", "s2", "x.*")
    classes = scratch.table(filled.where("not maybe").withColumnRenamed("id", "rep").select(once.columns).union(once), "ngram-classes")
    member = scratch.table(profile.select("id", "n", "s1", "s2"), "ngram-member")
    scratch.drop(profile)
    like = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num)) if num < den else F.col("n")
    order = "token", like, F.xxhash64("id", F.col("token") % 3)
    postings = classes.select(F.col("rep").alias("id"), F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token")).select("token", "id", "n", "pos")
    dealt = postings.repartitionByRange(scratch.partitions(spark), *order).sortWithinPartitions(*order)
    live = scratch.table(dealt.select("token", "id", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos")).mapInArrow(lean(_lists(num, den)), "token long, id long, n long, pos long, beside long"), "ngram-live")
    # Round one: neighbours in each list.
    first = scratch.table(live.where("beside is not null").select(F.least("id", "beside").alias("a"), F.greatest("id", "beside").alias("b")).distinct(), "ngram-first")
    check = id_col, text_col, k, num, den, bits
    links = _links(_near(first, classes, num, den, bits), docs, *check)
    label = scratch.table(scratch.components(links), "ngram-labels")
    # Round two: members of a list in different components.
    # Parities over 256 cells, folded from the 1,024, come along so that the join itself applies the suffix filter.
    folded = [(F.col(f"p{i}").bitwiseXOR(F.col(f"p{i + 4}")).bitwiseXOR(F.col(f"p{i + 8}")).bitwiseXOR(F.col(f"p{i + 12}"))).alias(f"q{i}") for i in range(4)]
    named = classes.select(F.col("rep").alias("id"), "n", *folded).join(label.withColumnRenamed("vertex", "id"), "id", "left")
    named = named.select("id", "n", F.coalesce("component", "id").alias("label"), *(f"q{i}" for i in range(4)))
    rest = scratch.table(live.select("token", "id", "n", "pos").join(named, ["id", "n"]), "ngram-rest")
    scratch.drop(live)
    a, b = rest.alias("a"), rest.alias("b")
    low, high = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    need = F.ceil(F.lit(num) * (F.col("a.n") + F.col("b.n")) / F.lit(num + den))
    most = F.least("a.pos", "b.pos") + F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    on = (F.col("a.token") == F.col("b.token")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.label") != F.col("b.label")) & (low * den >= high * num) & (most >= need)
    apart = sum((F.bit_count(F.col(f"a.q{i}").bitwiseXOR(F.col(f"b.q{i}"))) for i in range(4)), F.lit(0))
    on = on & (apart <= F.col("a.n") + F.col("b.n") - 2 * need)
    second = a.join(b, on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), apart.alias("apart"), F.least("a.label", "b.label").alias("la"), F.greatest("a.label", "b.label").alias("lb"))
    second = scratch.table(second.distinct().join(first, ["a", "b"], "left_anti"), "ngram-second")
    near = _near(second, classes, num, den, bits)
    scratch.drop(rest, first, links)
    # The likest pair of each two components goes first; then the pairs whose components are still apart.
    near = scratch.table(second.join(near, ["a", "b"], "left_semi"), "ngram-apart")
    likest = near.groupBy("la", "lb").agg(F.min(F.struct("apart", "a", "b")).alias("x")).select("x.a", "x.b")
    label = _joined(label, _links(scratch.table(likest, "ngram-likest"), docs, *check))
    for side in "ab":
        named = label.select(F.col("vertex").alias(side), F.col("component").alias(f"new_{side}"))
        near = near.join(named, side, "left").withColumn(f"new_{side}", F.coalesce(f"new_{side}", side))
    third = scratch.table(near.where("new_a <> new_b").join(likest, ["a", "b"], "left_anti").select("a", "b"), "ngram-third")
    label = _joined(label, _links(third, docs, *check))
    scratch.drop(second)
    member = member.join(classes.select("s1", "s2", "n", F.col("rep").alias("vertex")), ["s1", "s2", "n"], "left")
    out = member.select("id", "n", F.when(F.col("n") > 0, F.col("vertex")).alias("vertex")).join(label, "vertex", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "vertex", "id")).alias("component_id"))


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: the components so far are stars, so few rounds join them."""
    if links.isEmpty():
        return label
    stars = label.where("vertex <> component").select(F.col("vertex").alias("a"), F.col("component").alias("b"))
    return scratch.table(scratch.components(stars.union(links)), "ngram-labels")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component of :func:`ngram_components`: that with the smallest id.

    All columns are kept. Rows that share an id are one document and stay or go together; rows with a null id or
    without words stay. Rows that :func:`settled` decides pass straight through or go, the few others are joined.
    """
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    id_ = F.col(f"c{names.index(id_col)}").cast("long")
    with scratch.scope(docs.sparkSession) as keep:
        found = ngram_components(docs.select(id_col, text_col), id_col, text_col, k, num, den)
        found = found.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col) != F.col("component_id"), F.lit(False)).alias("goes"))
        found = keep(scratch.table(found.withColumn("mark", F.xxhash64("id")), "ngram-goes"))
    bits = fitting_bits(found.count())
    told = settled(own, F.xxhash64(id_), found.where("goes").select("mark"), found.where("not goes").select("mark"), bits)
    gone = found.where("goes").select("id").distinct()
    rest = told.where("settled is null").join(gone, id_ == F.col("id"), "left_anti")
    return told.where("settled = 0").union(rest).drop("settled").toDF(*names)
