"""Exact duplicates of whole texts by two-pass Bloom filtering.

Pass one folds the hash of every text into counting Bloom filters of a fixed number of slots, kept as two
bit maps: slots hit once, slots hit twice or more. Pass two reads the rows again; a row whose every slot was
hit twice may repeat and is shuffled, and all other rows are certainly single and pass straight through.
The bit map is the only thing broadcast. Its size follows the number of rows up to a bound of 32 MB, which suits about
30 million rows: beyond, more rows shuffle and the result stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textkit import U, bit_at, lean, mix

PROBES = 3
SEGMENTS = 64
#: What is broadcast has at most 2**28 bits, 32 MB.
MOST_BITS = 28


def _slots(key: np.ndarray, bits: int) -> np.ndarray:
    out = np.empty((PROBES, len(key)), np.uint32)
    for i in range(PROBES):
        out[i] = mix(key + U(0x632BE59BD9B4E019 * (i + 1) & (1 << 64) - 1)) >> U(64 - bits)
    return out


def _hits(bits: int, among=None):
    """Map side: for each segment of the slots, those hit and whether more than once in this batch. With a filter ``among``,
    only keys that hit it count."""

    def run(batches):
        width = (1 << bits) // SEGMENTS
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if among is not None:
                key = key[_all_hit(among.value, key, bits)]
            slots = np.sort(np.concatenate([np.unique(s.astype(np.uint64) << np.uint64(32) | np.arange(len(s), dtype=np.uint64)) for s in _slots(key, bits)]))
            # A row that hits one slot by two probes counts once.
            slots = np.unique(slots) >> np.uint64(32)
            slot, times = np.unique(slots, return_counts=True)
            cut = np.searchsorted(slot, np.arange(SEGMENTS + 1, dtype=np.uint64) * np.uint64(width))
            rows = [(s, (slot[a:b] - np.uint64(s * width)).astype(np.uint32).tobytes(), (times[a:b] > 1).tobytes()) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["segment", "slots", "more"])

    return run


def _fold(bits: int, least: int):
    """Reduce side: one bit map of slots hit by ``least`` keys, one or two, for one segment, batch by batch."""

    def run(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = (1 << bits) // SEGMENTS
        once, twice = np.zeros(width, bool), np.zeros(width, bool)
        for batch in groups:
            for slots, more in zip(batch.column("slots").to_pylist(), batch.column("more").to_pylist(), strict=True):
                at = np.frombuffer(slots, np.uint32)
                twice[at] |= once[at] | np.frombuffer(more, bool)
                once[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(twice if least > 1 else once).tobytes()], pa.binary())], ["segment", "bits"])

    return run


def key_filter(keys: DataFrame, bits: int, least: int = 1, among=None) -> bytes:
    """Bit map of slots that ``least`` rows (one or two) of ``keys(key long)`` hit. Its size is 2**bits / 8 bytes whatever the data."""
    hits = keys.mapInArrow(lean(_hits(bits, among)), "segment int, slots binary, more binary")
    folded = hits.groupBy("segment").applyInArrow(_fold(bits, least), "segment int, bits binary")
    size = (1 << bits) // SEGMENTS // 8
    out = bytearray(size * SEGMENTS)
    for segment, part in folded.collect():
        out[segment * size : (segment + 1) * size] = part
    return bytes(out)


def _all_hit(packed: bytes, keys: pa.Array | np.ndarray, bits: int) -> np.ndarray:
    own = keys if isinstance(keys, np.ndarray) else keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return np.logical_and.reduce([bit_at(np.frombuffer(packed, np.uint8), s) for s in _slots(own, bits)])


def fitting_bits(rows: int, least: int = 16, most: int = MOST_BITS) -> int:
    """Slots, as a power of two, that leave about 2 % of single rows in doubt: eight for each row, as far as the bound allows."""
    return max(least, min(most, (8 * max(rows, 1) - 1).bit_length()))


def maybe_repeated(df: DataFrame, key: str, bits: int, name: str = "maybe") -> DataFrame:
    """``df`` with a boolean column: false only if no other row has the same key. Only the key leaves the JVM."""
    scratch.bounded_batches(df.sparkSession)
    filter_ = df.sparkSession.sparkContext.broadcast(key_filter(df.select(key), bits, 2))

    @F.arrow_udf("boolean")
    def seen(keys: pa.Array) -> pa.Array:
        return pa.array(_all_hit(filter_.value, keys, bits))

    return df.withColumn(name, seen(F.col(key)))


def settled(df: DataFrame, key: Column, yes: DataFrame, no: DataFrame, bits: int, name: str = "settled") -> DataFrame:
    """``df`` with an int column: 1 if its key is certainly in ``yes(key long)``, 0 if certainly in ``no(key long)``, else null.

    Every key of ``df`` is in one of the two, or in both: then it is null. One filter holds the keys of ``yes``, another those
    of ``no`` that hit the first: what misses the first is in ``no``, what misses only the second is in ``yes``. Few others
    are left as long as the filters are not full. Only the key leaves the JVM, and nothing is shuffled but slots of keys.
    """
    scratch.bounded_batches(df.sparkSession)
    context = df.sparkSession.sparkContext
    first = context.broadcast(key_filter(yes, bits))
    second = context.broadcast(key_filter(no, bits, among=first))

    @F.arrow_udf("int")
    def told(keys: pa.Array) -> pa.Array:
        one = _all_hit(first.value, keys, bits)
        return pa.array(one.astype(np.int32), mask=one & _all_hit(second.value, keys, bits))

    return df.withColumn(name, told(key))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of rows with identical texts the one with the largest id stays. A null text counts as the empty text, so
    null and empty texts are one group. Rows that share both id and text are one group too: each reports
    kept = (id = keep_id). A row with a null id is never the one that stays unless its whole group lacks ids.
    An empty table gives an empty result. Other columns are ignored. The filter has ``2**bits`` slots, by default as many
    as the number of rows asks for, up to 32 MB.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("sha"))
    hashed = scratch.table(hashed.withColumn("key", F.xxhash64("sha")), "exact-dedup")
    marked = maybe_repeated(hashed, "key", bits or fitting_bits(hashed.count()))
    single = marked.where("not maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"), "sha")
    rows = marked.where("maybe").select("id", "sha")
    groups = scratch.table(rows.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n")), "exact-dedup-groups")
    # Both sides of this join are plain exchanges, so adaptive execution splits a hot group of copies.
    repeated = rows.join(groups, "sha").select("id", "keep_id", "n", "sha")
    out = single.union(repeated)
    return out.select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"),
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """``docs`` with one row of each group of equal texts: the row with the largest id, one of them if that id repeats.

    Nulls, empty texts and empty tables as in :func:`exact_dedup`. All columns are kept. Only ids and hashes of rows that may
    repeat are shuffled and compared; then texts are shuffled only of the few rows that :func:`settled` leaves open, and of
    those that stay but share id and text with another.
    """
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])  # other columns may have any name
    id_, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    bits = bits or fitting_bits(docs.count())
    with scratch.scope(docs.sparkSession) as keep:
        hashed = scratch.table(own.select(F.col(id_).alias("id"), sha.alias("sha")).withColumn("key", F.xxhash64("sha")), "exact-dedup-hashes")
        # A table, so that no other Python worker runs beside the one that marks.
        marked = scratch.table(maybe_repeated(hashed, "key", bits).withColumn("mark", F.xxhash64("id", "sha")), "exact-dedup-marked")
        rows = marked.where("maybe").select("id", "sha", "mark")
        groups = keep(scratch.table(rows.groupBy("sha").agg(F.max("id").alias("keep_id")), "exact-dedup-groups"))
        found = rows.join(groups, "sha").groupBy("mark").agg(F.bool_or(F.col("id").eqNullSafe(F.col("keep_id"))).alias("stays"), F.count(F.lit(1)).alias("n"))
        found = scratch.table(found, "exact-dedup-found")
        single = marked.where("not maybe").select("mark")
        told = settled(own, F.xxhash64(F.col(id_), sha), found.where("not stays or n > 1").select("mark"), single.union(found.where("stays").select("mark")), bits)
    stay = told.where("settled = 0").select(own.columns)
    left = told.where("settled is null").select(*own.columns, sha.alias("sha")).join(groups, "sha", "left")
    # A text that is in no group is single.
    left = left.where(F.col("keep_id").isNull() | F.col(id_).eqNullSafe(F.col("keep_id"))).dropDuplicates(["sha"])
    return stay.union(left.select(own.columns)).toDF(*names)
