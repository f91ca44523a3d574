"""Quality classification by importance resampling.

Words and word pairs, hashed to a fixed number of buckets, are counted for all documents (the raw text) and for a
bounded sample of documents labelled good (the target). A document's log weight is the log ratio of its probabilities
under the two smoothed bucket models: the sum over its n-grams. Gumbel noise seeded by the row is added, and
the k best rows of the whole table are chosen: a draw without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .textkit import U, blocks, mix, word_hashes, words

BUCKETS = 1 << 15
#: Labelled documents that the target model is fitted on, at most.
TARGET_ROWS = 20_000
KEEP = 0.8
SEED = 71


def _grams(offsets, block):
    """Bucket and row of each word and each pair of neighbouring words of a row."""
    starts, ends, row = words(offsets, block)
    h = word_hashes(block, starts, ends)
    pair = mix(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:])[row[1:] == row[:-1]] if len(h) > 1 else h[:0]
    at = np.concatenate((h, pair)) >> U(64 - BUCKETS.bit_length() + 1)
    return at.astype(np.int64), np.concatenate((row, row[1:][row[1:] == row[:-1]])) if len(h) else row


def _count(target):
    def run(batches):
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        wanted = target.value
        for batch in batches:
            chosen = np.isin(batch.column("key").to_numpy(zero_copy_only=False), wanted) & np.asarray(batch.column("id").is_valid())
            for first, offsets, block in blocks(batch, "text"):
                at, row = _grams(offsets, block)
                raw += np.bincount(at, minlength=BUCKETS)
                good += np.bincount(at[chosen[first : first + len(offsets) - 1][row]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([raw.tobytes(), good.tobytes()], pa.binary())], ["model", "counts"])

    return run


def _add(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in groups:
        for x in batch.column("counts").to_pylist():
            total += np.frombuffer(x, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["model", "counts"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("key"), F.col(text_col).alias("text"))


def log_ratios(docs: DataFrame, good_ids: DataFrame, id_col: str, text_col: str, bound: int = TARGET_ROWS) -> np.ndarray:
    """Log ratio of target to raw probability of each bucket. ``good_ids(id)`` is cut to about ``bound`` rows by hash."""
    key = F.xxhash64(F.col("id").cast(docs.schema[id_col].dataType))
    n = good_ids.count()
    chosen = good_ids.where(F.pmod(F.xxhash64(F.lit("target"), "id"), F.lit(1 << 30)) < int(min(1.0, 0.95 * bound / max(n, 1)) * (1 << 30))).select(key.alias("key")).limit(bound)
    wanted = docs.sparkSession.sparkContext.broadcast(np.array([r[0] for r in chosen.collect()], np.int64))
    counts = _keyed(docs, id_col, text_col).mapInArrow(_count(wanted), "model int, counts binary")
    total = {r[0]: np.frombuffer(r[1], np.int64) for r in counts.groupBy("model").applyInArrow(_add, "model int, counts binary").collect()}
    raw, good = (total.get(i, np.zeros(BUCKETS, np.int64)) + 1.0 for i in (0, 1))
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def _score(ratios, seed):
    def run(batches):
        ratio = ratios.value
        for batch in batches:
            for first, offsets, block in blocks(batch, "text"):
                n = len(offsets) - 1
                at, row = _grams(offsets, block)
                count = np.bincount(row, minlength=n)
                weight = np.bincount(row, ratio[at], minlength=n)
                key = mix(mix(batch.column("key").slice(first, n).to_numpy(zero_copy_only=False).view(U) + U(seed)) + U(0x632BE59BD9B4E019))
                noise = -np.log(-np.log(((key >> U(11)).astype(np.float64) + 0.5) * 2.0**-53))
                none = count == 0
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, n), pa.array(count, pa.int64()), pa.array(weight, pa.float64(), mask=none), pa.array(weight + noise, pa.float64(), mask=none)], ["id", "n_grams", "log_weight", "perturbed"])

    return run


def resample(docs: DataFrame, good_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """One row per input row: id, n_grams, log_weight, perturbed, place, selected.

    ``selected`` holds for the ``floor(keep * n)`` rows of the largest perturbed weight, n being the rows with at
    least one word; ties go to the smaller id. A null, empty or blank text has no n-gram, null weights and is not
    selected. Ids may be of any type that hashes; rows that share an id, or have none, get the same noise. Without target
    rows all ratios come from the raw model alone. An empty table gives an empty result. Other columns are ignored.
    """
    scratch.bounded_batches(docs.sparkSession)
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, good_ids, id_col, text_col))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_grams", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("log_weight", "perturbed"))])
    scored = _keyed(docs, id_col, text_col).mapInArrow(_score(ratios, seed), schema)
    scored = scratch.table(scored, "importance").withColumn("back", -F.col("perturbed"))
    some = scored.where("perturbed is not null")
    k = int(keep * some.count())
    placed = scratch.ranked(some, [], ["back", "id"], "place").withColumn("selected", F.col("place") <= k)
    rest = scored.where("perturbed is null").withColumns({"place": F.lit(None).cast("long"), "selected": F.lit(False)})
    return placed.union(rest).drop("back").withColumnRenamed("id", id_col)
