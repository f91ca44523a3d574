"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Candidates are cut into blocks; a block keeps one list per dimension, sorted by that component. A query reads each
list from the end where its own component makes large contributions, ever deeper, and only sequentially. After
each depth a candidate's lower bound takes the list's worst contribution for the lists in which it has not been
seen and the upper bound takes the last contribution read. Reading stops when no candidate outside the best k by lower
bound can reach the k-th; the scores of the few that may still belong to the result are then resolved from what
remains of their lists. The sums of a depth are matrix products for all open queries of a block at once.

Components are integers. Where all sums of a query and a block are exact in double precision, they are taken there;
other queries of the block are scored in integers, whole. So ties are real ties.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

BLOCK = 4096
QUERY_BLOCK = 512
DEPTHS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0)


#: Integers up to this are exact as doubles; up to the other, sums stay within a long with room to spare.
DOUBLE, LONG = 2.0**53, 2.0**62


def quantised(embedding: Column, scale: int = 256, strict: bool = False) -> Column:
    """floor(scale * x) of each component x as double, as longs.

    Null if the vector is null, or has a component that is null or not finite. A finite component that no long holds
    once scaled makes the vector null too, or with ``strict`` raises.
    """
    finite = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    fits = F.forall(embedding, lambda x: F.abs(x.cast("double") * scale) < 2.0**63)
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))
    over = F.raise_error(F.lit("a component of an embedding is too large for a long")).cast("array<bigint>") if strict else F.lit(None)
    return F.when(finite, F.when(fits, whole).otherwise(over))


def _largest(x: np.ndarray) -> np.ndarray:
    """The largest absolute component of each row, as a double."""
    return np.abs(x.astype(np.float64)).max(axis=1, initial=0.0)


class Lists:
    """Sorted lists of a block: for each dimension the place of each candidate from the top, and from the bottom."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        order = np.argsort(-x, axis=0, kind="stable")
        n = len(x)
        self.sorted = np.take_along_axis(x, order, axis=0)
        self.place = np.empty_like(order)
        np.put_along_axis(self.place, order, np.arange(n)[:, None], axis=0)

    def top(self, queries: np.ndarray, own: np.ndarray, k: int):
        """For each query its best k candidates other than itself: yields (query index, ids, scores)."""
        n = len(self.x)
        plus, minus = np.maximum(queries, 0.0), np.minimum(queries, 0.0)
        open_ = np.arange(len(queries))
        for depth in DEPTHS:
            t = min(n, max(k + 1, int(np.ceil(depth * n))))
            from_top, from_end = self.place < t, self.place >= n - t
            p, m = plus[open_], minus[open_]
            seen = (self.x * from_top) @ p.T + (self.x * from_end) @ m.T
            # What each unseen list gave last, and what it can give at worst.
            last = (~from_top * self.sorted[t - 1]) @ p.T + (~from_end * self.sorted[n - t]) @ m.T
            worst = (~from_top * self.sorted[-1]) @ p.T + (~from_end * self.sorted[0]) @ m.T
            lower, upper = seen + worst, seen + last
            mine = self.ids[:, None] == own[open_][None, :]
            lower[mine] = upper[mine] = -np.inf
            wanted = min(k, n)
            kth = -np.partition(-lower, wanted - 1, axis=0)[wanted - 1]
            may = upper >= kth
            may &= np.isfinite(upper)
            # Closed when those that may still belong are few, or everything has been read.
            count = may.sum(0)
            closed = np.flatnonzero((count <= 8 * k) | (t == n))
            for j in closed.tolist():
                q = open_[j]
                at = np.flatnonzero(may[:, j])
                score = self.x[at] @ queries[q]
                best = np.lexsort((self.ids[at], -score))[:k]
                yield int(q), self.ids[at][best], score[best]
            open_ = np.delete(open_, closed)
            if not len(open_):
                return


def _exact(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int):
    """As :meth:`Lists.top`, from longs: in longs where sums fit, else in Python's integers."""
    size = _largest(x) * x.shape[1]
    for j, (q, most) in enumerate(zip(queries, _largest(queries), strict=True)):
        big, at = size * most >= LONG, np.flatnonzero(ids != own[j])
        score = x @ q
        if big.any():
            score = score.astype(object)
            score[big] = x[big].astype(object) @ q.astype(object)
            best = np.array(heapq.nsmallest(k, at.tolist(), lambda i: (-score[i], ids[i])), dtype=np.int64)
            if any(not -(1 << 63) <= score[i] < 1 << 63 for i in best):
                raise ValueError(f"a score of query {own[j]} is too large for a long")
        else:
            best = at[np.lexsort((ids[at], -score[at]))[:k]]
        yield j, ids[best], score[best].astype(np.int64)


def _pack(batch: pa.RecordBatch):
    ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, flat.reshape(len(ids), -1) if len(ids) else flat.reshape(0, 0)


def _name(ids: np.ndarray, x: np.ndarray) -> int:
    """A block's name, from all it holds: one id can be in several blocks."""
    return int.from_bytes(hashlib.blake2b(ids.tobytes() + x.tobytes(), digest_size=8).digest(), "little", signed=True)


def _chunks(size: int, name: str):
    """Rows packed into blocks of at most ``size`` rows of one dimension: (block name, dims, ids, vectors)."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            dims = batch.column("dims").to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                ids, x = _pack(batch.filter(pa.array(dims == d)))
                held.setdefault(d, []).append((ids, x))
                while sum(len(i) for i, _ in held[d]) >= size:
                    ids, x = np.concatenate([i for i, _ in held[d]]), np.concatenate([v for _, v in held[d]])
                    yield out(d, ids[:size], x[:size])
                    held[d] = [(ids[size:], x[size:])]
        for d, rest in held.items():
            ids, x = np.concatenate([i for i, _ in rest]), np.concatenate([v for _, v in rest])
            if len(ids):
                yield out(d, ids, x)

    def out(d, ids, x):
        return pa.RecordBatch.from_arrays([pa.array([_name(ids, x)], pa.int64()), pa.array([d], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.astype("<i8").tobytes()], pa.binary())], [name, "dims", f"{name}_ids", f"{name}_x"])

    return run


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]):
        key, lists = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if key != (row["block"], row["block_ids"][:64]):
                    key = (row["block"], row["block_ids"][:64])
                    ids = np.frombuffer(row["block_ids"], np.int64)
                    x = np.frombuffer(row["block_x"], np.int64).reshape(len(ids), row["dims"])
                    lists, most = Lists(ids, x.astype(np.float64)), _largest(x).max()
                own = np.frombuffer(row["queries_ids"], np.int64)
                q = np.frombuffer(row["queries_x"], np.int64).reshape(len(own), row["dims"])
                fast = _largest(q) * most * row["dims"] <= DOUBLE
                found = [(own[fast][i], a, s.astype(np.int64)) for i, a, s in lists.top(q[fast].astype(np.float64), own[fast], k)]
                found += [(own[~fast][i], a, s) for i, a, s in _exact(ids, x, q[~fast], own[~fast], k)]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found])), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], ["query_id", "vec_id", "score"]
                    )

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k largest integer inner products of each query with other ids.

    Both inputs are rows (id long, v array<long>); null ids and null vectors take no part, a candidate with the
    query's own id is left out, and only vectors of the same length meet. Ties go to the smaller id; rows equal
    in id and vector count once, and an id with several vectors takes part with each: the best k of all its vectors
    are ranked together. A best score that no long holds raises. A query with fewer candidates gets all; empty tables give an empty result.
    """
    spark = vectors.sparkSession
    whole = F.col("id").isNotNull() & F.col("v").isNotNull()

    def packed(df, size, name):
        rows = df.where(whole).select("id", "v").dropDuplicates(["id", "v"]).select("id", "v", F.size("v").alias("dims")).where("dims > 0")
        return scratch.table(rows.mapInArrow(_chunks(size, name), f"{name} long, dims int, {name}_ids binary, {name}_x binary"), f"topk-{name}")

    blocks, asked = packed(vectors, BLOCK, "block"), packed(queries, QUERY_BLOCK, "queries")
    # The stated query set meets all rows, block by block: each block of queries goes to each block of candidates.
    # Names of blocks are paired first; the vectors then join by block, evenly.
    spread = [F.lit(i) for i in range(16)]
    names = blocks.select("block", "dims", F.pmod(F.xxhash64("block"), F.lit(16)).cast("int").alias("salt"))
    sought = asked.select("queries", "dims", F.explode(F.array(*spread)).alias("salt"))
    pairs = names.join(sought, ["dims", "salt"]).repartition(scratch.partitions(spark), "block", "queries")
    pairs = pairs.select("block", "queries").join(asked, "queries").join(blocks.drop("dims"), "block").sortWithinPartitions("block")
    found = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
