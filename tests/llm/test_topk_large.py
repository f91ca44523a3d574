"""Top-k over vectors whose sums double precision does not hold, against Python's integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkveil.llm import queries, topk


def embeddings(spark, rows, at):
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{at}/embeddings.parquet")
    return str(at)


def test_large_finite_vectors_take_part(spark, tmp_path):
    rnd = np.random.default_rng(3)
    vec = [(i, [float(x) for x in rnd.normal(0, 10.0 ** (i % 7), 6)]) for i in range(200)]
    vec += [(301 + i, [float(2**32 * s + i), 1.0, 0.0, 0.0, 0.0, 0.0]) for i, s in enumerate((1, 1, -1, 1))] + [(400, [16384.0] * 6), (401, [-(2.0**33)] * 6)]
    big = {i: [math.floor(x * 256) for x in e] for i, e in vec}
    want = set()
    for q in (i for i in big if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(big[q], big[i], strict=True)), i) for i in big if i != q)[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    got = {tuple(r) for r in queries.op7_top_k(spark, embeddings(spark, vec, tmp_path)).collect()}
    assert got == want and any(q == 400 for q, *_ in got) and any(i == 401 or i >= 300 for _, _, i, _ in got)


def test_sums_over_a_long_are_exact_or_raise():
    ids, x = np.arange(3), np.array([[2**62, -(2**62), 1], [2**62, -(2**62), 2], [5, 5, 5]])
    got = list(topk._exact(ids, x, np.array([[4, 4, 1]]), np.array([9]), 2))
    assert [(i.tolist(), s.tolist()) for _, i, s in got] == [([2, 1], [45, 2])]
    with pytest.raises(ValueError):
        list(topk._exact(ids, x, np.array([[4, 0, 0]]), np.array([9]), 1))


def test_a_component_over_a_long_raises(spark, tmp_path):
    with pytest.raises(Exception, match="too large for a long"):
        queries.op7_top_k(spark, embeddings(spark, [(0, [1.0]), (1, [1e300])], tmp_path)).collect()


def test_an_id_with_several_vectors_takes_part_with_each(spark, tmp_path):
    vec = [(i, [float(i % 7), float(i % 5)]) for i in range(1, 40)] + [(0, [1.0, -1.0]), (0, [-1.0, 1.0]), (0, [-1.0, 1.0]), (0, [1.0]), (41, [1.0]), (41, [9.0, -9.0]), (41, [-9.0, 9.0])]
    rows = sorted({(i, tuple(int(x * 256) for x in e)) for i, e in vec})
    best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for o, q in rows if o == 0 for i, v in rows if i != 0 and len(v) == len(q))[:5]
    got = queries.op7_top_k(spark, embeddings(spark, vec, tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(0, r + 1, i, -s) for r, (s, i) in enumerate(best)]
