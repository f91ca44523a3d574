"""What the passes of the suffix dedup tell one another stays small where texts are copies or share very common passages."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from sparkveil.llm import suffix_dedup


def _chunk(texts, monkeypatch):
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    (chunk,) = suffix_dedup._chunks("doc_id", "text")([batch])
    return chunk.to_pylist()[0] | {"copies": None}


def test_copies_have_no_runs_and_strings_of_common_grams_travel_as_hashes(monkeypatch):
    from sparkveil.llm.textkit import Powers

    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    texts = [" ".join(word() for _ in range(60)) for _ in range(30)]
    texts.append(texts[4])
    row = _chunk(texts, monkeypatch)
    plain = suffix_dedup._Chunk(row, Powers(), 50, 1)
    assert plain.copy.tolist() == [False] * 30 + [True] and 30 not in plain.row and 4 in plain.row
    plain.select(np.ones(len(plain.least_at), bool))
    least, pairs = len(plain.least_at), len(plain.pair_at)
    row["repeats"] = [{"bucket": 0, "told": np.packbits(np.ones(least, bool)).tobytes()}]
    row["contexts"] = [{"bucket": 0, "told": bytes([suffix_dedup.RAGGED | suffix_dedup.MANY]) * pairs}]
    (batch,) = suffix_dedup._tell_strings(50, 1)([pa.RecordBatch.from_pylist([row])])
    strings = {t[p : p + 50] for t in texts for p in range(len(t) - 49)}
    assert batch.nbytes < 16 * len(strings)
    assert len(batch.column("hashes")[0].as_py()) == 8 * len(strings)


def test_memory_of_strings_that_meet_follows_a_range_not_the_bucket(monkeypatch):
    import tracemalloc

    from sparkveil.llm.textkit import Powers

    rnd = random.Random(5)
    texts = ["".join(rnd.choices("abcdefghij ", k=3000)) for _ in range(350)]
    texts += [t[:700] + "".join(rnd.choices("klm ", k=30)) + t[730:1500] for t in texts]
    row = _chunk(texts, monkeypatch)
    c = suffix_dedup._Chunk(row, Powers(), 50, 1)
    c.select(np.ones(len(c.least_at), bool))
    row["repeats"] = [{"bucket": 0, "told": np.packbits(np.ones(len(c.least_at), bool)).tobytes()}]
    row["contexts"] = [{"bucket": 0, "told": bytes([suffix_dedup.RAGGED]) * len(c.pair_at)}]
    (batch,) = suffix_dedup._tell_strings(50, 1)([pa.RecordBatch.from_pylist([row])])
    # The same strings, told by another chunk for larger ids: all of them repeat.
    ids = (np.frombuffer(batch.column("docs")[0].as_py(), np.int64) + 10_000).tobytes()
    later = pa.RecordBatch.from_pylist([batch.to_pylist()[0] | {"chunk": 7, "docs": ids}], batch.schema)
    tracemalloc.start()
    try:
        (told,) = suffix_dedup._meet_strings(50)((pa.scalar(0),), iter([batch, later]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    by = {x["chunk"]: np.frombuffer(x["least"], np.int64) for x in told.to_pylist()}
    strings = sum(int(n) for n in c.b[c.pair_at] - c.a[c.pair_at] + 1)
    assert len(by[7]) == strings and by[7].max() < 10_000
    sent = 2 * len(batch.column("text")[0].as_py())
    print(sent, peak)
    assert sent > 8 << 20 and peak < 32 * sent
