"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (two to four bytes of case-folded UTF-8, hashed to
a fixed number of cells) present in both, over the geometric mean of the numbers present in each: the blended
spectrum in its presence form. A bounded sample of labelled texts trains one ridge regression per language,
one against the rest, in the Nystroem space of a few landmark texts. Scores of new texts are one product of
their presence matrix with the cells' weights, batch by batch: kernel values with the landmarks are linear in
presence, so landmarks and regression fold into one matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .textkit import blocks

ORDERS = (2, 3, 4)
CELL_BITS = 14
#: Labelled texts used for each language, at most; landmarks for each language, at most.
TRAIN_PER_LANGUAGE = 400
LANDMARKS_PER_LANGUAGE = 32
RIDGE = 0.1
SHARPNESS = 6.0


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # cells x languages
    bias: np.ndarray


def _presence(offsets: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Rows x cells of 0 and 1: n-grams present. Bytes that are not letters count as blanks."""
    fold = np.full(256, 0x20, np.uint32)
    fold[97:123] = np.arange(97, 123)
    fold[65:91] = np.arange(97, 123)
    fold[128:] = np.arange(128, 256)
    n, cells = len(offsets) - 1, 1 << CELL_BITS
    out = np.zeros((n + 1) * cells, np.uint8)
    text = fold[block]
    row = np.repeat(np.arange(n, dtype=np.int64) * cells, np.diff(offsets))
    gram = text.copy()
    for order in range(2, max(ORDERS) + 1):
        if len(text) < order:
            break
        gram = (gram[: len(text) - order + 1] << np.uint32(8)) ^ text[order - 1 :] if order < 5 else gram
        if order in ORDERS:
            code = ((gram * np.uint32(0x9E3779B1) + np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - CELL_BITS)
            at = row[: len(code)] + code
            at[row[: len(code)] != row[order - 1 :]] = n * cells
            out[at] = 1
    return out.reshape(n + 1, cells)[:n]


def _has_letter(offsets: np.ndarray, block: np.ndarray) -> np.ndarray:
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    seen = np.concatenate(([0], np.cumsum(ascii_letter[block])))
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for r in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])).tolist():
        out[r] = any(map(str.isalpha, block[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace")))
    return out


def _features(text_col: str):
    def run(batches):
        for batch in batches:
            for first, offsets, block in blocks(batch, text_col, 64):
                bits = np.packbits(_presence(offsets, block), axis=1)
                ok = pa.array(_has_letter(offsets, block))
                part = pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(offsets) - 1), batch.column(1).slice(first, len(offsets) - 1), pa.array([x.tobytes() for x in bits], pa.binary())], ["lang", "place", "bits"])
                yield part.filter(ok)

    return run


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = TRAIN_PER_LANGUAGE, landmarks: int = LANDMARKS_PER_LANGUAGE) -> Model:
    """Train on at most ``per_language`` texts of each label, those whose hash of id is least among about twice as many.

    Rows with null text or null label, and texts without a letter, are not learned from. Without any row to learn
    from the model knows no language and predicts ``und``.
    """
    scratch.bounded_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return Model((), np.zeros((1 << CELL_BITS, 0), np.float32), np.zeros(0, np.float32))
    place = F.pmod(F.xxhash64(F.lit("lang-sample"), id_col), F.lit(1 << 40))
    limit = F.lit(0)
    for lang, n in counts.items():
        limit = F.when(F.col(lang_col) == lang, F.lit(int(min(1.0, (2 * per_language + 40) / n) * (1 << 40)))).otherwise(limit)
    sample = rows.where(place < limit).select(F.col(lang_col).alias("lang"), place.alias("place"), F.col(text_col).alias("text"))
    got = sorted(sample.mapInArrow(_features("text"), "lang string, place long, bits binary").collect())
    languages = sorted({r[0] for r in got})
    kept, marks = [], []
    for lang in languages:
        own = [r for r in got if r[0] == lang][:per_language]
        marks += range(len(kept), len(kept) + min(landmarks, len(own)))
        kept += own
    x = np.unpackbits(np.array([np.frombuffer(r[2], np.uint8) for r in kept]), axis=1).astype(np.float32)
    size = np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    marked = (x / size)[marks]
    kernel = (x / size) @ marked.T
    value, vector = np.linalg.eigh(kernel[marks].astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    z = kernel @ root
    mean = z.mean(0)
    y = np.where(np.array([r[0] for r in kept])[:, None] == np.array(languages), 1.0, -1.0)
    # Every language weighs the same, however many texts it has in the sample.
    weight = 1.0 / np.maximum((y > 0).sum(0), 1)[np.argmax(y, axis=1)]
    weight = weight / weight.sum() * len(kept)
    zc = (z - mean) * weight[:, None]
    target = (y * weight[:, None]).mean(0)
    beta = np.linalg.solve(zc.T @ (z - mean) + RIDGE * np.eye(z.shape[1]), zc.T @ (y - target))
    weights = marked.T.astype(np.float64) @ (root @ beta)
    return Model(tuple(languages), weights.astype(np.float32), (target - mean @ beta).astype(np.float32))


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its score, a softmax of the regressions, between 0 and 1.

    ``und`` with score 0 if the text is null, empty or has no letter, or the model knows no language. Every byte of
    a text counts, however long. Columns that already have these names are replaced. Equal texts get equal results; an empty table gives an empty result.
    """
    scratch.bounded_batches(docs.sparkSession)
    # Plain values: a broadcast is pickled by reference, and workers need not have this package.
    shipped = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.bias))

    @F.arrow_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def run(text: pa.Array) -> pa.Array:
        languages, weights, bias = shipped.value
        names = np.array([*languages, "und"], object)
        langs, scores = [np.zeros(0, object)], [np.zeros(0)]
        for _, offsets, block in blocks(pa.RecordBatch.from_arrays([text], ["text"]), "text", 64, 1 << 18):
            n = len(offsets) - 1
            best, score = np.full(n, len(languages)), np.zeros(n)
            ok = _has_letter(offsets, block)
            if languages and ok.any():
                x = _presence(offsets, block).astype(np.float32)
                f = (x @ weights) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) + bias
                e = np.exp(SHARPNESS * (f - f.max(1, keepdims=True)))
                best = np.where(ok, f.argmax(1), best)
                score = np.where(ok, (e / e.sum(1, keepdims=True)).max(1), 0.0)
            langs.append(names[best])
            scores.append(score)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(langs), pa.string()), pa.array(np.concatenate(scores))], ["lang", "score"])

    # Only the text leaves the JVM. The struct has a name that no column of the caller has.
    names = [c for c in docs.columns if c not in (lang_name, score_name)]
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    held = own.withColumn("found", run(F.col(f"c{docs.columns.index(text_col)}")))
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c in names]
    return held.select(*kept, F.col("found.lang").alias(lang_name), F.col("found.score").alias(score_name))


def held_out(doc_id: Column) -> Column:
    """True for a quarter of the ids: crc32 of the id as text leaves 2 modulo 4. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
