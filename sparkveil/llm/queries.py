"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, importance, language_id, mixing, ngram_join, sentence_sampling, suffix_dedup, topk, url_filter


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentence_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of every whole text: their lengths, digests of their ids, whether decoding gives the text back, scores."""
    return sentence_sampling.encode(_read(spark, sf_dir, "documents"), sentence_sampling.default_model(), digest=True)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~held))
    return language_id.predict(docs.select("doc_id", "text", held.alias("held_out")), model, score_name="score").drop("text")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_read(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding"), strict=True).alias("v"))
    return topk.top_k(rows, rows.where("id % 50 = 0"), 5)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(_read(spark, sf_dir, "conversations"))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is text labelled of good quality and not toxic."""
    good = _read(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select(F.col("doc_id").alias("id"))
    return importance.resample(_read(spark, sf_dir, "documents"), good)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
