"""The corpus pipeline: language ID, exact and near duplicates, mixing, and SentencePiece encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.llm import exact_dedup, language_id, mixing, ngram_join, scratch, sentence_sampling

#: A document is rejected if its language is undetermined or its best language scores less.
LEAST_SCORE = 0.3


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter, or that no language claims, go."""
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])  # the prediction's names are then free, whatever the columns
    at = {c: f"c{names.index(c)}" for c in ("doc_id", "text", "lang")}
    model = language_id.fit(own, text_col=at["text"], lang_col=at["lang"], id_col=at["doc_id"])
    found = language_id.predict(own, model, text_col=at["text"], lang_name="_lang", score_name="_score")
    return found.where((F.col("_lang") != "und") & (F.col("_score") >= LEAST_SCORE)).select(own.columns).toDF(*names)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles the one with the smallest id."""
    return ngram_join.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document of the mix, as ids."""
    return sentence_sampling.encode(docs, sentence_sampling.default_model())


STAGES = [("language_id", identify), ("exact_dedup", exact), ("ngram_join", near), ("mix_sources", mix), ("sentencepiece", encode)]

#: SQL cannot express the first and last stages; of the stages, row counts and columns are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is a table in the shared folder that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
