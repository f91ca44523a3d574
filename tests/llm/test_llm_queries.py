"""Registered queries and the pipeline over the smallest tables."""

import pytest

import corpus_pipeline
from sparkveil.llm import oracles, queries

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    assert [int(n[2:].split("_")[0]) for n in sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 11))


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op5_mix_sources", "op6_ngram_join", "op7_top_k", "op10_url_filter"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF).toPandas()
    want = con.execute(oracles.oracle_sql()[name]).df()
    rows = lambda df: sorted(tuple("" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_language_id_on_held_out_rows(spark):
    got = queries.op4_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.9 * got.count()


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "mix_sources", "sentencepiece"]
    counts = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        done = spark.read.parquet(str(tmp_path / str(i)))
        assert i == 4 or done.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        counts.append(done.count())
        if i < 4:
            docs = done
    assert counts[1] >= 0.95 * counts[0] and counts[2] == spark.read.parquet(str(tmp_path / "0")).select("text").distinct().count() and counts[3] < counts[2] and counts[5] >= counts[4]
    assert spark.read.parquet(str(tmp_path / "3")).select("doc_id").distinct().count() <= counts[3]
