"""The pipeline's stages and the operator queries."""

import collections

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from rulewright.llm import queries


def test_stages_keep_columns_and_take_effect(corpus, spark, sf_dir):
    docs = corpus
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, sf_dir))
        if name != "sentencepiece":
            assert out.columns == corpus.columns
            docs = out
        counts.append(out.count())
    assert counts[2] == counts[1] and counts[3] < counts[2] and counts[5] == counts[4]
    assert collections.Counter(r.doc_id for r in out.collect()) == collections.Counter(r.doc_id for r in docs.collect())


def test_stages_on_an_empty_table(empty, spark, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)


def test_queries_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_against_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))
