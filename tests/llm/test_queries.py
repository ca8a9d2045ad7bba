"""Registered queries against DuckDB, and the pipeline against its stages."""

import os

import duckdb
import pytest

import corpus_pipeline
from clonoscope.llm import queries, toxicity
from clonoscope.llm.common import table

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{TABLES}/{f}'")
    ours, theirs = queries.QUERIES[name](spark, TABLES), con.execute(queries.SQL[name])
    names = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    plain = lambda rows, cols: sorted(repr([r[i] for i in sorted(range(len(cols)), key=lambda i: cols[i])]) for r in rows)
    assert plain(ours.collect(), ours.columns) == plain(theirs.fetchall(), names)


def test_pipeline(spark):
    docs = table(spark, TABLES, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, TABLES)
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = after.cache()
        assert 0 < docs.count() <= 1.2 * before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, TABLES)
    assert packed.where("piece = 0").count() == docs.count()
    model = toxicity.train(table(spark, TABLES, "documents"), table(spark, TABLES, "labels"))
    kept = toxicity.accepted(table(spark, TABLES, "documents"), model)
    scores = toxicity.score(table(spark, TABLES, "documents"), model)
    assert kept.count() == scores.where(f"score < {toxicity.THRESHOLD}").count()
