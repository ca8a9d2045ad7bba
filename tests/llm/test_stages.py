"""Pipeline stages on nulls, repeated rows, ties, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clonoscope.llm import jaccard, line_dedup, mixing, packing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SAME = "one two three four five six seven\neight nine ten\neleven twelve\nthirteen"
ROWS = [(1, SAME, "en", "s", 60), (1, SAME, "en", "s", 60), (2, SAME, "en", "s", 60), (None, "no id", "de", "s", 5), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "word " * 20_000, "en", "hot", 100_000)]
#: Names that operators use themselves.
CLASHING = ("row", "k", "kept", "n", "c", "d", "t", "i", "u", "th", "x", "rate", "__k", "__n", "__th", "lines", "starts", "n_lines", "n_removed", "times", "bin", "label")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("stage", [toxicity.stage, line_dedup.stage, jaccard.stage, mixing.stage])
def test_stages_keep_their_columns(spark, tables, stage):
    docs = spark.createDataFrame(ROWS, SCHEMA).select("*", *[F.lit(7).alias(c) for c in CLASHING])
    after = stage(spark, docs, tables)
    assert after.columns == docs.columns
    rows = after.collect()
    assert {r[c] for r in rows for c in CLASHING} <= {7}
    assert stage(spark, docs.limit(0), tables).count() == 0


def test_what_stages_keep(spark, tables):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    cut = line_dedup.stage(spark, docs, tables).collect()
    assert len(cut) == len(ROWS) and [(r["text"], r["n_chars"]) for r in cut if r["doc_id"] == 2] == [("", 0)]
    assert sum(r["text"] == SAME for r in cut) == 2 and any(r["text"] is None for r in cut)
    kept = jaccard.stage(spark, docs, tables).collect()
    assert [r["doc_id"] for r in kept if r["text"] == SAME] == [1]
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "3", "4", "5", "None"]
    drawn = mixing.drawn(docs, mixing.mix(docs, spark.read.parquet(f"{tables}/labels.parquet")).withColumn("rate", F.lit(2.0)))
    assert drawn.count() == 2 * len(ROWS)
    packed = packing.stage(spark, docs, tables)
    assert packed.where("piece = 0").count() == len(ROWS) and packing.stage(spark, docs.limit(0), tables).count() == 0


def test_run(spark, tables):
    done = corpus_pipeline.run(spark, tables)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(done.columns) and done.count() > 0
