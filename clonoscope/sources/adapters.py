"""Views of the star-schema tables as repertoires, so that every operator has tables to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_repertoire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as repertoires: a row per word of 3 to 30 letters."""
    return _words(table(spark, sf_dir, "documents"))


def labelled_words(spark: SparkSession, sf_dir: str, meta: DataFrame) -> DataFrame:
    """Those of labelled documents, with label_positive: texts are joined, before they are rows of words."""
    return _words(table(spark, sf_dir, "documents").join(meta.withColumnRenamed("repertoire_id", "doc_id"), "doc_id"), "label_positive")


def _words(documents: DataFrame, *kept: str) -> DataFrame:
    docs = documents.select("doc_id", "lang", "source", *kept, F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("pos", "word"))
    return docs.where(F.length("word").between(3, 30)).select(
        F.col("doc_id").alias("repertoire_id"), (F.col("pos") + 1).cast("long").alias("row_idx"), F.upper("word").alias("junction_aa"), F.col("lang").alias("v_call"), F.col("source").alias("j_call"), *kept
    )


def word_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("repertoire_id"), (F.col("quality") == 1).alias("label_positive"))


def reference_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_words(table(spark, sf_dir, "benchmark"))


def benchmark_words(benchmark: DataFrame) -> DataFrame:
    words = benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    return words.where(F.length("w") >= 3).select(F.upper("w").alias("junction_aa")).distinct()


def clone_repertoire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as weighted clonotypes of suppliers."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").cast("long").alias("repertoire_id"),
        F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("junction_aa"),
        F.col("p_brand").alias("v_call"),
        F.col("p_type").alias("j_call"),
        F.col("l_returnflag").alias("d_call"),
        F.col("l_quantity").cast("long").alias("templates"),
        "l_orderkey",
        "l_linenumber",
    )


def clone_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("repertoire_id"), (F.col("s_nationkey") % 2 == 0).alias("label_positive"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as nodes; the label is the repertoire."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("repertoire_id"), F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("x"))


#: The same views in DuckDB SQL, as common table expressions.
WORDS_SQL = """rep AS (SELECT doc_id AS repertoire_id, i AS row_idx, upper(ws[i]) AS junction_aa, lang AS v_call, source AS j_call
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, lang, source, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM documents))
  WHERE length(ws[i]) BETWEEN 3 AND 30),
meta AS (SELECT doc_id AS repertoire_id, quality = 1 AS label_positive FROM labels),
refset AS (SELECT DISTINCT upper(w) AS junction_aa FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark) WHERE length(w) >= 3)"""
CLONES_SQL = """rep AS (SELECT l_suppkey::BIGINT AS repertoire_id, upper(replace(p_name, ' ', '')) AS junction_aa, p_brand AS v_call, p_type AS j_call, l_returnflag AS d_call,
  l_quantity::BIGINT AS templates, l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey),
meta AS (SELECT s_suppkey::BIGINT AS repertoire_id, s_nationkey % 2 = 0 AS label_positive FROM supplier)"""
NODES_SQL = "nodes AS (SELECT label::BIGINT AS repertoire_id, vec_id AS node_id, embedding::DOUBLE[] AS x FROM embeddings)"
