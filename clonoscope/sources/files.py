"""Repertoire files in and result files out."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPERTOIRE = T.StructType([T.StructField(n, T.StringType()) for n in ("junction_aa", "v_call", "j_call", "d_call", "templates")])
METADATA = T.StructType([T.StructField("repertoire_id", T.StringType()), T.StructField("filename", T.StringType()), T.StructField("label_positive", T.StringType())])


def _headers(spark: SparkSession, folders: tuple[str, ...]) -> dict[str, list[str]]:
    """The files of each header line. Only the first line of each file is looked at."""
    text = spark.read.option("pathGlobFilter", "*.tsv").option("ignoreMissingFiles", True).text(list(folders))
    lines = text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at")).where("at = 0")
    heads = lines.where(F.col("value").rlike(r"(^|\t)(junction_aa|cdr3_aa)(\t|$)")).groupBy("path").agg(F.first("value").alias("head"))
    return {r["head"]: sorted(r["paths"]) for r in heads.groupBy("head").agg(F.collect_list("path").alias("paths")).collect()}


def read_repertoires(spark: SparkSession, *folders: str) -> DataFrame:
    """All tab-separated files below the folders as one table. Columns are matched by name whatever their order; those
    that a file lacks are null, as are the texts 'nan' and ''. The id is the file's stem, the dataset its folder, and
    row_idx the row's place in its file's split. Files without a header that names sequences are left out."""
    parts = []
    for head, paths in sorted(_headers(spark, folders).items()):
        names = [n.strip() for n in head.split("\t")]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        rows = spark.read.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", True).option("nullValue", "nan").csv(paths)
        have = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in REPERTOIRE.fieldNames() if c != "templates"]
        templates = F.expr("try_cast(templates AS BIGINT)") if "templates" in names else F.lit(None).cast("long")
        file, path = F.col("_metadata.file_name"), F.col("_metadata.file_path")
        parts.append(rows.select(F.regexp_extract(file, r"(.*)\.tsv$", 1).alias("repertoire_id"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("dataset"), F.monotonically_increasing_id().alias("row_idx"), *have, templates.alias("templates")))
    if not parts:
        return spark.createDataFrame([], "repertoire_id string, dataset string, row_idx long, junction_aa string, v_call string, j_call string, d_call string, templates long")
    return reduce(DataFrame.unionByName, parts)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Labels by repertoire; text other than true or false becomes null."""
    rows = spark.read.schema(METADATA).option("header", True).csv(path)
    return rows.withColumn("label_positive", F.expr("try_cast(label_positive AS BOOLEAN)"))


def read_reference(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """Distinct positive sequences of one antigen from a tab-separated reference."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    return rows.where((F.col("sample") == sample) & F.col("is_positive").cast("boolean") & F.col("cdr3_aa").isNotNull()).select(F.col("cdr3_aa").alias("junction_aa")).distinct()


def with_policy(meta: DataFrame, rep: DataFrame, missing: str = "empty") -> DataFrame:
    """Rows of labelled repertoires, by what is done about one without rows (a missing file): `empty` keeps a row of
    nulls, `skip` leaves it out, `flag` keeps it with missing true, so that a caller can warn."""
    if missing == "skip":
        return meta.join(rep, "repertoire_id")
    if missing not in ("empty", "flag"):
        raise ValueError(f"unknown policy: {missing}")
    known = rep.withColumn("found", F.lit(True))
    rows = meta.join(known, "repertoire_id", "left")
    return rows.withColumn("missing", F.col("found").isNull()).drop("found") if missing == "flag" else rows.drop("found")


def labelled_or_empty(meta: DataFrame, rep: DataFrame) -> DataFrame:
    """Rows of labelled repertoires; one without rows (a missing file) keeps a row of nulls."""
    return meta.join(rep, "repertoire_id", "left")


def dataset_number(name: str) -> int | None:
    """The number at the end of a dataset folder's name such as train_dataset_7 or test_dataset_7_2."""
    parts = [p for p in name.rstrip("/").split("/")[-1].split("_") if p.isdigit()]
    return int(parts[0]) if parts else None


def pairs_of(trains: list[str], tests: list[str]) -> dict[str, list[str]]:
    """Test folders of each training folder, by dataset number."""
    return {t: sorted(x for x in tests if dataset_number(x) == dataset_number(t)) for t in sorted(trains)}


def write_result(result: DataFrame, path: str) -> None:
    """The result table as CSV with a header."""
    result.write.mode("overwrite").option("header", True).csv(path)


def write_parts(rep: DataFrame, path: str) -> None:
    """A cache of repertoires, one folder for each, as Parquet."""
    rep.write.mode("overwrite").partitionBy("repertoire_id").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def manifest(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per repertoire: templates and distinct sequences before and after downsampling, and the reduction in percent."""
    of = lambda df, n: df.groupBy("repertoire_id").agg(F.sum("templates").alias(f"{n}_templates"), F.count_distinct("junction_aa").alias(f"{n}_unique"))
    both = of(before, "original").join(of(after, "downsampled"), "repertoire_id")
    return both.withColumn("reduction_pct", 100 * (1 - F.col("downsampled_templates") / F.nullif(F.col("original_templates"), F.lit(0))))


def content_key(rep: DataFrame, *about: str) -> DataFrame:
    """A cache key of each repertoire's content: the MD5 of its sorted (sequence, genes), nulls told apart from empty
    texts, and of what else the cached table depends on, such as k and the embedder's name. Each row is hashed first,
    so that what one task gathers is a hash a row."""
    plain = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    rows = F.array_sort(F.collect_list(F.md5(F.concat_ws("\t", *map(plain, ("junction_aa", "v_call", "j_call"))).cast("binary"))))
    return rep.groupBy("repertoire_id").agg(F.md5(F.concat_ws("|", F.array_join(rows, ""), *map(F.lit, about)).cast("binary")).alias("content_key"))


def verified(cached: DataFrame, rep: DataFrame) -> DataFrame:
    """Per repertoire whether a cached table of sequences has the same set of them as `rep`."""
    of = lambda df, n: df.select("repertoire_id", "junction_aa").distinct().withColumn(n, F.lit(True))
    both = of(cached, "a").join(of(rep, "b"), ["repertoire_id", "junction_aa"], "full")
    return both.groupBy("repertoire_id").agg(F.every(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("same"))


def read_result(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of these result files or folders that exists: a result under its name or its fallback name."""
    for path in paths:
        try:
            return spark.read.option("header", True).csv(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError(f"none of {', '.join(paths)}")


def result_manifest(result: DataFrame) -> DataFrame:
    """Per dataset: its rows, those with a probability and those with a ranked sequence."""
    applies = F.col("label_positive_probability").cast("double") != -999.0
    return result.groupBy("dataset").agg(F.count("*").alias("n"), F.count_if(applies).alias("n_probabilities"), F.count_if(F.col("junction_aa") != "-999.0").alias("n_sequences"))
