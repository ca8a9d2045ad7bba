"""Stored similarity graphs: built once for a repertoire's content, k and embedder, found in any of several folders."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoscope.sources import files, store

#: Part of every key: raise it when stored graphs change their meaning.
VERSION = 1

_ENTRY = "repertoire_id string, content_key string, batch string, n_nodes long, n_edges long"


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    """A folder's committed entries; none where nothing has been committed."""
    if not store.exists(spark, f"{folder}/manifest/first"):
        return spark.createDataFrame([], _ENTRY)
    return spark.read.option("recursiveFileLookup", True).schema(_ENTRY).parquet(f"{folder}/manifest")


def _read(spark: SparkSession, batches: list[str], part: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [spark.read.parquet(f"{b}/{part}").withColumn("batch", F.lit(b)) for b in batches])


def _held(parts: list[DataFrame], ids: DataFrame) -> list[DataFrame]:
    """The rows of the repertoires and batches in `ids`."""
    keys = ids.select(F.col("repertoire_id").alias("i"), F.col("batch").alias("b"))
    return [p.join(keys, (F.col("repertoire_id") == F.col("i")) & (F.col("batch") == F.col("b")), "left_semi") for p in parts]


def found(spark: SparkSession, folders: list[str], keys: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(repertoire_id, batch) of the keys (repertoire_id, content_key) whose graphs stand in the first folder that has them
    whole, with the stored nodes and edges. An entry whose tables have other numbers of rows than it says is as none."""
    places = [(i, f) for i, f in enumerate(folders)]
    entries = reduce(lambda a, b: a.unionByName(b), [_entries(spark, f).withColumn("place", F.lit(i)) for i, f in places])
    asked = keys.select(F.col("repertoire_id").cast("string").alias("i"), F.col("content_key").alias("key"))
    matching = store.stored(entries.join(asked, (F.col("repertoire_id") == F.col("i")) & (F.col("content_key") == F.col("key"))).select(*entries.columns))
    batches = [r["batch"] for r in matching.select("batch").distinct().collect()]  # one for each run that built graphs
    if not batches:
        return matching.select("repertoire_id", "batch"), []
    parts = [_read(spark, batches, part).withColumn("repertoire_id", F.col("repertoire_id").cast("string")) for part in ("nodes", "edges")]
    whole = matching
    for part, n in zip(parts, ("n_nodes", "n_edges"), strict=True):
        counts = part.groupBy(F.col("repertoire_id").alias("i"), F.col("batch").alias("b")).agg(F.count("*").alias("have"))
        whole = whole.join(counts, (F.col("repertoire_id") == F.col("i")) & (F.col("batch") == F.col("b")), "left").where(F.coalesce("have", F.lit(0)) == F.col(n)).drop("i", "b", "have")
    first = whole.groupBy("repertoire_id").agg(F.min_by("batch", F.struct("place", "batch")).alias("batch"))
    return store.stored(first), parts


def graphs(rep: DataFrame, folders: list[str], build: Callable[[DataFrame], tuple[DataFrame, DataFrame]], *about: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all repertoires, those that no folder has built by `build` and added to the first folder.

    A key is the repertoire's content, VERSION and `about` (k and the embedder's name), so that a changed repertoire is
    built anew and alone. A run writes its nodes and edges first and then one manifest of its entries: until that stands
    nothing of it is found, so that a run that fails leaves no broken graph."""
    spark, kind = rep.sparkSession, dict(rep.dtypes)["repertoire_id"]
    keys = store.stored(files.content_key(rep, f"version {VERSION}", *about))
    have, _ = found(spark, folders, keys)
    todo = store.stored(keys.select(F.col("repertoire_id").cast("string").alias("repertoire_id"), "content_key").join(have.select("repertoire_id"), "repertoire_id", "left_anti"))
    if not todo.isEmpty():
        batch = f"{folders[0]}/batch_{uuid.uuid4()}"
        some = rep.join(todo.select(F.col("repertoire_id").alias("t")), F.col("repertoire_id").cast("string") == F.col("t"), "left_semi")
        entries = todo.withColumn("batch", F.lit(batch))
        for part, rows in zip(("nodes", "edges"), build(some), strict=True):
            rows.write.parquet(f"{batch}/{part}")
            counts = spark.read.parquet(f"{batch}/{part}").groupBy(F.col("repertoire_id").cast("string").alias("i")).agg(F.count("*").alias("n"))
            entries = entries.join(counts, F.col("repertoire_id") == F.col("i"), "left").withColumn(f"n_{part}", F.coalesce("n", F.lit(0)).cast("long")).drop("i", "n")
        manifest = "first" if not store.exists(spark, f"{folders[0]}/manifest/first") else str(uuid.uuid4())
        entries.select(*[c.split()[0] for c in _ENTRY.split(", ")]).write.parquet(f"{folders[0]}/manifest/{manifest}")
    whole, parts = found(spark, folders, keys)
    if not parts:
        return build(rep.limit(0))
    nodes, edges = (p.drop("batch").withColumn("repertoire_id", F.col("repertoire_id").cast(kind)) for p in _held(parts, whole))
    return nodes, edges
