"""Tables that are stored once and read often: lineage cuts and caches by key."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stored(df: DataFrame) -> DataFrame:
    """The rows of `df`, written to the shared checkpoint folder. A local session that names none gets a temporary one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="clonoscope-checkpoint-"))
    return df.checkpoint(eager=True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a written table stands there, in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def cached(spark: SparkSession, folders: list[str], key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of this key from the first folder that has it, else made and written to the first folder. A key names
    all that the table depends on, such as content, k and embedder."""
    for folder in folders:
        if exists(spark, f"{folder}/{key}"):
            return spark.read.parquet(f"{folder}/{key}")
    make().write.mode("overwrite").parquet(f"{folders[0]}/{key}")
    return spark.read.parquet(f"{folders[0]}/{key}")


def added(spark: SparkSession, path: str, ids: DataFrame, make: Callable[[DataFrame], DataFrame], key: str = "repertoire_id") -> DataFrame:
    """The table at `path` with the rows of `ids` that it lacks made and appended, so that each repertoire is made once."""
    todo = ids.select(key).distinct()
    if exists(spark, path):
        todo = todo.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    todo = stored(todo)
    if not exists(spark, path) or not todo.isEmpty():
        make(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_about(spark: SparkSession, about: dict, path: str) -> None:
    """A small dictionary as one JSON text beside a table or model."""
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_about(spark: SparkSession, path: str) -> dict:
    """A JSON text as a dictionary: configurations, results and what write_about wrote."""
    rows = spark.read.option("wholetext", True).text(path).where(F.length("value") > 0).collect()
    return json.loads(rows[0]["value"])
