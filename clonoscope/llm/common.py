"""What the text operators share: tables, the shared folder, lineage cuts."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a row group of written(), which a task holds in memory.
ROW_GROUP = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """The shared folder: what the cluster names in spark.checkpoint.dir. Only a local session without that setting
    (tests) gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="clonoscope-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and return the stored rows, with no lineage."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As cut(), but as Parquet, which takes less room where rows are many and narrow. The files stay."""
    path = f"{_folder(df.sparkSession).rstrip('/')}/{uuid.uuid4()}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.parquet(path)


def settle(spark: SparkSession) -> None:
    """Let the driver collect its garbage. Spark drops the shuffle files and broadcasts of finished steps when their
    handles are collected, which a driver with room to spare may put off for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_crc(column: Column) -> Column:
    """crc32 of a column's text; null where it is null."""
    return F.crc32(column.cast("string").cast("binary"))


def packed(docs: DataFrame) -> Column:
    """All columns of `docs` as one, so that an operator's own columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def with_text(docs: DataFrame, *names: str) -> DataFrame:
    """`docs` with just the named columns, so that others cannot clash with an operator's own."""
    return docs.select(*[F.col(f"`{n}`") for n in names])
