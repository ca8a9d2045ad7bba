"""Witness counts that grow with a stream of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clonoscope.operators.counts import row_counts


def incremental_counts(stream: DataFrame) -> DataFrame:
    """Rows by label for each sequence, kept up to date as rows arrive; read with update or complete output."""
    return row_counts(stream, "junction_aa")


def windowed_counts(stream: DataFrame, time: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """The same for each time window; rows later than `late` are dropped, so that state stays bounded."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), "junction_aa").agg(F.count_if("label_positive").alias("pos_count"), F.count_if(~F.col("label_positive")).alias("neg_count"))


def start(counts: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Run until the input's end, into a table in memory."""
    return counts.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
