"""Total orders over whole tables without a single task: rows are dealt by range, and each range starts where the ones
before it end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonoscope.sources.store import stored


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """`rows` with running sums, by name, over a total order. Only one row a range meets the others'."""
    dealt = stored(rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    totals = dealt.groupBy("range_").agg(*[F.sum(v).alias(f"{n}_") for n, v in sums.items()])
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("range_", *[F.coalesce(F.sum(f"{n}_").over(before), F.lit(0)).alias(f"{n}_") for n in sums])
    inside = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.select("*", *[F.sum(v).over(inside).alias(n) for n, v in sums.items()])
    # as many rows as ranges
    return summed.join(F.broadcast(starts), "range_").select(*rows.columns, *[(F.col(n) + F.col(f"{n}_")).alias(n) for n in sums])


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """`rows` with their place from 1 on in a total order."""
    return running(rows, order, {name: F.lit(1).cast("long")})
