"""The corpus pipeline: toxic documents go, repeated lines go, near duplicates go, sources are mixed, texts packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clonoscope.llm import jaccard, line_dedup, mixing, packing, toxicity
from clonoscope.llm.common import cut, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("line dedup", line_dedup.stage),
    ("n-gram Jaccard join", jaccard.stage),
    ("mixing", mixing.stage),
    ("best-fit packing", packing.stage),
]

#: The toxicity and mixing stages are learnt, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
