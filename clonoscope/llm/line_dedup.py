"""Line deduplication by overlapping three-line windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoscope.llm.common import packed, table

WINDOW = 3


def _hashes(lines: Column, i: Column) -> Column:
    """Two independent 64-bit hashes of the window that starts at the 0-based line `i`."""
    at = [F.get(lines, i + k) for k in range(WINDOW)]
    return F.struct(
        i.alias("pos"),
        F.xxhash64(*at).alias("h1"),
        F.xxhash64(F.lit("~"), *reversed(at)).alias("h2"),
        F.length(F.trim(F.concat(*at))).alias("inked"),
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove repeated runs of three or more lines; returns `docs` with a new text and counts.

    Every window of three consecutive lines is hashed to 128 bits. A window's first occurrence is the one with
    the smallest (id, text hash, position); the lines of all others are covered, covered positions merge, and
    covered lines go. Output: the input's columns, `text_col` rewritten, plus n_lines and n_removed (long).

    Defined cases: a null text stays null with zero counts; an empty text is one empty line; texts of fewer than
    three lines have no window and stay; windows of blank lines only never match; rows that agree in id and text
    are one document and are all treated alike; a null id sorts first; overlapping repeats inside one document
    count too. An input column named n_lines or n_removed is replaced.

    Scale: windows are narrow rows (id, two hashes, position). They are pre-aggregated before the shuffle by hash,
    so one frequent window costs a row per task; the join back is a plain equi-join whose large partitions AQE can
    split. Starts gather per document only, bounded by its own lines. The text is shuffled once.
    """
    doc, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    th = F.xxhash64(F.lit("th"), text)
    lines = docs.select(doc.alias("d"), th.alias("t"), F.split(text, "\n", -1).alias("lines"))
    starts = F.when(F.size("lines") >= WINDOW, F.sequence(F.lit(0), F.size("lines") - WINDOW))
    windows = (
        lines.select("d", "t", F.explode(F.transform(starts, lambda i: _hashes(F.col("lines"), i))).alias("w"))
        .where("w.inked > 0")
        .select("d", "t", F.col("w.pos").alias("pos"), F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"))
    )
    repeated = (
        windows.groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "pos")).alias("first"))
        .where("n > 1")
        .select("h1", "h2", "first")
    )
    later = (
        windows.join(repeated, ["h1", "h2"])
        .where(~F.struct("d", "t", "pos").eqNullSafe(F.col("first")))
        .groupBy("d", "t")
        .agg(F.array_sort(F.collect_set("pos")).alias("starts"))
    )
    n = F.size("lines")
    begins, ends = F.concat(F.col("starts"), F.array(n)), F.concat(F.array(F.lit(0)), F.transform("starts", lambda s: s + WINDOW))
    kept = F.flatten(F.zip_with(begins, ends, lambda b, e: F.when(b > e, F.slice("lines", e + 1, b - e)).otherwise(F.array().cast("array<string>"))))
    rows = docs.select(packed(docs).alias("row"), doc.alias("i"), th.alias("th"), text.alias("text"))
    out = rows.join(later, F.col("i").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").select("row", "text", F.split("text", "\n", -1).alias("lines"), "starts")
    done = out.select("row", "text", "lines", F.when(F.col("starts").isNotNull(), kept).alias("kept"))
    new = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    own = [new.alias(c) if c.lower() == text_col.lower() else F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return done.select(
        *own,
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("kept").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the repeated lines gone."""
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all columns of `docs`, texts without repeated lines, n_chars (if it is there) to match.

    Null texts stay null, with n_chars null; a null id is the smallest; repeated rows are treated alike and all stay; an
    empty table gives no rows; columns of any other name pass through, n_lines and n_removed too."""
    spare = [c for c in docs.columns if c.lower() in ("n_lines", "n_removed")]
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"own {c}" if c in spare else c) for c in docs.columns])
    done = line_dedup(renamed)
    count = F.length("text").cast("long")
    return done.select(*[count.alias(c) if c == "n_chars" else F.col(f"`own {c}`").alias(c) if c in spare else F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, i - 1 AS pos, lines[i] AS a, lines[i + 1] AS b, lines[i + 2] AS c
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM l)
),
r AS (
  SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k
  FROM w WHERE length(trim(a || b || c)) > 0
),
cov AS (SELECT DISTINCT doc_id, pos + k2 AS p FROM (SELECT doc_id, pos, unnest([0, 1, 2]) AS k2 FROM r WHERE k > 1)),
e AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS p FROM l),
g AS (
  SELECT e.doc_id, string_agg(line, chr(10) ORDER BY e.p) FILTER (WHERE cov.p IS NULL) AS kept,
         count(*) AS n_lines, count(cov.p) AS n_removed
  FROM e LEFT JOIN cov ON e.doc_id = cov.doc_id AND e.p = cov.p GROUP BY e.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(g.kept, '') END AS text,
       coalesce(g.n_lines, 0)::BIGINT AS n_lines, coalesce(g.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
