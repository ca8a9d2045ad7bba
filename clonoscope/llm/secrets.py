"""Secret scanning over an incremental, content-addressed blob ledger, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clonoscope.llm.common import table


@dataclass(frozen=True)
class Rule:
    """One version of one kind of secret. `pattern` has no anchors and no look-around, so that a match's text
    matches wherever it stands; `group` and `least` keep matches whose group has that many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1


# The base rules in their listed order, then the kinds that this scanner adds.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("version", T.IntegerType())])
FINDINGS = T.StructType([*LEDGER.fields, T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def blob_id(text: Column) -> Column:
    """The content address of a text (null: empty): its SHA-256."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _located(rule: Rule, text: Column) -> Column:
    """For one rule: null without a match, else the lengths of the pieces between matches and of the matches, and
    whether each match counts. Splitting at the pattern gives the pieces in order, so start positions are running
    sums of lengths, in code points."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    good = (lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least) if rule.least else (lambda m: F.lit(True))
    return F.when(
        text.rlike(rule.pattern),
        F.zip_with(F.slice(F.split(text, rule.pattern, -1), 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).cast("long").alias("gap"), F.length(m).cast("long").alias("len"), good(m).alias("good"))),
    )


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings (blob, kind, version, start, end) of `rules` in blobs(blob, text, kinds), where kinds names the rules
    still to be run on that blob. Positions are code points, end exclusive."""
    todo = [
        F.when(F.array_contains("kinds", r.kind), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _located(r, F.col("text")).alias("runs")))
        for r in rules
    ]
    hits = (
        blobs.select("blob", F.explode(F.array(*todo)).alias("r"))
        .where("r.runs is not null")
        .select("blob", "r.kind", "r.version", F.posexplode("r.runs").alias("i", "run"))
    )
    to = Window.partitionBy("blob", "kind").orderBy("i")
    return (
        hits.withColumn("end", F.sum(F.col("run.gap") + F.col("run.len")).over(to))
        .where("run.good")
        .select("blob", "kind", "version", (F.col("end") - F.col("run.len")).alias("start"), "end")
    )


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, known: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scan every version of every document that no earlier run has seen.

    `docs` holds paths (ids) and texts, historical versions being further rows; `ledger` the (blob, kind, version)
    that are done and `known` their findings, both as an earlier call returned them (None: nothing is done).
    Returns (paths, findings, ledger): paths has a row per input row with its id and blob; findings and ledger
    include the earlier ones that still apply to a current rule version, ready to be stored.

    Defined cases: null text is the empty blob; equal texts are one blob and scanned once; repeated rows and ids give
    a path row each; a rule with a new version is run again on all blobs and its old findings go; very long texts
    are scanned whole; extra columns are not read.

    Scale: one copy of each blob is kept by a map-side partial aggregate before the only shuffle of the text, so a
    blob that fills a third of the table costs one row a task. Position sums run within one blob and kind.
    """
    spark = docs.sparkSession
    paths = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("blob", blob_id(F.col("text")))
    blobs = paths.groupBy("blob").agg(F.first("text").alias("text"))
    current = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    if ledger is not None:
        done = ledger.join(F.broadcast(current), ["kind", "version"], "left_semi").groupBy("blob").agg(F.collect_set("kind").alias("done"))
        blobs = blobs.join(done, "blob", "left")
    else:
        blobs = blobs.withColumn("done", F.array().cast("array<string>"))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    todo = blobs.select("blob", "text", F.array_except(kinds, F.coalesce("done", F.array().cast("array<string>"))).alias("kinds")).where(F.size("kinds") > 0)
    found = scan(todo, rules)
    seen = todo.select("blob", F.explode("kinds").alias("kind")).join(F.broadcast(current), "kind").select("blob", "kind", "version")
    if ledger is not None:
        seen = seen.unionByName(ledger.join(F.broadcast(current), ["kind", "version"], "left_semi").select("blob", "kind", "version"))
    if known is not None:
        found = found.unionByName(known.join(F.broadcast(current), ["kind", "version"], "left_semi").select(*found.columns))
    return paths.select(id_col, "blob"), found, seen


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def digest(paths: DataFrame, findings: DataFrame, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings joined back to all paths, one row each: counts of the base kinds and the spans as text."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)]), F.col("kind"))
    by_blob = findings.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    per = by_blob.select(
        F.col("blob").alias("b"),
        *[F.size(_of_kind("spans", r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES],
        _joined(base).alias("base"),
        _joined(F.col("spans")).alias("spans"),
    )
    return paths.join(per, F.col("blob") == F.col("b"), "left").select(
        id_col,
        *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, from an empty ledger."""
    paths, findings, _ = scan_secrets(table(spark, sf_dir, "documents"))
    return digest(paths, findings)


def _sql_kind(kind: str, pattern: str, rank: int, good: str = "true") -> str:
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s AS start, s + length(m) AS "end" FROM (
    SELECT doc_id, ms[i] AS m, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
    FROM (SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i
          FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM t))
  ) WHERE {good}"""


_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SQL = (
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ("
    + " UNION ALL ".join(
        [
            _sql_kind("assign", _ASSIGN, 0, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 12"),
            _sql_kind("access", r"AKIA[A-Z0-9]+", 1, "length(m) >= 18"),
            _sql_kind("hex", r"[0-9a-f]{16,}", 2),
            *[_sql_kind(r.kind, r.pattern, 3 + i) for i, r in enumerate(MORE_RULES)],
        ]
    )
    + """), g AS (
  SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS a, count(*) FILTER (WHERE rank = 1) AS b, count(*) FILTER (WHERE rank = 2) AS c,
         string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base,
         string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) AS spans
  FROM f GROUP BY doc_id)
SELECT t.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g ON t.doc_id = g.doc_id"""
)
