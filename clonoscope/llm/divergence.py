"""How far the sources of a language stand apart in their words: dense tiles of groups by terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonoscope.llm.common import table, written

#: Documents of a language that a kept term is in, what is added to each count, and the unit of a share.
LEAST, ADDED, UNIT = 30, 5, 1_000_000_000
#: Terms reported for each group.
TOP = 50
#: Terms (about) and groups (at most, on each of two sides) of a tile.
TERMS, GROUPS = 1024, 256
#: Distinct terms by group that a counting task holds before it hands them on.
HELD = 300_000

# a byte of a term is an ASCII letter, lower-cased, or no ASCII; all else becomes a space
_LETTERS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_COUNTS = "lang string, source string, term binary, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, summed within the task."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            group = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(terms), dtype=np.int32))) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*group, pa.array(terms, pa.binary()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = (text.as_py() or b"").translate(_LETTERS).split()
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            n.update(words)
            docs.update(set(words))
            size += len(n) - before
            if size > HELD:
                yield from flush()
                size = 0
    yield from flush()


def _shares(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * counts / of) in whole numbers, three digits at a time, so that nothing overflows below 9e15."""
    out, rest = np.zeros(np.broadcast(counts, of).shape, dtype=np.int64), counts
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // of
        rest = rest % of
    return out + 1


def _tile(added: int, top: int, groups: int) -> Callable[[pa.Table], pa.Table]:
    """One tile: its share of each pair's distance, and the best terms of each of its groups. A row without a term is
    a group, with its total and its language's; terms of the block that none of the groups has count too."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        header = rows.filter(pc.is_null(rows.column("term"))).sort_by("gid")
        cells = rows.filter(pc.is_valid(rows.column("term")))
        lang, i, j = (header.column(c)[0].as_py() for c in ("lang", "gi", "gj"))
        gid, total, lang_total, v = (header.column(c).to_numpy() for c in ("gid", "n", "whole", "kept"))
        terms = pc.unique(cells.column("term"))
        terms = terms.take(pc.sort_indices(terms))
        counts = np.zeros((len(gid), len(terms)), dtype=np.int64)
        column = pc.index_in(cells.column("term"), terms).to_numpy()
        counts[np.searchsorted(gid, cells.column("gid").to_numpy()), column] = cells.column("n").to_numpy()
        of = total + added * v
        shares = _shares(counts + added, of[:, None]) if len(terms) else counts
        absent = header.column("block_terms")[0].as_py() - len(terms)
        base = _shares(np.full(len(gid), added, dtype=np.int64), of) if absent else np.zeros(len(gid), dtype=np.int64)
        out: list[tuple[str, np.ndarray, np.ndarray, pa.Array, np.ndarray]] = []
        one, two = np.flatnonzero(gid // groups == i), np.flatnonzero(gid // groups == j)
        for a in one.tolist():
            others = two[two > a]
            apart = np.abs(shares[others] - shares[a]).sum(axis=1) + absent * np.abs(base[others] - base[a])
            out.append(("pair", np.full(len(others), gid[a]), gid[others], pa.nulls(len(others), pa.binary()), apart))
        if i == j and len(terms):
            whole = np.zeros(len(terms), dtype=np.int64)
            whole[column] = cells.column("whole").to_numpy()
            expected = _shares(whole + added, np.array(lang_total[0] + added * v[0]))
            for a in range(len(gid)):
                over = np.flatnonzero((counts[a] > 0) & (shares[a] > expected))
                value = shares[a][over] - expected[over]
                best = np.argsort(-value, kind="stable")[:top]
                out.append(("term", np.full(len(best), gid[a]), np.full(len(best), -1), terms.take(pa.array(over[best])), value[best]))
        joined = lambda k, t: pa.array(np.concatenate([np.empty(0, dtype=np.int64), *(x[k] for x in out)]).astype(t))
        n = sum(len(x[1]) for x in out)
        return pa.table({
            "lang": pa.array([lang] * n, pa.string()),
            "part": pa.array([x[0] for x in out for _ in range(len(x[1]))], pa.string()),
            "gid": joined(1, np.int32),
            "other": joined(2, np.int32),
            "term": pa.concat_arrays([pa.nulls(0, pa.binary()), *(x[3].combine_chunks() if isinstance(x[3], pa.ChunkedArray) else x[3] for x in out)]),
            "value": joined(4, np.int64),
        })

    return run


def _tiled(rows: DataFrame, groups: int) -> DataFrame:
    """The rows, each for all the pairs of group blocks that its own block is in."""
    own, last = F.floor(F.col("gid") / groups).cast("int"), F.floor((F.col("sources") - 1) / groups).cast("int")
    spread = rows.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    return spread.select("lang", "block", F.least("own", "with").alias("gi"), F.greatest("own", "with").alias("gj"), "gid", "term", "n", "whole", "kept", "block_terms")


def divergence(docs: DataFrame, least: int = LEAST, added: int = ADDED, top: int = TOP, terms: int = TERMS, groups: int = GROUPS) -> DataFrame:
    """How far each (lang, source) group stands from the other sources of its language, over all kept terms (part
    `pair`), and the terms that it uses more than its language does (part `term`, the first `top`): lang, source, part,
    item, value, rank.

    A term is a run of ASCII letters, A-Z lower-cased, and characters beyond ASCII; a language keeps those of at least
    `least` of its documents. Shares are whole billionths of smoothed counts, and all arithmetic is in whole numbers.

    Terms are counted by group inside tasks before any shuffle, so that a hot source or a frequent word brings a row a
    task. A language's terms are dealt into blocks of about `terms`, its sources into blocks of at most `groups`: a
    tile holds one block of terms for two blocks of groups as a dense matrix, compares its groups in NumPy and passes on
    sums for pairs and the best terms of each group, which are added and merged. A tile's size depends on no table.

    Defined cases: null text, lang and source are empty strings; groups without terms take part, with a count of 0; a
    language that keeps no term has value 0 for all its pairs; equal values rank by item in byte order; repeated rows
    count each; other columns are not read; an empty table gives no rows.
    """
    group = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    counted = docs.select(*group, F.col("`text`").cast("binary").alias("text")).mapInArrow(_count, _COUNTS)
    cells = written(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    known = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole")).where(F.col("docs") >= least)
    many = known.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("whole").alias("lang_n"))
    # a language's sources are few enough for all their pairs, which the result holds
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    named = docs.select(*group).distinct().withColumn("gid", place).withColumn("sources", F.count("*").over(Window.partitionBy("lang")))
    named = named.join(many.withColumnRenamed("lang", "l"), F.col("lang") == F.col("l"), "left").drop("l").na.fill(0, ["kept", "lang_n"])
    of = named.select(F.col("lang").alias("l"), F.col("source").alias("s"), "gid", "sources", "kept")
    joined = cells.select("lang", "source", "term", "n").join(known.select(F.col("lang").alias("kl"), F.col("term").alias("kt"), "whole"), (F.col("lang") == F.col("kl")) & (F.col("term") == F.col("kt")))
    block = F.pmod(F.xxhash64("term"), F.greatest(F.ceil(F.col("kept") / terms), F.lit(1))).cast("int")
    placed = written(joined.join(of, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s"))).select("lang", "gid", "sources", "term", "n", "whole", "kept", block.alias("block")))
    totals = placed.groupBy(F.col("lang").alias("l"), F.col("gid").alias("g")).agg(F.sum("n").alias("total"))
    sized = placed.groupBy(F.col("lang").alias("l"), "block").agg(F.count_distinct("term").alias("block_terms"))
    header = (
        named.join(totals, (F.col("lang") == F.col("l")) & (F.col("gid") == F.col("g")), "left").drop("l", "g")
        .join(sized, F.col("lang") == F.col("l"), "left")
        .select("lang", "gid", "sources", F.lit(None).cast("binary").alias("term"), F.coalesce("total", F.lit(0)).alias("n"), F.col("lang_n").alias("whole"), "kept", F.coalesce("block", F.lit(0)).alias("block"), F.coalesce("block_terms", F.lit(0)).alias("block_terms"))
    )
    every = _tiled(header.unionByName(placed.withColumn("block_terms", F.lit(0).cast("long"))), groups)
    parts = written(every.groupBy("lang", "block", "gi", "gj").applyInArrow(_tile(added, top, groups), "lang string, part string, gid int, other int, term binary, value long"))
    apart = parts.where("part = 'pair'").groupBy("lang", "gid", "other").agg(F.sum("value").alias("value"))
    both = apart.unionByName(apart.select("lang", F.col("other").alias("gid"), F.col("gid").alias("other"), "value"))
    names = lambda p: named.select(F.col("lang").alias(f"{p}l"), F.col("gid").alias(f"{p}g"), F.col("source").alias(f"{p}s"))
    on = lambda p, c: (F.col("lang") == F.col(f"{p}l")) & (F.col(c) == F.col(f"{p}g"))
    pairs = both.join(names("a"), on("a", "gid")).join(names("b"), on("b", "other")).select("lang", F.col("as").alias("source"), F.lit("pair").alias("part"), F.col("bs").alias("item"), "value")
    found = parts.where("part = 'term'").join(names("a"), on("a", "gid")).select("lang", F.col("as").alias("source"), "part", F.col("term").cast("string").alias("item"), "value")
    rank: Column = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = pairs.unionByName(found).withColumn("rank", rank)
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of each language compared over all documents."""
    return divergence(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS whole FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
l AS (SELECT lang, count(*) AS v, sum(whole)::BIGINT AS n FROM kept GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT x.lang, x.source, coalesce(y.n, 0) AS n, coalesce(l.v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN (SELECT lang, source, sum(n)::BIGINT AS n FROM c GROUP BY ALL) y USING (lang, source) LEFT JOIN l USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS c, 1 + ((1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v)) AS p, 1 + ((1000000000::HUGEINT * (k.whole + 5)) // (l.n + 5 * l.v)) AS q
  FROM g JOIN kept k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= 50
"""
