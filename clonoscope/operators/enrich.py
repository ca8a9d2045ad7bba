"""Enrichment tests and feature selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonoscope.functions import sequence as S
from clonoscope.functions import stats
from clonoscope.operators import packs as PK
from clonoscope.sources.store import stored


#: Rows of a table that is broadcast, at most.
FEW = 200_000


def small(table: DataFrame) -> DataFrame:
    """A table of results, stored, and to be broadcast if it has few rows."""
    table = stored(table)
    return F.broadcast(table) if table.count() <= FEW else table


#: Windows of sequences that one task counts, and terms of Fisher's test that one task adds up, about.
WINDOWS = 2_000_000
TERMS = 200_000


def tasks_for(amount: int | None, each: int) -> int:
    return max(1, -(-int(amount or 0) // each))


def class_sizes(meta: DataFrame) -> DataFrame:
    """One row: positive and negative repertoires."""
    return meta.agg(F.count_if("label_positive").alias("n_pos"), F.count_if(~F.col("label_positive")).alias("n_neg"))


def pattern_counts(rows: DataFrame, ks: tuple[int, ...], gaps: bool = False) -> DataFrame:
    """Rows of each (repertoire, k, kmer) with how often it occurs. Equal sequences of a repertoire are counted once
    and weighed, so that windows are cut for distinct sequences only. A gap takes one more letter than k.

    Sequences are stored packed; windows of a repertoire that has up to WINDOWS of them are counted in one task and are
    not shuffled. Those of larger ones are dealt to as many tasks as they need. So no task's counts grow with the table."""
    rows = rows.where(F.length("junction_aa") >= min(ks))
    packs = stored(PK.packed(rows, ks, gaps))
    of = Window.partitionBy("repertoire_id", "label_positive")
    n, most = packs.groupBy("repertoire_id", "label_positive").agg(F.sum("n").alias("n")).agg(F.sum("n"), F.max("n")).first()
    if (most or 0) <= WINDOWS:
        return PK.counted(packs, ks, gaps, tasks_for(n, WINDOWS))
    packs = stored(packs.withColumn("whole", F.sum("n").over(of)))
    few, many = packs.where(F.col("whole") <= WINDOWS), packs.where(F.col("whole") > WINDOWS)
    n, beyond = packs.agg(F.sum(F.when(F.col("whole") <= WINDOWS, F.col("n"))), F.sum(F.when(F.col("whole") > WINDOWS, F.col("n")))).first()
    seqs = PK.unpacked(many).groupBy("repertoire_id", "label_positive", "junction_aa").agg(F.sum("w").alias("w"))
    of_k = lambda k: F.transform(windows(F.col("junction_aa"), (k,), gaps), lambda x: F.struct(F.lit(k).alias("k"), x.alias("kmer")))
    long = seqs.select("repertoire_id", "label_positive", "w", F.inline(F.concat(*map(of_k, ks))))
    dealt = long.repartition(tasks_for(beyond, WINDOWS), "repertoire_id", "kmer").groupBy("repertoire_id", "label_positive", "k", "kmer").agg(F.sum("w").alias("cnt"))
    return dealt if n is None else PK.counted(few, ks, gaps, tasks_for(n, WINDOWS)).unionByName(dealt)


def windows(s: Column, ks: tuple[int, ...], gaps: bool = False) -> Column:
    """All k-mers of a sequence, for all k; if asked with those with a gap in the middle, from four letters on."""
    return F.concat(*[(S.kmers_with_gap if gaps else S.kmers)(s, k) for k in ks])


def pattern_presence(counts: DataFrame) -> DataFrame:
    """Presence and abundance of patterns by label."""
    pos = F.col("label_positive")
    return counts.groupBy("k", "kmer").agg(F.count_if(pos).alias("a"), F.count_if(~pos).alias("b"), F.sum(F.when(pos, F.col("cnt")).otherwise(0)).alias("pos_abundance"))


def with_fisher(cand: DataFrame) -> DataFrame:
    """p_value for rows with a, b, n_pos, n_neg. The candidates are stored, so that they are counted once; the test
    runs once for each distinct (a, b) and joins back by key. Most candidates share a few small (a, b), so that the
    results are broadcast where they are few. Tests are dealt to as many tasks as their terms need."""
    cand = stored(cand)
    each = stored(cand.select("a", "b", "n_pos", "n_neg").distinct())
    terms = each.agg(F.sum(F.least("n_pos", F.col("a") + F.col("b")) - F.col("a") + 1)).first()[0]
    tests = each.repartition(tasks_for(terms, TERMS)).withColumn("p_value", stats.fisher_greater(F.col("a"), F.col("b"), F.col("n_pos"), F.col("n_neg")))
    return cand.join(small(tests), ["a", "b", "n_pos", "n_neg"])


def benjamini_hochberg(rows: DataFrame, p: str = "p_value", keys: tuple[str, ...] = ("kmer",), by: tuple[str, ...] = ()) -> DataFrame:
    """Adjusted p-values. Ranks are taken over distinct p-values with their counts, so that the ordered step holds no
    more rows than there are different tests, whatever the number of candidates."""
    counts = rows.groupBy(*by, p).agg(F.count("*").alias("m_p"))
    up = Window.partitionBy(*by).orderBy(p)
    ranked = counts.withColumn("r", F.sum("m_p").over(up)).withColumn("m", F.sum("m_p").over(Window.partitionBy(*by)))
    down = Window.partitionBy(*by).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = ranked.select(*by, p, F.least(F.lit(1.0), F.min(F.col(p) * F.col("m") / F.col("r")).over(down)).alias("p_adjusted"))
    return rows.join(small(adjusted), [*by, p])


def select_strict(counts: DataFrame, sizes: DataFrame, least: int = 5, fold: float = 4.0, p: float = 1e-4, top: int = 50) -> DataFrame:
    """Patterns in enough repertoires, with a high smoothed fold change and a small p-value; the best `top` of each k."""
    cand = pattern_presence(counts).crossJoin(F.broadcast(sizes)).where((F.col("a") + F.col("b") >= least) & (F.col("a") >= 2))
    cand = cand.withColumn("fold", stats.fold_change(F.col("a"), F.col("b"), F.col("n_pos"), F.col("n_neg"))).where(F.col("fold") >= fold)
    k = F.row_number().over(Window.partitionBy("k").orderBy("p_value", F.desc("fold"), "kmer"))
    return with_fisher(cand).where(F.col("p_value") <= p).withColumn("place", k).where(F.col("place") <= top).select("k", "kmer", "a", "b", "fold", "p_value")


def fdr_scored(counts: DataFrame, sizes: DataFrame, least: int = 3, fold: float = 2.0) -> DataFrame:
    """Patterns by raw fold change, with adjusted p-values among those and their place by combined score in their k."""
    cand = pattern_presence(counts).crossJoin(F.broadcast(sizes)).where((F.col("a") + F.col("b") >= least) & (F.col("a") >= 1))
    cand = with_fisher(cand.withColumn("fold", stats.fold_change_raw(F.col("a"), F.col("b"), F.col("n_pos"), F.col("n_neg"))).where(F.col("fold") >= fold))
    cand = benjamini_hochberg(cand, by=("k",)).withColumn("combined", -F.log10(F.col("p_value") + 1e-10) * F.col("fold") * F.log1p(F.col("pos_abundance").cast("double")))
    k = F.row_number().over(Window.partitionBy("k").orderBy(F.desc(F.round("combined", 6)), F.round("p_value", 10), F.desc("pos_abundance"), "kmer"))
    return cand.withColumn("place", k)


def select_fdr(counts: DataFrame, sizes: DataFrame, least: int = 3, fold: float = 2.0, fdr: float = 0.05, top: int = 10_000) -> DataFrame:
    """Patterns by raw fold change, false discovery rate among those, and the best by combined score."""
    return fdr_scored(counts, sizes, least, fold).where((F.col("place") <= top) & (F.col("p_adjusted") <= fdr)).select("k", "kmer", "a", "b", "p_value", "p_adjusted", "pos_abundance")


def fdr_report(scored: DataFrame, top: int = 10_000, fdr: float = 0.05, shown: int = 100) -> DataFrame:
    """The best patterns of each k by combined score, and whether the selection takes them."""
    return scored.where(F.col("place") <= shown).select("k", "kmer", "place", "p_adjusted", ((F.col("place") <= top) & (F.col("p_adjusted") <= fdr)).alias("selected"))


def chi2_scores(presence: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Chi-squared of presence by class for each token."""
    return presence.crossJoin(F.broadcast(sizes)).select(key, stats.chi2_presence(F.col("pos_count"), F.col("neg_count"), F.col("n_pos"), F.col("n_neg")).alias("chi2"))


def differential(presence: DataFrame, sizes: DataFrame, top: int = 600) -> DataFrame:
    """Sequences by the difference of their shares of positive and negative repertoires."""
    score = F.col("pos_count") / F.col("n_pos") - F.col("neg_count") / F.col("n_neg")
    return presence.crossJoin(F.broadcast(sizes)).select("junction_aa", F.round(score, 6).alias("differential_score")).orderBy(F.desc("differential_score"), "junction_aa").limit(top)


def log_fold_total(sums: DataFrame) -> DataFrame:
    """Log fold change of templates times the log of their total, with one added to each label's."""
    p, n = F.col("pos_templates"), F.col("neg_templates")
    return sums.withColumn("score", F.log2((p + 1) / (n + 1)) * F.ln((p + n + 2).cast("double")))


def pattern_features(counts: DataFrame, patterns: DataFrame, ids: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Per repertoire and k: matched patterns, their abundance, entropy, maximum and mean, and both as shares of all
    windows; repertoires without a match have zeros. Counts are read once: patterns that are not looked for are one row
    of each repertoire and k before the shuffle."""
    known = small(patterns.select("k", "kmer").withColumn("hit", F.col("kmer")))
    each = counts.join(known, ["k", "kmer"], "left").groupBy("repertoire_id", "k", "hit").agg(F.count("*").alias("n"), F.sum("cnt").alias("cnt"))
    found = F.when(F.col("hit").isNotNull(), F.col("cnt"))
    p = found / F.sum(found).over(Window.partitionBy("repertoire_id", "k"))
    per = each.withColumn("found", found).withColumn("p", p).groupBy("repertoire_id", "k").agg(
        F.sum("n").alias("n_kmers"), F.sum("cnt").alias("total"), F.count("found").alias("count"), F.sum("found").alias("abundance"),
        (0 - F.sum(F.col("p") * F.ln(F.col("p") + 1e-10))).alias("diversity"), F.max("found").alias("max"), F.avg("found").alias("mean"),
    )
    full = ids.select("repertoire_id", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    names = ("count", "abundance", "diversity", "max", "mean", "n_kmers", "total")
    zero = full.join(per, ["repertoire_id", "k"], "left").na.fill(0, list(names))
    return zero.withColumn("ratio", F.col("count") / (F.col("total") + 1e-10)).withColumn("abundance_ratio", F.col("abundance") / (F.col("total") + 1e-10))


def widened(features: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """The long features as one row a repertoire: seven a k, their sums over k, ratios between k, and counts by a
    thousand windows of the first k; 30 columns for three k."""
    cols = {"count": "count", "abundance": "abundance", "diversity": "diversity", "max": "max_abundance", "mean": "mean_abundance", "ratio": "ratio", "abundance_ratio": "abundance_ratio"}
    of = lambda k, c: F.sum(F.when(F.col("k") == k, F.col(c)).otherwise(0))
    wide = features.groupBy("repertoire_id").agg(*[of(k, c).alias(f"pattern{k}_{n}") for k in ks for c, n in cols.items()], of(ks[0], "total").alias("windows"))
    pairs = [(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :]]
    return wide.select(
        *[c for c in wide.columns if c != "windows"],
        *[sum((F.col(f"pattern{k}_{c}") for k in ks[1:]), F.col(f"pattern{ks[0]}_{c}")).alias(f"pattern_all_{c}") for c in ("count", "abundance", "diversity")],
        *[((F.col(f"pattern{a}_count") + 1e-10) / (F.col(f"pattern{b}_count") + 1e-10)).alias(f"pattern{a}_to_{b}_ratio") for a, b in pairs],
        *[(F.col(f"pattern{k}_count") * 1000 / (F.col("windows") + 1)).alias(f"pattern{k}_count_per_1k") for k in ks],
    )
