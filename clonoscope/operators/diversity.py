"""Diversity, length and composition features of repertoires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonoscope.functions import sequence as S
from clonoscope.functions import stats


def shares(counts: DataFrame, value: str = "cnt", by: str = "repertoire_id") -> DataFrame:
    """Each count's share of its repertoire's total."""
    return counts.withColumn("p", F.col(value) / F.sum(value).over(Window.partitionBy(by)))


def entropy(p: Column, base: float | None = None, eps: float = 0.0) -> Column:
    """Shannon entropy of shares as an aggregate."""
    log = F.ln(p + eps) if base is None else F.log(base, p + eps)
    return -F.sum(F.when(p > 0, p * log).otherwise(0.0))


def clone_diversity(rep: DataFrame, key: str = "junction_aa") -> DataFrame:
    """Per repertoire: entropies, Simpson, effective clones, clonality, unique ratio and the top clones' shares.
    Clones are ranked within their repertoire after they have been counted."""
    counts = shares(rep.where(F.col(key).isNotNull()).groupBy("repertoire_id", key).agg(F.count("*").alias("cnt")))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("repertoire_id").orderBy(F.desc("cnt"), key)))
    p = F.col("p")
    top = lambda n: F.sum(F.when(F.col("k") <= n, p).otherwise(0.0))
    h = entropy(p)
    return ranked.groupBy("repertoire_id").agg(
        h.alias("shannon_ln"), entropy(p, 2.0).alias("shannon_log2"), (1 - F.sum(p * p)).alias("simpson"), (1 / F.sum(p * p)).alias("effective_clones"), (1 / (1 + h)).alias("clonality"),
        F.count("*").alias("n_unique"), (F.count("*") / F.sum("cnt")).alias("unique_ratio"), top(1).alias("top1"), top(5).alias("top5"), top(10).alias("top10"), top(100).alias("top100"),
    )


def gini(rows: DataFrame, value: str) -> DataFrame:
    """Gini coefficient of values per repertoire. Equal values are counted first, so that the ordered step holds
    distinct ones; c of them up to the place e sum their places to c e - c (c - 1) / 2."""
    counts = rows.select("repertoire_id", F.col(value).cast("double").alias("x")).where("x is not null").groupBy("repertoire_id", "x").agg(F.count("*").alias("c"))
    ranked = counts.withColumn("e", F.sum("c").over(Window.partitionBy("repertoire_id").orderBy("x")))
    places, n, total = F.col("c") * F.col("e") - F.col("c") * (F.col("c") - 1) / 2, F.sum("c"), F.sum(F.col("c") * F.col("x"))
    return ranked.groupBy("repertoire_id").agg((2 * F.sum(places * F.col("x")) / F.nullif(n * total, F.lit(0.0)) - (n + 1) / n).alias("gini"))


def moments(rows: DataFrame, value: Column) -> DataFrame:
    """Moments and quantiles per repertoire: both deviations, exact linear quantiles, corrected skew and kurtosis."""
    x = rows.select("repertoire_id", value.cast("double").alias("x"))
    return x.groupBy("repertoire_id").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std_pop"), F.stddev_samp("x").alias("std_samp"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.median("x").alias("median"), F.percentile("x", F.lit(0.25)).alias("q25"), F.percentile("x", F.lit(0.75)).alias("q75"),
        stats.corrected_skew(F.col("x")).alias("skew"), stats.corrected_kurtosis(F.col("x")).alias("kurtosis"),
    )


def length_histogram(rep: DataFrame, edges: list[int], last: int | None = None, weight: Column | None = None) -> DataFrame:
    """Shares of sequences by length: [a, b) for neighbours in `edges`, and if asked [edges[-1], last]; other lengths
    count in the denominator. A row counts once, or `weight` times."""
    w = F.lit(1) if weight is None else weight
    n = F.length("junction_aa")
    bins = [(a, b, (n >= a) & (n < b)) for a, b in zip(edges, edges[1:], strict=False)]
    if last:
        bins.append((edges[-1], last, n.between(edges[-1], last)))
    return rep.where("junction_aa is not null").groupBy("repertoire_id").agg(*[(F.sum(F.when(inside, w).otherwise(0)) / F.sum(w)).alias(f"len_{a}_{b}") for a, b, inside in bins])


def length_bins_right(rep: DataFrame, edges: list[int]) -> DataFrame:
    """Shares by length in bins closed on the right."""
    n = F.length("junction_aa")
    return rep.groupBy("repertoire_id").agg(*[(F.count_if((n > a) & (n <= b)) / F.count("*")).alias(f"len_{a}_{b}_pct") for a, b in zip(edges, edges[1:], strict=False)])


def composition(rep: DataFrame, weight: Column | None = None) -> DataFrame:
    """Share of each amino acid among all letters of a repertoire. A row counts once, or `weight` times."""
    w = F.lit(1) if weight is None else weight
    total = F.sum(F.length("junction_aa") * w)
    return rep.groupBy("repertoire_id").agg(*[(F.sum((F.length("junction_aa") - F.length(F.replace("junction_aa", F.lit(a), F.lit("")))) * w) / total).alias(f"aa_{a}") for a in S.ALPHABET])


def sequence_composition(seqs: DataFrame) -> DataFrame:
    """Long shares of each amino acid in each sequence."""
    at = F.posexplode(S.letter_counts(F.col("junction_aa"))).alias("i", "c")
    rows = seqs.select("junction_aa", F.length("junction_aa").alias("n"), at).where("c > 0")
    return rows.select("junction_aa", F.substring(F.lit(S.ALPHABET), F.col("i") + 1, F.lit(1)).alias("aa"), (F.col("c") / F.col("n")).alias("share"))


def physchem(rep: DataFrame) -> DataFrame:
    """Mean, deviation and median over sequences of the mean hydropathy, charge and polarity of their residues."""
    kinds = {"hydropathy": S.HYDROPATHY, "charge": S.CHARGE, "polarity": S.POLARITY}
    rows = rep.select("repertoire_id", *[S.mean_property(F.col("junction_aa"), v).alias(n) for n, v in kinds.items()])
    return rows.groupBy("repertoire_id").agg(*[f(n).alias(f"{n}_{stat}") for n in kinds for f, stat in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.median, "median"))])


def gene_usage(rep: DataFrame, gene: str, top: int) -> DataFrame:
    """Shares of a repertoire's `top` most used genes."""
    counts = shares(rep.where(F.col(gene).isNotNull()).groupBy("repertoire_id", F.col(gene).alias("gene")).agg(F.count("*").alias("cnt")))
    k = F.row_number().over(Window.partitionBy("repertoire_id").orderBy(F.desc("cnt"), "gene"))
    return counts.withColumn("k", k).where(F.col("k") <= top).select("repertoire_id", "gene", "p")


def gene_diversity(rep: DataFrame, gene: str) -> DataFrame:
    """Entropy, distinct genes and the most used gene's share."""
    counts = shares(rep.where(F.col(gene).isNotNull()).groupBy("repertoire_id", gene).agg(F.count("*").alias("cnt")))
    return counts.groupBy("repertoire_id").agg(entropy(F.col("p")).alias(f"{gene}_entropy"), F.count("*").alias(f"{gene}_unique"), F.max("p").alias(f"{gene}_top"))


#: Of each gene kind the column, how many genes are features by themselves, and the sums of top shares.
GENE_KINDS = {"v": ("v_call", 50, (1, 5, 10)), "j": ("j_call", 30, (1, 5, 10)), "d": ("d_call", 20, (1, 5))}


def gene_features(rep: DataFrame) -> DataFrame:
    """Long features (repertoire_id, feature, value) of V, J and D usage: shares of all rows for the most used genes,
    the entropy of gene counts, distinct genes, their share of rows, and the most used genes' shares together."""
    kinds = {k: v for k, v in GENE_KINDS.items() if v[0] in rep.columns}
    each = rep.select("repertoire_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("gene")) for k, (c, _, _) in kinds.items()])).alias("x"))
    counts = each.groupBy("repertoire_id", "x.kind", "x.gene").agg(F.count("*").alias("cnt"))
    w = Window.partitionBy("repertoire_id", "kind")
    share = counts.withColumn("rows", F.sum("cnt").over(w)).where("gene is not null")
    ranked = share.withColumn("k", F.row_number().over(w.orderBy(F.desc("cnt"), "gene"))).withColumn("own", F.col("cnt") / F.sum("cnt").over(w)).withColumn("p", F.col("cnt") / F.col("rows"))
    most = F.element_at(F.create_map(*[F.lit(x) for k, (_, n, _) in kinds.items() for x in (k, n)]), F.col("kind"))
    genes = ranked.where(F.col("k") <= most).select("repertoire_id", F.concat("kind", F.lit("_freq_"), "gene").alias("feature"), F.col("p").alias("value"))
    tops = lambda n: F.sum(F.when(F.col("k") <= n, F.col("p")).otherwise(0.0))
    sums = ranked.groupBy("repertoire_id", "kind").agg(
        entropy(F.col("own")).alias("entropy"), F.count("*").cast("double").alias("unique_count"), (F.count("*") / F.first("rows")).alias("diversity"),
        tops(1).alias("top1_freq"), tops(5).alias("top5_freq"), tops(10).alias("top10_freq"),
    )
    names = ("entropy", "unique_count", "diversity", "top1_freq", "top5_freq", "top10_freq")
    long = sums.select("repertoire_id", "kind", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).alias("v")) for n in names])).alias("x"))
    kept = long.where((F.col("kind") != "d") | (F.col("x.n") != "top10_freq")).select("repertoire_id", F.concat_ws("_", "kind", "x.n").alias("feature"), F.col("x.v").alias("value"))
    return genes.unionByName(kept)


def pinned(features: DataFrame, names: list[str]) -> DataFrame:
    """Long features as one row a repertoire with exactly the columns `names`, in their order; what is missing is 0."""
    known = features.where(F.col("feature").isin(names)).groupBy("repertoire_id").pivot("feature", names).agg(F.first("value"))
    whole = features.select("repertoire_id").distinct().join(known, "repertoire_id", "left")
    return whole.select("repertoire_id", *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n) for n in names])


def template_stats(rep: DataFrame) -> DataFrame:
    x = F.col("templates").cast("double")
    return rep.groupBy("repertoire_id").agg(F.sum("templates").alias("total"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_pop(x).alias("std"), F.var_pop(x).alias("var"), F.min("templates").alias("min"), F.max("templates").alias("max"))
