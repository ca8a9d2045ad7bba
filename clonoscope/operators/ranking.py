"""Ranking sequences and laying results out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonoscope.functions import sequence as S
from clonoscope.functions import stats
from clonoscope.operators import enrich as E

#: The result's columns and its mark for not applicable.
COLUMNS = ("ID", "dataset", "label_positive_probability", "junction_aa", "v_call", "j_call")
NOT_APPLICABLE = -999.0
TOP = 50_000


def normalised(rows: DataFrame, *columns: str) -> DataFrame:
    """Columns scaled to 0..1 over the table, 1 where they are constant. The extremes are one row of aggregates."""
    ends = rows.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))])
    scaled = rows.crossJoin(F.broadcast(ends))
    for c in columns:
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        scaled = scaled.withColumn(f"{c}_norm", F.when(hi == lo, 1.0).otherwise((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0))))
    return scaled.select(*rows.columns, *[f"{c}_norm" for c in columns])


def top(rows: DataFrame, score: str, n: int = TOP, key: str = "junction_aa") -> DataFrame:
    """The best n by score, ties by key: a top-k per task, then of those."""
    return rows.orderBy(F.desc(score), key).limit(n)


def rank_by_witness(counts: DataFrame, model: Column, weight: float = 0.6, method: str = "log2_fold_change", n: int = TOP) -> DataFrame:
    """Sequences by the weighted sum of their scaled witness and model scores."""
    scored = normalised(counts.withColumn("witness", stats.witness(F.col("pos_count"), F.col("neg_count"), method).cast("double")).withColumn("model", model), "witness", "model")
    score = F.round(weight * F.col("witness_norm") + (1 - weight) * F.col("model_norm"), 6)
    return top(scored.withColumn("importance_score", score), "importance_score", n)


def level_scores(seqs: DataFrame, sets: list[tuple[DataFrame, float]], other: float) -> DataFrame:
    """Each sequence's score by the reference sets that it is in, the highest of theirs, `other` without one."""
    levels = sets[0][0].select("junction_aa", F.lit(sets[0][1]).alias("level"))
    for members, level in sets[1:]:
        levels = levels.unionByName(members.select("junction_aa", F.lit(level).alias("level")))
    best = levels.groupBy("junction_aa").agg(F.max("level").alias("level"))
    return seqs.join(best, "junction_aa", "left").select(*seqs.columns, F.coalesce("level", F.lit(other)).alias("model_score"))


def pattern_weights(coefficients: DataFrame, ks: tuple[int, ...]) -> dict[int, float]:
    """Per k the sum of absolute coefficients of its features, from rows of (feature, coefficient)."""
    k = F.regexp_extract("feature", r"^pattern([0-9]+)_", 1)
    got = {int(r["k"]): r["w"] for r in coefficients.where(k != "").groupBy(k.alias("k")).agg(F.sum(F.abs("coefficient")).alias("w")).collect()}  # a row a k
    return {k: got.get(k, 0.0) for k in ks}


def enrichment_report(ranked: DataFrame, k: int, score: str = "importance_score") -> DataFrame:
    """Totals over the best k of a ranking."""
    best = top(ranked, score, k)
    pos, neg = F.sum("pos_count"), F.sum("neg_count")
    only = F.count_if((F.col("pos_count") > 0) & (F.col("neg_count") == 0))
    return best.agg(F.count("*").alias("n"), pos.alias("total_pos"), neg.alias("total_neg"), (pos / F.greatest(pos + neg, F.lit(1))).alias("pos_ratio"), F.avg(score).alias("mean_score"), only.alias("pos_only"), (only / F.count("*")).alias("pos_only_ratio"))


def token_importance(seqs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Mean importance of a sequence's distinct gapped tokens among the selected ones, 0 without any. Few selected
    tokens are broadcast, so that only means are shuffled, not every token of every sequence."""
    each = seqs.select("junction_aa", F.explode(F.array_distinct(S.gapped_tokens(F.col("junction_aa")))).alias("token"))
    mean = each.join(E.small(tokens), "token").groupBy("junction_aa").agg(F.avg("importance").alias("m"))
    return seqs.join(mean, "junction_aa", "left").withColumn("importance", F.coalesce("m", F.lit(0.0))).drop("m")


def pattern_density(seqs: DataFrame, patterns: DataFrame, weights: dict[int, float]) -> DataFrame:
    """The shares of a sequence's windows of each k that are patterns, weighed by k and added, over all its windows;
    sequences shorter than all k have no row."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), S.kmers(F.col("junction_aa"), k).alias("kmers")) for k in weights]))
    windows = seqs.select("junction_aa", each.alias("x")).select("junction_aa", "x.k", F.size("x.kmers").alias("n"), F.explode("x.kmers").alias("kmer"))
    weight = F.element_at(F.create_map(*[F.lit(v) for k, w in weights.items() for v in (k, float(w))]), F.col("k"))
    known = patterns.select("k", "kmer", F.lit(1).alias("hit"))
    per = windows.join(known, ["k", "kmer"], "left").groupBy("junction_aa").agg(F.sum(F.when(F.col("hit") == 1, weight / F.col("n")).otherwise(0.0)).alias("s"), F.count("*").alias("windows"))
    return per.select("junction_aa", (F.col("s") / F.col("windows")).alias("pattern_score"))


def longest_pattern(seqs: DataFrame, patterns: DataFrame, ks: tuple[int, ...] = (6, 5, 4, 3)) -> DataFrame:
    """The longest selected pattern that a sequence contains; others are dropped. Few patterns are broadcast, so that
    windows are not shuffled."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), S.kmers_with_gap(F.col("junction_aa"), k).alias("kmers")) for k in ks]))
    windows = seqs.select("junction_aa", each.alias("x")).select("junction_aa", "x.k", F.explode("x.kmers").alias("kmer"))
    return windows.join(E.small(patterns.select("k", "kmer")), ["k", "kmer"], "left_semi").groupBy("junction_aa").agg(F.max("k").alias("pattern_score"))


def test_rows(probabilities: DataFrame, dataset: str) -> DataFrame:
    """Result rows of scored repertoires."""
    na = F.lit(str(NOT_APPLICABLE))
    return probabilities.select(F.col("repertoire_id").cast("string").alias("ID"), F.lit(dataset).alias("dataset"), F.col("probability").cast("double").alias("label_positive_probability"), na.alias("junction_aa"), na.alias("v_call"), na.alias("j_call"))


def ranked_rows(ranked: DataFrame, dataset: str, score: str = "importance_score") -> DataFrame:
    """Result rows of ranked sequences, numbered from 1. The ranking is a top-k, so its size is its limit."""
    place = F.row_number().over(Window.orderBy(F.desc(score), "junction_aa"))
    return ranked.select(F.concat(F.lit(f"{dataset}_seq_top_"), place.cast("string")).alias("ID"), F.lit(dataset).alias("dataset"), F.lit(NOT_APPLICABLE).alias("label_positive_probability"), "junction_aa", "v_call", "j_call")


def assembled(parts: list[DataFrame]) -> DataFrame:
    """Parts as one result table; missing columns are not applicable."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    fill = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(NOT_APPLICABLE)) if c == COLUMNS[2] else F.coalesce(F.col(c), F.lit(str(NOT_APPLICABLE)))
    return whole.select(*[(fill(c) if c in whole.columns else F.lit(NOT_APPLICABLE if c == COLUMNS[2] else str(NOT_APPLICABLE))).alias(c) for c in COLUMNS])


def validated(result: DataFrame) -> DataFrame:
    """Per dataset: rows, nulls in any column, and the range of probabilities that apply."""
    p = F.when(F.col(COLUMNS[2]) != NOT_APPLICABLE, F.col(COLUMNS[2]))
    nulls = F.greatest(*[F.col(c).isNull().cast("int") for c in COLUMNS])
    return result.groupBy("dataset").agg(F.count("*").alias("n"), F.sum(nulls).alias("n_null"), F.min(p).alias("p_min"), F.max(p).alias("p_max"))
