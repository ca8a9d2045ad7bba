"""Scaling and evaluation of scores as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonoscope.operators.order import running


def standard_scaled(rows: DataFrame, *columns: str) -> DataFrame:
    """Population z-scores; a constant column becomes 0."""
    return scaled(rows, scale_stats(rows, *columns), *columns)


def scale_stats(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: the mean and population deviation of each column."""
    return rows.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])


def scaled(rows: DataFrame, stats: DataFrame, *columns: str) -> DataFrame:
    """Columns scaled by scale_stats of these or other rows."""
    out = rows.crossJoin(F.broadcast(stats))
    return out.select(*[c for c in rows.columns if c not in columns], *[((F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}"))).alias(c) for c in columns])


def robust_scaled(rows: DataFrame, *columns: str) -> DataFrame:
    """Distance from the median over the exact quartile range, or over 1 where that is 0."""
    ends = rows.agg(*[F.percentile(c, F.lit(q)).alias(f"__{int(q * 100)}_{c}") for c in columns for q in (0.25, 0.5, 0.75)])
    out = rows.crossJoin(F.broadcast(ends))
    iqr = {c: F.col(f"__75_{c}") - F.col(f"__25_{c}") for c in columns}
    return out.select(*[c for c in rows.columns if c not in columns], *[((F.col(c) - F.col(f"__50_{c}")) / F.when(iqr[c] == 0, 1.0).otherwise(iqr[c])).alias(c) for c in columns])


def curve(scored: DataFrame) -> DataFrame:
    """Per distinct score, from the highest: rows and positives so far, and in all. Scores are dealt by range, so no
    task holds them all; the totals are one row."""
    per = scored.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    summed = running(per, [F.desc("score")], {"n_to": F.col("n"), "p_to": F.col("p")})
    return summed.crossJoin(F.broadcast(summed.agg(F.sum("n").alias("n_all"), F.sum("p").alias("p_all"))))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve, ties counted half."""
    below = F.col("n_all") - F.col("p_all") - (F.col("n_to") - F.col("p_to"))
    own = F.col("n") - F.col("p")
    won = F.sum(F.col("p") * (below + own / 2))
    return curve(scored).agg((won / F.nullif(F.max("p_all") * (F.max("n_all") - F.max("p_all")), F.lit(0))).alias("roc_auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    return curve(scored).agg((F.sum(F.col("p") * F.col("p_to") / F.col("n_to")) / F.max("p_all")).alias("average_precision"))


def youden_threshold(scored: DataFrame) -> DataFrame:
    """The score with the largest true less false positive rate, the highest of equals."""
    j = F.round(F.col("p_to") / F.col("p_all") - (F.col("n_to") - F.col("p_to")) / (F.col("n_all") - F.col("p_all")), 9)
    return curve(scored).select("score", j.alias("j")).orderBy(F.desc("j"), F.desc("score")).limit(1).select(F.col("score").alias("threshold"), "j")


def f1_threshold(scored: DataFrame) -> DataFrame:
    """The score with the largest F1, the highest of equals."""
    precision, recall = F.col("p_to") / F.col("n_to"), F.col("p_to") / F.col("p_all")
    f1 = F.round(2 * precision * recall / (precision + recall + 1e-10), 9)
    return curve(scored).select("score", f1.alias("f1")).orderBy(F.desc("f1"), F.desc("score")).limit(1).select(F.col("score").alias("threshold"), "f1")


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    """Counts and rates at a threshold."""
    y, z = F.col("label") == 1, F.col("score") >= threshold
    tp, fp, fn, tn = F.count_if(y & z), F.count_if(~y & z), F.count_if(y & ~z), F.count_if(~y & ~z)
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    got = scored.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return got.select(
        "tp", "fp", "fn", "tn", safe(tp + tn, tp + fp + fn + tn).alias("accuracy"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"),
        safe(2 * tp, 2 * tp + fp + fn).alias("f1"), ((safe(tp, tp + fn) + safe(tn, tn + fp)) / 2).alias("balanced_accuracy"),
    )


def positive_probability(negative: Column, positive: Column) -> Column:
    """The softmax of two logits, its second part."""
    return 1 / (1 + F.exp(negative - positive))


def classification_report(scored: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall, F1 and support of each class at a threshold, then their plain and weighted means."""
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    guess = (F.col("score") >= threshold).cast("int")
    by = scored.select(F.col("label").cast("int").alias("y"), guess.alias("z")).groupBy("y", "z").agg(F.count("*").alias("n"))
    each = by.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.when((F.col("y") == k) & (F.col("z") == k), F.col("n")).otherwise(0).alias("hit"), F.when(F.col("z") == k, F.col("n")).otherwise(0).alias("said"), F.when(F.col("y") == k, F.col("n")).otherwise(0).alias("is")) for k in (0, 1)])).alias("x"))
    per = each.groupBy("x.k").agg(F.sum("x.hit").alias("hit"), F.sum("x.said").alias("said"), F.sum("x.is").alias("support"))
    rates = per.select(F.col("k").cast("string").alias("class"), safe(F.col("hit"), F.col("said")).alias("precision"), safe(F.col("hit"), F.col("support")).alias("recall"), safe(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support")
    names = ("precision", "recall", "f1")
    macro = rates.agg(*[F.avg(n).alias(n) for n in names], F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), *names, "support")
    weighted = rates.agg(*[safe(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(n) for n in names], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("class"), *names, "support")
    return rates.unionByName(macro).unionByName(weighted)


def progress(history: DataFrame, run: str, step: str, metric: str, seconds: str, window: int = 10) -> DataFrame:
    """Per run and step of a training history: the mean seconds of the last `window` steps, the best metric so far, and
    how many steps have passed since it was reached (patience)."""
    by = Window.partitionBy(run).orderBy(step)
    best = history.withColumn("best", F.max(metric).over(by)).withColumn("mean_seconds", F.avg(seconds).over(by.rowsBetween(1 - window, 0))).withColumn("n", F.row_number().over(by))
    before = F.lag("best").over(by)
    risen = best.withColumn("at", F.when(before.isNull() | (F.col("best") > before), F.col("n")))
    return risen.withColumn("waited", F.col("n") - F.max("at").over(by)).select(run, step, "best", "mean_seconds", "waited")


def rank_scaled(scored: DataFrame, key: str) -> DataFrame:
    """Places from 0 to 1 by score, equal scores alike."""
    per = running(scored.groupBy("score").agg(F.count("*").alias("n")), [F.asc("score")], {"to": F.col("n")})
    whole = per.agg(F.sum("n").alias("n_all"))
    place = per.crossJoin(F.broadcast(whole)).select("score", ((F.col("to") - F.col("n")) / F.greatest(F.col("n_all") - 1, F.lit(1))).alias("rank_scaled"))
    return scored.join(place, "score").select(key, "rank_scaled")
