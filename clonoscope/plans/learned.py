"""Queries with models: results that SQL does not express. Scaling, class weights and selections are fitted on training
folds only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoscope.operators import counts as C
from clonoscope.operators import diversity as D
from clonoscope.operators import enrich as E
from clonoscope.operators import evaluate as V
from clonoscope.operators import sampling as P
from clonoscope.sources import adapters as A
from clonoscope.sources.store import stored

FEATURES = ("shannon_ln", "simpson", "clonality", "unique_ratio", "top1", "top10", "n_v", "templates")
Model = Callable[[int], object]


def repertoire_features(rep: DataFrame) -> DataFrame:
    """One row a repertoire: diversity, distinct V genes and templates."""
    more = rep.groupBy("repertoire_id").agg(F.count_distinct("v_call").cast("double").alias("n_v"), F.sum("templates").cast("double").alias("templates"))
    return D.clone_diversity(rep).join(more, "repertoire_id").select("repertoire_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES])


#: Rows of features that one task holds, about: every step of a fit is a job over all of them.
ROWS = 20_000


def table_of_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a supplier: features as they are, label and fold, stored for the models that share them."""
    tasks = E.tasks_for(A.clone_metadata(spark, sf_dir).count(), ROWS)
    meta = P.folds(A.clone_metadata(spark, sf_dir)).select("repertoire_id", "fold", F.col("label_positive").cast("double").alias("label"))
    return stored(repertoire_features(A.clone_repertoire(spark, sf_dir)).join(meta, "repertoire_id").repartition(tasks, "repertoire_id"))


def prepared(train: DataFrame, names: tuple[str, ...], *others: DataFrame) -> list[DataFrame]:
    """The training rows and others with vectors scaled by the training rows, and weights that balance their classes."""
    stats = V.scale_stats(train, *names)
    n, positive = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    weight = F.when(F.col("label") == 1, n / (2 * max(positive, 1))).otherwise(n / (2 * max(n - positive, 1)))
    assemble = VectorAssembler(inputCols=list(names), outputCol="features")
    return [assemble.transform(V.scaled(rows, stats, *names)).withColumn("weight", weight if "label" in rows.columns else F.lit(1.0)) for rows in (train, *others)]


def logistic(c: float = 1.0, l1: bool = False) -> Model:
    """Regularised as 1 / (c n), without a second standardisation, classes balanced."""
    return lambda n: LogisticRegression(regParam=1.0 / (c * max(n, 1)), elasticNetParam=float(l1), standardization=False, maxIter=50, weightCol="weight")


def forest(trees: int = 100, depth: int = 5) -> Model:
    return lambda n: RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=42, weightCol="weight")


def boosted(trees: int = 20, depth: int = 3, rate: float = 0.1) -> Model:
    """Gradient boosting on shares of rows and columns. Spark has no penalties on leaves."""
    return lambda n: GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42, weightCol="weight")


MODELS: dict[str, Model] = {"lr_predict": logistic(), "lr_l1_predict": logistic(0.1, True), "rf_predict": forest(), "gbt_predict": boosted()}
#: What the grid search tries, by family.
GRID: dict[str, Model] = {
    **{f"logistic {kind} C={c:g}": logistic(c, kind == "l1") for kind in ("l1", "l2") for c in (0.1, 1.0)},
    **{f"forest trees={t}": forest(t) for t in (50, 100)},
    **{f"boosting depth={d}": boosted(10, d) for d in (2, 3)},
}


#: Models' settings that are tried at a time; the folds of each are fitted at a time too.
TRIED = 4


def at_once(spark: SparkSession, makes: list[Callable[[], object]], most: int) -> list:
    """What each function returns, up to so many running at a time. A fit is many small jobs, one after another, between
    which the executors wait for the driver."""
    with ThreadPool(max(1, min(most, len(makes)))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda make: make()), makes, chunksize=1)


def out_of_fold(rows: DataFrame, model: Model, names: tuple[str, ...] = FEATURES, folds: int = 5) -> DataFrame:
    """Each repertoire's probability from a model, and a scaling, that were fitted without its fold."""

    def part(k: int) -> DataFrame:
        train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        n, classes = train.agg(F.count("*"), F.count_distinct("label")).first()
        if classes < 2:
            return test.select("repertoire_id", "label", "fold", F.lit(0.5).alias("probability"))
        fitted, asked = prepared(train, names, test)
        return model(n).fit(fitted).transform(asked).select("repertoire_id", "label", "fold", F.get(vector_to_array("probability"), F.lit(1)).alias("probability"))

    parts = at_once(rows.sparkSession, [lambda k=k: part(k) for k in range(folds)], folds)
    return stored(reduce(DataFrame.unionByName, parts))


def area(scored: DataFrame) -> float:
    """The ROC area of probabilities, 0.5 where a class is missing."""
    if scored.select("label").distinct().count() < 2:
        return 0.5
    return BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol="label", numBins=0).evaluate(scored)


def predicted(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: out_of_fold(table_of_features(spark, d), MODELS[name]).select("repertoire_id", "probability")


def cross_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model's ROC area by fold."""
    rows = table_of_features(spark, sf_dir)
    found = [(n, k, area(scored.where(F.col("fold") == k))) for n, scored in ((n, out_of_fold(rows, m)) for n, m in MODELS.items()) for k in range(5)]
    return spark.createDataFrame(found, "model string, fold int, roc_auc double")


def mean_of(parts: list[DataFrame]) -> DataFrame:
    """The mean of probabilities, joined by repertoire."""
    whole = reduce(DataFrame.unionByName, [p.select("repertoire_id", "probability") for p in parts])
    return whole.groupBy("repertoire_id").agg(F.avg("probability").alias("probability"))


def soft_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the three best models' probabilities, by their areas."""
    rows = table_of_features(spark, sf_dir)
    scored = [out_of_fold(rows, m) for m in MODELS.values()]
    return mean_of(sorted(scored, key=area, reverse=True)[:3])


def stacked_by(meta: Model) -> Callable[[SparkSession, str], DataFrame]:
    """A model over two families' out-of-fold probabilities, itself out of fold."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table_of_features(spark, sf_dir)
        of = lambda m, n: out_of_fold(rows, MODELS[m]).select("repertoire_id", F.col("probability").alias(n))
        a, b = at_once(spark, [lambda: of("lr_predict", "a"), lambda: of("gbt_predict", "b")], TRIED)
        both = stored(a.join(b, "repertoire_id").join(rows.select("repertoire_id", "label", "fold"), "repertoire_id"))
        return out_of_fold(both, meta, ("a", "b")).select("repertoire_id", "probability")

    return run


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold probabilities made isotonic by the other folds' ones."""
    scored = out_of_fold(table_of_features(spark, sf_dir), logistic())
    parts = []
    for k in range(5):
        model = IsotonicRegression(featuresCol="probability", labelCol="label").fit(scored.where(F.col("fold") != k))
        parts.append(model.transform(scored.where(F.col("fold") == k)).select("repertoire_id", F.col("prediction").alias("probability")))
    return reduce(DataFrame.unionByName, parts)


def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of three families by their mean area over folds."""
    rows = table_of_features(spark, sf_dir)

    def tried(name: str, model: Model) -> tuple[str, str, float, float]:
        scored = out_of_fold(rows, model, folds=5)
        areas = [area(scored.where(F.col("fold") == k)) for k in range(5)]
        return name.split(" ")[0], name, sum(areas) / 5, area(scored)

    found = at_once(spark, [lambda n=n, m=m: tried(n, m) for n, m in GRID.items()], TRIED)
    return spark.createDataFrame(found, "family string, setting string, mean_auc double, auc double").orderBy(F.desc("mean_auc"), "setting")


def config_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosting with and without under-sampling: areas out of fold inside the training split, and on the test split,
    which only reports."""
    rows = table_of_features(spark, sf_dir)
    split = P.stratified_split(rows.select("repertoire_id", (F.col("label") == 1).alias("label_positive")))
    rows = stored(rows.join(split.select("repertoire_id", "is_test"), "repertoire_id"))
    train, test = rows.where(~F.col("is_test")), rows.where("is_test")
    less = P.undersampled(train.select("repertoire_id", (F.col("label") == 1).alias("label_positive"))).select("repertoire_id")
    found = []
    for name, used in (("all", train), ("undersampled", stored(train.join(less, "repertoire_id", "left_semi")))):
        for depth in (2, 3):
            fitted, asked = prepared(used, FEATURES, test)
            scored = boosted(10, depth)(0).fit(fitted).transform(asked).select("label", F.get(vector_to_array("probability"), F.lit(1)).alias("probability"))
            found.append((name, depth, area(out_of_fold(used, boosted(10, depth), folds=5)), area(scored)))
    return spark.createDataFrame(found, "rows string, depth int, cv_auc double, test_auc double")


def importances(spark: SparkSession, sf_dir: str, top: int = 1_000) -> DataFrame:
    """The `top` features by a forest's importance, with a regression's absolute weight."""
    rows = table_of_features(spark, sf_dir)
    (fitted,) = prepared(rows, FEATURES)
    trees = forest()(0).fit(fitted).featureImportances.toArray().tolist()
    weights = logistic()(rows.count()).fit(fitted).coefficients.toArray().tolist()
    return spark.createDataFrame([(f, a, abs(b)) for f, a, b in zip(FEATURES, trees, weights, strict=True)], "feature string, importance double, weight double").orderBy(F.desc("importance"), "feature").limit(top)


def forward_selection(rows: DataFrame, names: tuple[str, ...], most: int = 3, holdout: bool = False) -> list[tuple[int, str, float]]:
    """Adds the feature that raises the area most, while one does: (step, feature, area). Areas are out of fold, or with
    `holdout` of fold 0 only, from models of the others, and compared to nine places: sums in another order differ beyond."""
    chosen: list[str] = []
    history: list[tuple[int, str, float]] = []
    while len(chosen) < most:
        of = lambda n: (round(area(out_of_fold(rows, logistic(), (*chosen, n), 1 if holdout else 5)), 9), n)
        best = max(at_once(rows.sparkSession, [lambda n=n: of(n) for n in names if n not in chosen], TRIED))
        if history and best[0] <= history[-1][2]:
            break
        chosen.append(best[1])
        history.append((len(history) + 1, best[1], float(best[0])))
    return history


def forward_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(forward_selection(table_of_features(spark, sf_dir), FEATURES, len(FEATURES)), "step int, feature string, roc_auc double")


def nested_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold probabilities with patterns of three to five letters selected by Fisher's test, and features scaled,
    anew without each fold; a fold for which no pattern passes has the other folds' share of positives."""
    ks = (3, 4, 5)
    rep = A.clone_repertoire(spark, sf_dir).join(P.folds(A.clone_metadata(spark, sf_dir)), "repertoire_id")
    ids = stored(rep.select("repertoire_id", "label_positive", "fold").distinct())
    counts = stored(E.pattern_counts(rep, ks).join(ids.select("repertoire_id", "fold"), "repertoire_id"))
    parts = []
    for k in range(5):
        known = ids.where(F.col("fold") != k)
        patterns = E.select_strict(counts.where(F.col("fold") != k), E.class_sizes(known), fold=1.2, p=0.05)
        wide = E.widened(E.pattern_features(counts, patterns, ids, ks), ks)
        names = tuple(c for c in wide.columns if c != "repertoire_id")
        data = stored(wide.join(ids, "repertoire_id").withColumn("label", F.col("label_positive").cast("double")))
        fitted, asked = prepared(data.where(F.col("fold") != k), names, data.where(F.col("fold") == k))
        parts.append(logistic(0.01)(known.count()).fit(fitted).transform(asked).select("repertoire_id", "fold", F.get(vector_to_array("probability"), F.lit(1)).alias("probability")))
    return reduce(DataFrame.unionByName, parts)


def polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Powers of a feature through the pipeline API."""
    rows = C.reference_diversity(A.word_repertoire(spark, sf_dir), A.reference_set(spark, sf_dir)).withColumn("x", F.log1p(F.col("reference_diversity").cast("double")))
    out = PolynomialExpansion(degree=2, inputCol="v", outputCol="p").transform(VectorAssembler(inputCols=["x"], outputCol="v").transform(rows))
    return out.select("repertoire_id", vector_to_array("p").alias("powers"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: predicted(name) for name in MODELS} | {
    "cv_scores": cross_validated,
    "soft_vote_predict": soft_vote,
    "stacked_predict": stacked_by(logistic()),
    "stacked_forest_predict": stacked_by(forest(50)),
    "isotonic_predict": calibrated,
    "grid_search": grid_search,
    "config_search": config_search,
    "feature_importance": importances,
    "forward_select": forward_select,
    "nested_cv_predict": nested_cv,
    "polynomial_pipeline": polynomial,
}
