"""Pipelines that are fitted on labelled repertoires, stored, and applied to new ones. A recipe selects what it looks
for (sequences, tokens or patterns), makes features of any repertoires from that, and names a model."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonoscope.functions import sequence as S
from clonoscope.operators import counts as C
from clonoscope.operators import diversity as D
from clonoscope.operators import enrich as E
from clonoscope.operators import evaluate as V
from clonoscope.operators import graph as G
from clonoscope.operators import ranking as R
from clonoscope.operators import sampling as P
from clonoscope.plans import learned, rankings
from clonoscope.sources import adapters as A
from clonoscope.sources import store

#: Terms (sequences, tokens) that a pipeline looks for, at most; they are the model's vocabulary.
TERMS = 5_000


@dataclass
class Recipe:
    """`select` of (rows with label_positive, metadata, reference) gives what is looked for; `features` of
    (repertoires, that) a row a repertoire, with `term_counts` (a vector) if it has a vocabulary; `model` its last stage;
    `rank` of (rows with label_positive, fitted, reference) the sequences of its training repertoires, best first."""

    select: Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame]
    features: Callable[[DataFrame, DataFrame], DataFrame]
    model: Callable[[], object]
    rank: Callable[[DataFrame, Fitted, DataFrame | None], DataFrame]
    degree: int = 1
    balanced: bool = False
    calibrated: bool = False


def _lr() -> LogisticRegression:
    return LogisticRegression(regParam=0.01, standardization=False, maxIter=50, weightCol="weight")


def _gbt() -> GBTClassifier:
    return GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=42, weightCol="weight")


def _top(scored: DataFrame, score: str, key: str, n: int = TERMS) -> DataFrame:
    return scored.orderBy(F.desc(F.round(score, 9)), key).limit(n).select(F.col(key).alias("term"))


def _tokens(rep: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The gapped tokens of repertoires, or those of `wanted` (term): (repertoire_id, same), with repeats, and (term,
    same). Tokens that the same sequences have are in the same repertoires, so that one of them, `same`, stands for all;
    their sets of sequences are told apart by their sizes and 128 bits. Masks are laid over distinct sequences only.

    Sequences are dealt by range of repertoire and sequence, so that a task drops repeats and none holds a large one."""
    held = store.stored(rep.select("repertoire_id", "junction_aa").where("junction_aa is not null").distinct().repartitionByRange("repertoire_id", "junction_aa"))
    seqs = store.stored(held.select("junction_aa").distinct())
    each = seqs.select("junction_aa", F.explode(F.array_distinct(S.gapped_tokens(F.col("junction_aa")))).alias("term"))
    if wanted is not None:
        each = each.join(E.small(wanted.select("term")), "term", "left_semi")
    sets = each.groupBy("term").agg(F.bit_xor(F.xxhash64("junction_aa")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "junction_aa")).alias("y"), F.count("*").alias("n"))
    # a set has no more tokens than one of its sequences
    named = store.stored(sets.select("term", F.min("term").over(Window.partitionBy("x", "y", "n")).alias("same")))
    members = each.join(named.where(F.col("term") == F.col("same")).select("term"), "term", "left_semi")
    return held.join(E.small(members.select("junction_aa", F.col("term").alias("same"))), "junction_aa").select("repertoire_id", "same"), named


def _chosen_tokens(rows: DataFrame, meta: DataFrame, reference: DataFrame | None) -> DataFrame:
    held, named = _tokens(rows)
    counts = C.row_counts(held.distinct().join(meta, "repertoire_id"), "same").where(F.col("pos_count") + F.col("neg_count") >= 2)
    return _top(E.chi2_scores(counts.join(named, "same"), E.class_sizes(meta), "term"), "chi2", "term")


def _token_terms(rep: DataFrame, chosen: DataFrame) -> DataFrame:
    """Which of the chosen tokens each repertoire has, as a vector by their places."""
    held, named = _tokens(rep, chosen)
    places = E.small(named.join(chosen, "term").groupBy("same").agg(F.collect_list("place").alias("some")))
    each = held.groupBy("repertoire_id").agg(F.collect_set("same").alias("same")).select("repertoire_id", F.explode("same").alias("same"))
    got = each.join(places, "same").groupBy("repertoire_id").agg(F.flatten(F.collect_list("some")).alias("places"))
    return _vectors(rep, got.withColumn("counts", F.transform("places", lambda _: F.lit(1.0))), chosen)


#: Places of a vocabulary, at most, for which vectors are first made with all their zeros; rows of such at a time; and
#: numbers of vectors that one task makes, about, and a model's task then reads.
DENSE, ROWS, NUMBERS = 10_000, 256, 4_000_000


def _filled(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                places, counts = part.column("places"), part.column("counts")
                lengths = pa.compute.fill_null(pa.compute.list_value_length(places), 0).to_numpy(zero_copy_only=False)
                values = np.zeros((part.num_rows, size))
                values[np.repeat(np.arange(part.num_rows), lengths), places.flatten().to_numpy()] = counts.flatten().to_numpy()
                whole = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * size, pa.int32()), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("repertoire_id"), whole], names=["repertoire_id", "counts"])

    return run


@F.udf(VectorUDT())
def _sparse(size, places, counts):
    return SparseVector(size, dict(zip(places or [], counts or [], strict=True)))


def _vectors(rep: DataFrame, got: DataFrame, chosen: DataFrame) -> DataFrame:
    """The (places, counts) of each repertoire as a vector, sparse where that is shorter; none for one without any."""
    size = max(chosen.count(), 1)
    ids = store.stored(rep.select("repertoire_id").distinct())
    dealt = ids.repartition(E.tasks_for(ids.count() * size, NUMBERS), "repertoire_id") if size <= DENSE else ids
    whole = dealt.join(got.select("repertoire_id", F.col("places").cast("array<int>").alias("places"), F.col("counts").cast("array<double>").alias("counts")), "repertoire_id", "left")
    if size > DENSE:
        return whole.select("repertoire_id", _sparse(F.lit(size), "places", "counts").alias("term_counts"))
    filled = whole.mapInArrow(_filled(size), f"repertoire_id {dict(rep.dtypes)['repertoire_id']}, counts array<double>").select("repertoire_id", array_to_vector("counts").alias("counts"))
    sized = VectorSizeHint(inputCol="counts", size=size, handleInvalid="optimistic").transform(filled)
    short = VectorAssembler(inputCols=["counts"], outputCol="term_counts").transform(sized)
    return short.select("repertoire_id", F.col("term_counts").alias("term_counts", metadata={}))


def _terms(rep: DataFrame, held: DataFrame, chosen: DataFrame) -> DataFrame:
    """How often each repertoire has each chosen term, as a vector by the terms' places; `held` has a row for each time,
    or for `n` times. Terms are joined: a vocabulary may be as large as a reference set."""
    n = F.sum("n") if "n" in held.columns else F.count("*")
    counts = held.join(chosen, "term").groupBy("repertoire_id", "place").agg(n.alias("n"))
    got = counts.groupBy("repertoire_id").agg(F.collect_list(F.struct("place", "n")).alias("found"))
    return _vectors(rep, got.select("repertoire_id", F.col("found.place").alias("places"), F.col("found.n").alias("counts")), chosen)


def _sequences(rep: DataFrame) -> DataFrame:
    return rep.select("repertoire_id", F.col("junction_aa").alias("term"))


def _reference(rows: DataFrame, meta: DataFrame, reference: DataFrame | None) -> DataFrame:
    if reference is None:
        raise ValueError("this recipe needs a reference set of sequences")
    return reference.select(F.col("junction_aa").alias("term")).distinct()


def _patterns(ks: tuple[int, ...], gaps: bool, strict: bool) -> Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame]:
    def select(rows: DataFrame, meta: DataFrame, reference: DataFrame | None) -> DataFrame:
        counts, sizes = store.stored(E.pattern_counts(rows, ks, gaps)), E.class_sizes(meta)
        return (E.select_strict if strict else E.select_fdr)(counts, sizes).select("k", "kmer")

    return select


def _pattern_features(ks: tuple[int, ...], gaps: bool) -> Callable[[DataFrame, DataFrame], DataFrame]:
    def features(rep: DataFrame, patterns: DataFrame) -> DataFrame:
        counts = E.pattern_counts(rep.withColumn("label_positive", F.lit(None).cast("boolean")), ks, gaps)
        return E.widened(E.pattern_features(counts, patterns, rep.select("repertoire_id").distinct(), ks), ks)

    return features


def _differential(rows: DataFrame, meta: DataFrame, reference: DataFrame | None) -> DataFrame:
    return E.differential(C.presence_counts(rows, "junction_aa"), E.class_sizes(meta)).select(F.col("junction_aa").alias("term"))


def _with_diversity(rep: DataFrame, chosen: DataFrame) -> DataFrame:
    return _terms(rep, _sequences(rep).distinct(), chosen).join(learned.repertoire_features(rep), "repertoire_id")


def _composition(rep: DataFrame, chosen: DataFrame) -> DataFrame:
    # equal sequences of a repertoire are cut once and weighed
    counted = store.stored(rep.groupBy("repertoire_id", "junction_aa").agg(F.count("*").alias("n")))
    words = counted.select("repertoire_id", "n", F.explode(S.kmers(F.col("junction_aa"), 3)).alias("term"))
    lengths, letters = D.length_histogram(counted, list(range(5, 26)), 100, F.col("n")), D.composition(counted, F.col("n"))
    return _terms(counted, words, chosen).join(lengths, "repertoire_id", "left").join(learned.repertoire_features(rep), "repertoire_id", "left").join(letters, "repertoire_id", "left").na.fill(0.0)


def _graph(rep: DataFrame, chosen: DataFrame) -> DataFrame:
    nodes, links = map(store.stored, G.built(rep, 5))
    long = G.pooled(G.node_features(nodes, links, k=5), links).withColumn("feature", F.format_string("g%03d", "dim"))
    wide = D.pinned(long.select("repertoire_id", "feature", F.col("mean").alias("value")), [f"g{i:03d}" for i in range(59)])
    return rep.select("repertoire_id").distinct().join(wide, "repertoire_id", "left").join(learned.repertoire_features(rep), "repertoire_id", "left").na.fill(0.0)


def _nothing(rows: DataFrame, meta: DataFrame, reference: DataFrame | None) -> DataFrame:
    return rows.select(F.col("junction_aa").alias("term")).limit(0)


def _all_words(rows: DataFrame, meta: DataFrame, reference: DataFrame | None) -> DataFrame:
    counted = rows.groupBy("junction_aa").agg(F.count("*").alias("n"))
    words = counted.select("n", F.explode(S.kmers(F.col("junction_aa"), 3)).alias("term")).where(F.col("term").rlike(f"^[{S.ALPHABET}]+$")).groupBy("term").agg(F.sum("n").cast("double").alias("n"))
    return _top(words, "n", "term", 8_000)


def _diversity(rep: DataFrame, chosen: DataFrame) -> DataFrame:
    found = C.reference_diversity(rep, chosen.select(F.col("term").alias("junction_aa")))
    return found.select("repertoire_id", F.log1p(F.col("reference_diversity").cast("double")).alias("hits"))


def _needed(reference: DataFrame | None, fitted: Fitted) -> DataFrame:
    return fitted.chosen.select(F.col("term").alias("junction_aa")) if reference is None else reference


def _rank_density(rows: DataFrame, fitted: Fitted, reference: DataFrame | None) -> DataFrame:
    return rankings.by_density(rows, fitted.chosen, R.pattern_weights(fitted.weights().where("feature is not null"), (3, 4, 5)))


RECIPES: dict[str, Recipe] = {
    "reference": Recipe(_reference, _diversity, _lr, lambda rows, f, reference: rankings.by_sets(rows, [(_needed(reference, f), 1.0)]), degree=2, calibrated=True),
    "composition": Recipe(_all_words, _composition, _gbt, lambda rows, f, reference: rankings.by_sets(rows, [(rows.select("junction_aa").limit(0), 1.0)])),
    "tokens": Recipe(_chosen_tokens, _token_terms, _gbt, lambda rows, f, reference: rankings.by_tokens(rows, f.term_importance().withColumnRenamed("term", "token"))),
    "vocabulary": Recipe(_reference, lambda rep, chosen: _terms(rep, _sequences(rep), chosen), _lr, lambda rows, f, reference: rankings.by_vocabulary(rows, f.term_importance(), _needed(reference, f))),
    "patterns": Recipe(_patterns((3, 4, 5, 6), True, True), _pattern_features((3, 4, 5, 6), True), _gbt, lambda rows, f, reference: rankings.by_longest(rows, f.chosen)),
    "patterns_fdr": Recipe(_patterns((3, 4, 5), False, False), _pattern_features((3, 4, 5), False), _lr, _rank_density),
    "differential": Recipe(_differential, _with_diversity, _gbt, lambda rows, f, reference: rankings.by_bonus(rows, f.chosen), balanced=True),
    "graph": Recipe(_nothing, _graph, _lr, lambda rows, f, reference: rankings.by_templates(rows)),
}
#: The recipe of each dataset number.
BY_NUMBER = {1: "reference", 2: "tokens", 3: "vocabulary", 4: "patterns", 5: "patterns_fdr", 6: "vocabulary", 7: "differential", 8: "graph"}


def _steady(rows: DataFrame) -> DataFrame:
    """Features to nine places: sums in another order differ beyond."""
    return rows.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes])


def _varied(data: DataFrame, names: list[str]) -> list[str]:
    """The features that are not constant but for rounding; dividing by such a deviation would leave nothing but noise."""
    stats = data.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(names) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return [c for i, c in enumerate(names) if (stats[f"s{i}"] or 0) > 1e-9 * max(1.0, abs(stats[f"m{i}"] or 0))]


def _probability(model: PipelineModel, rows: DataFrame, *kept: str) -> DataFrame:
    return model.transform(rows).select(*kept, F.get(vector_to_array("probability"), F.lit(1)).alias("probability"))


def _calibrated(scored: DataFrame, model: IsotonicRegressionModel | None) -> DataFrame:
    if model is None:
        return scored
    return model.transform(scored).withColumn("probability", F.col("prediction")).drop("prediction")


def _calibration(pipeline: Pipeline, data: DataFrame, meta: DataFrame, folds: int = 5) -> IsotonicRegressionModel | None:
    """Probabilities made isotonic by those that models without a repertoire's fold gave it; none where a class is
    missing in some of them."""
    dealt = store.stored(data.join(P.folds(meta, folds).select("repertoire_id", "fold"), "repertoire_id"))
    parts = []
    for k in range(folds):
        if dealt.where(F.col("fold") != k).select("label").distinct().count() < 2:
            return None
        parts.append(_probability(pipeline.fit(dealt.where(F.col("fold") != k)), dealt.where(F.col("fold") == k), "label", "weight"))
    return IsotonicRegression(featuresCol="probability", labelCol="label", weightCol="weight").fit(store.stored(reduce(DataFrame.unionByName, parts)))


@dataclass
class Fitted:
    """A recipe with what it selected and its fitted stages."""

    recipe: str
    chosen: DataFrame
    model: PipelineModel
    calibration: IsotonicRegressionModel | None = None

    def score(self, rep: DataFrame) -> DataFrame:
        """(repertoire_id, probability) of repertoires, new ones or those it was fitted on."""
        rows = _steady(RECIPES[self.recipe].features(rep, self.chosen))
        return _calibrated(_probability(self.model, rows, "repertoire_id"), self.calibration)

    def weights(self) -> DataFrame:
        """(feature, coefficient) of the model's features that have a weight: coefficients of a regression or shares of
        trees; a term's feature is `term_counts` and its place."""
        model, inputs = self.model.stages[-1], next(s for s in self.model.stages if isinstance(s, VectorAssembler)).getInputCols()
        values = (model.featureImportances if hasattr(model, "featureImportances") else model.coefficients).toArray()
        named = [c for c in inputs if c != "term_counts"]
        rows = [(named[i] if i < len(named) else None, i - len(named), float(v)) for i, v in enumerate(values) if v]
        return self.chosen.sparkSession.createDataFrame([(c, p if c is None else None, v) for c, p, v in rows], "feature string, place long, coefficient double")

    def term_importance(self) -> DataFrame:
        """(term, importance) of terms that the model weighs."""
        return self.chosen.join(self.weights().where("place is not null"), "place").select("term", F.abs("coefficient").alias("importance"))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        self.chosen.write.mode("overwrite").parquet(f"{path}/chosen")
        if self.calibration:
            self.calibration.write().overwrite().save(f"{path}/calibration")
        store.write_about(self.chosen.sparkSession, {"recipe": self.recipe, "n_chosen": self.chosen.count(), "calibrated": self.calibration is not None}, f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Fitted:
        about = store.read_about(spark, f"{path}/about")
        calibration = IsotonicRegressionModel.load(f"{path}/calibration") if about.get("calibrated") else None
        return Fitted(about["recipe"], spark.read.parquet(f"{path}/chosen"), PipelineModel.load(f"{path}/model"), calibration)


def fit(recipe: str, rep: DataFrame, meta: DataFrame, reference: DataFrame | None = None) -> Fitted:
    """Select, make features and fit. Repertoires without a label are not looked at; a balanced recipe takes so many of
    the larger class that the smaller is half of it."""
    plan = RECIPES[recipe]
    meta = meta.where("label_positive is not null")
    if plan.balanced:
        meta = P.undersampled(meta)
    meta = store.stored(meta.select("repertoire_id", "label_positive"))
    rows = C.labelled(rep, meta)
    chosen = plan.select(rows, meta, reference)
    chosen = store.stored(C.vocabulary_index(chosen, "term") if "term" in chosen.columns else chosen)
    data = _steady(plan.features(rep.join(meta.select("repertoire_id"), "repertoire_id", "left_semi"), chosen)).join(meta, "repertoire_id").withColumn("label", F.col("label_positive").cast("double")).drop("label_positive")
    n, positive = meta.agg(F.count("*"), F.count_if("label_positive")).first()
    weight: Column = F.when(F.col("label") == 1, n / (2 * max(positive, 1))).otherwise(n / (2 * max(n - positive, 1)))
    data = store.stored(data.withColumn("weight", weight))
    stages, parts = [], [c for c, kind in data.dtypes if kind in ("double", "bigint", "int") and c not in ("repertoire_id", "label", "weight")]
    parts = (_varied(data, parts) or parts[:1]) if parts else parts
    if "term_counts" in data.columns:
        parts.append("term_counts")
    stages.append(VectorAssembler(inputCols=parts, outputCol="raw"))
    if plan.degree > 1:
        stages.append(PolynomialExpansion(degree=plan.degree, inputCol="raw", outputCol="powers"))
    # without a mean, so that counts stay sparse
    stages.append(StandardScaler(inputCol="powers" if plan.degree > 1 else "raw", outputCol="features"))
    pipeline = Pipeline(stages=[*stages, plan.model()])
    return Fitted(recipe, chosen, pipeline.fit(data), _calibration(pipeline, data, meta) if plan.calibrated else None)


def ranked(fitted: Fitted, rep: DataFrame, meta: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """The sequences of labelled repertoires as the fitted recipe ranks them."""
    return RECIPES[fitted.recipe].rank(C.labelled(rep, meta.where("label_positive is not null").select("repertoire_id", "label_positive")), fitted, reference)


def ensemble(parts: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """The weighted mean of scored repertoires, joined by id; equal weights by default."""
    weights = weights or [1 / len(parts)] * len(parts)
    whole = parts[0].select("repertoire_id", (F.col("probability") * weights[0]).alias("w"))
    for part, weight in zip(parts[1:], weights[1:], strict=True):
        whole = whole.unionByName(part.select("repertoire_id", (F.col("probability") * weight).alias("w")))
    return whole.groupBy("repertoire_id").agg(F.sum("w").alias("probability"))


def _query(recipe: str) -> Callable[[SparkSession, str], DataFrame]:
    """Fitted on the training split of the suppliers, stored, read again and applied to the test split."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rep, split = A.clone_repertoire(spark, sf_dir), P.stratified_split(A.clone_metadata(spark, sf_dir))
        reference = A.table(spark, sf_dir, "part").where("p_partkey % 7 = 0").select(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("junction_aa")).distinct()
        fitted = fit(recipe, rep, split.where(~F.col("is_test")).drop("is_test"), reference)
        store.stored(spark.range(0))
        path = f"{spark.sparkContext.getCheckpointDir()}/model_{recipe}_{uuid.uuid4()}"
        fitted.save(path)
        test = split.where("is_test").select("repertoire_id")
        return Fitted.load(spark, path).score(rep.join(test, "repertoire_id", "left_semi"))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"pipeline_{name}": _query(name) for name in RECIPES}


def report(scored: DataFrame, meta: DataFrame) -> DataFrame:
    """The classification report of scores at the threshold with the largest J, with that threshold."""
    rows = store.stored(scored.join(meta, "repertoire_id").select(F.col("probability").alias("score"), F.col("label_positive").cast("int").alias("label")))
    threshold = V.youden_threshold(rows).first()["threshold"]
    return V.classification_report(rows, threshold).withColumn("threshold", F.lit(threshold))
