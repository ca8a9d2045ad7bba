"""Graphs and boosted features together: draw down, build graphs and features, train both, average, and rank."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoscope.operators import counts as C
from clonoscope.operators import graph as G
from clonoscope.operators import sampling as P
from clonoscope.plans import boosting, learned, networks, rankings
from clonoscope.sources import adapters as A
from clonoscope.sources.store import stored


@dataclass
class Ensemble:
    """A graph network and a boosted model of the same repertoires, with their weights in the mean."""

    network: networks.Network
    boosted: boosting.Boosted
    k: int
    target: int
    weights: tuple[float, float] = (0.5, 0.5)

    def score(self, rep: DataFrame, order: list[str], folders: list[str] | None = None) -> DataFrame:
        """(repertoire_id, probability) of repertoires; the boosted model's alone for one without a graph."""
        rows, nodes, links = prepared(rep, order, self.k, self.target, folders)
        graphs = self.network.score(nodes, links).withColumnRenamed("probability", "g")
        trees = self.boosted.score(features(rows)).select(F.col("id").alias("repertoire_id"), F.element_at("probabilities", 1).alias("b"))
        a, b = self.weights
        mean = F.when(F.col("g").isNull(), F.col("b")).otherwise((a * F.col("g") + b * F.col("b")) / (a + b))
        return trees.join(graphs, "repertoire_id", "left").select("repertoire_id", mean.alias("probability"))


def prepared(rep: DataFrame, order: list[str], k: int, target: int, folders: list[str] | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repertoires drawn down to so many templates, and the nodes and edges of their graphs."""
    rows = stored(P.downsampled(rep.withColumn("templates", F.coalesce(F.col("templates").cast("long"), F.lit(1))), order, target))
    nodes, links = G.built(rows, k, folders=folders)
    return rows, stored(nodes), stored(links)


def features(rows: DataFrame) -> DataFrame:
    return learned.repertoire_features(rows).select(F.col("repertoire_id").alias("id"), F.array(*[F.col(c).cast("double") for c in learned.FEATURES]).alias("features"))


def fit(rep: DataFrame, meta: DataFrame, order: list[str], k: int = 30, target: int = 10_000, trees: int = 100, epochs: int = 100, rate: float = 0.01, folders: list[str] | None = None) -> Ensemble:
    """Both models of labelled repertoires (repertoire_id, label_positive). A fifth of each class validates the network;
    boosting weighs the positive class by the classes' sizes. `folders` keep the graphs."""
    meta = stored(meta.where("label_positive is not null").select("repertoire_id", "label_positive"))
    rows, nodes, links = prepared(rep.join(meta, "repertoire_id", "left_semi"), order, k, target, folders)
    network = networks.train(nodes, links, P.stratified_split(meta).withColumnRenamed("is_test", "is_validation"), epochs=epochs, rate=rate)
    n, positive = meta.agg(F.count("*"), F.count_if("label_positive")).first()
    labels = meta.select(F.col("repertoire_id").alias("i"), F.col("label_positive").cast("double").alias("label"))
    data = stored(features(rows).join(labels, F.col("id") == F.col("i")).drop("i"))
    setting = boosting.Setting(rows=0.8, columns=0.8, positive=max(n - positive, 1) / max(positive, 1))
    return Ensemble(network, boosting.fit(data, [setting], trees), k, target)


def ranked(rep: DataFrame, meta: DataFrame, order: list[str], target: int = 10_000) -> DataFrame:
    """The sequences of repertoires drawn down, by the log fold change of their templates."""
    rows = P.downsampled(rep.withColumn("templates", F.coalesce(F.col("templates").cast("long"), F.lit(1))), order, target)
    return rankings.by_templates(C.labelled(rows, meta.where("label_positive is not null").select("repertoire_id", "label_positive")))


_ORDER = ["l_orderkey", "l_linenumber", "junction_aa"]


def graph_ensemble_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the suppliers' training split, applied to the test split."""
    rep, split = A.clone_repertoire(spark, sf_dir), stored(P.stratified_split(A.clone_metadata(spark, sf_dir)))
    model = fit(rep, split.where(~F.col("is_test")), _ORDER, k=5, trees=12, epochs=6, rate=0.02)
    return model.score(rep.join(split.where("is_test").select("repertoire_id"), "repertoire_id", "left_semi"), _ORDER)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "graph_ensemble_predict": graph_ensemble_predict,
    "graph_ensemble_rank": lambda spark, d: ranked(A.clone_repertoire(spark, d), A.clone_metadata(spark, d), _ORDER),
}
