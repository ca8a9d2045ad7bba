"""Second-order gradient boosting on histograms: many models, such as all folds and settings, from the same passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoscope.plans import learned
from clonoscope.sources.store import stored

#: Bins of a feature, features of a shuffled piece of a histogram, and trees after which margins are stored.
BINS, CHUNK, REFRESH = 32, 256, 10


@dataclass(frozen=True)
class Setting:
    """One model: rows of fold `without` are not learnt from. `l2` and `l1` penalise leaves, `positive` weighs the
    positive class, `rows` and `columns` are the shares that a tree sees, `least` the Hessian that a child needs."""

    without: int = -1
    rate: float = 0.1
    depth: int = 3
    l2: float = 1.0
    l1: float = 0.0
    gamma: float = 0.0
    least: float = 1.0
    positive: float = 1.0
    rows: float = 1.0
    columns: float = 1.0


@dataclass
class Tree:
    """A full binary tree as arrays: what a node asks (feature -1: nothing, a leaf), up to which bin a row goes left, a
    node's value and the gain of its split."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = (1 << depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n))

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The node at which each row ends."""
        at = np.zeros(len(bins), dtype=np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            asked = self.feature[at]
            right = bins[np.arange(len(bins)), np.maximum(asked, 0)] > self.bin[at]
            at = np.where(asked >= 0, 2 * at + 1 + right, at)
        return at


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def leaf(g: float, h: float, s: Setting) -> float:
    return float(-shrunk(np.array(g), s.l1) / (h + s.l2)) if h + s.l2 > 0 else 0.0


def gains(g: np.ndarray, h: np.ndarray, s: Setting) -> np.ndarray:
    """The gain of splitting after each bin of each feature (a row), -inf where a child is too light."""
    left_g, left_h = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
    right_g, right_h = left_g[:, -1:] - left_g, left_h[:, -1:] - left_h
    part = lambda a, b: shrunk(a, s.l1) ** 2 / np.maximum(b + s.l2, 1e-12)
    gain = 0.5 * (part(left_g, left_h) + part(right_g, right_h) - part(left_g[:, -1:], left_h[:, -1:])) - s.gamma
    return np.where((left_h >= s.least) & (right_h >= s.least), gain, -np.inf)


def _seen(names: np.ndarray, tree: int, share: float) -> np.ndarray:
    """The rows that a tree sees, by their name."""
    mixed = (names.view(np.uint64) ^ np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(11)).astype(float) / (1 << 53) < share


def _columns(n: int, model: int, tree: int, share: float) -> np.ndarray:
    """The features that a tree sees."""
    some = np.zeros(n, dtype=bool)
    some[np.random.default_rng((42, model, tree)).choice(n, max(1, round(n * share)), replace=False)] = True
    return some


def _bins(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)


def _margins(batch: pa.RecordBatch, bins: np.ndarray, settings: list[Setting], pending: list[list[Tree]]) -> np.ndarray:
    out = batch.column("margins").flatten().to_numpy().reshape(batch.num_rows, len(settings)).copy()
    for m, (s, trees) in enumerate(zip(settings, pending, strict=True)):
        for t in trees:
            out[:, m] += s.rate * t.value[t.places(bins)]
    return out


def _histograms(settings: list[Setting], pending: list[list[Tree]], current: list[Tree], level: int, tree: int, n: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of gradients and Hessians by model, node of the level, feature and bin, summed within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _bins(batch)
            margins = _margins(batch, bins, settings, pending)
            label, fold, names = (batch.column(c).to_numpy() for c in ("label", "fold", "name"))
            for m, s in enumerate(settings):
                p = 0.5 * (1 + np.tanh(margins[:, m] / 2))
                weight = np.where(label == 1, s.positive, 1.0)
                at = current[m].places(bins)
                used = (fold != s.without) & _seen(names, tree, s.rows) & (at >= (1 << level) - 1)
                for node in np.unique(at[used]).tolist() if level < s.depth else []:
                    own = used & (at == node)
                    codes = (bins[own] + np.arange(n) * width).ravel()
                    found = [np.bincount(codes, weights=np.repeat(v[own], n), minlength=n * width) for v in (weight * (p - label), weight * p * (1 - p))]
                    sums[m, node] = sums.get((m, node), 0) + np.stack(found)
        for (m, node), s in sums.items():
            for begin in range(0, n, CHUNK):
                part = s[:, begin * width : (begin + CHUNK) * width].ravel()
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([node], pa.int32()), pa.array([begin], pa.int32()), pa.array([part.tolist()], pa.list_(pa.float64()))], names=["model", "node", "begin", "sums"])

    return run


def _best(settings: list[Setting], tree: int, n: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best split of each node among the features of each piece, once a piece's parts have met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for m, node, begin, part in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                own = part.values.to_numpy()
                sums[m, node, begin] = sums[m, node, begin] + own if (m, node, begin) in sums else own
        rows = []
        for (m, node, begin), s in sums.items():
            g, h = s.reshape(2, -1, width)
            gain = np.round(gains(g, h, settings[m]), 9)
            gain[~_columns(n, m, tree, settings[m].columns)[begin : begin + CHUNK]] = -np.inf
            f, b = np.unravel_index(int(gain.argmax()), gain.shape)
            rows.append((m, node, begin + int(f), int(b), float(gain[f, b]), float(g[f, : b + 1].sum()), float(h[f, : b + 1].sum()), float(g[f].sum()), float(h[f].sum())))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["model", "node", "feature", "bin", "gain", "g", "h", "all_g", "all_h"])

    return run


_BEST = "model long, node long, feature long, bin long, gain double, g double, h double, all_g double, all_h double"


def quantile_edges(rows: DataFrame, bins: int = BINS) -> list[list[float]]:
    """Where each feature is cut, by a quantile sketch: a value up to the first edge is in bin 0."""
    at = [i / bins for i in range(1, bins)]
    found = rows.select(F.posexplode("features").alias("f", "v")).groupBy("f").agg(F.percentile_approx("v", F.lit(at), F.lit(10_000)).alias("e")).collect()
    return [sorted(set(r["e"])) for r in sorted(found, key=lambda r: r["f"])]


def binned(rows: DataFrame, edges: list[list[float]], models: int) -> DataFrame:
    """Rows with their features as bytes of bins and a margin of 0 for each model; `id` names a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(edges)) if batch.num_rows else np.empty((0, len(edges)))
            coded = np.empty(values.shape, dtype=np.uint8)
            for k, e in enumerate(edges):
                coded[:, k] = np.searchsorted(e, values[:, k])
            margins = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * models, pa.int32()), pa.array(np.zeros(batch.num_rows * models)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "fold", "name")), pa.array([c.tobytes() for c in coded], pa.binary()), margins], names=["id", "label", "fold", "name", "bins", "margins"])

    kinds = dict(rows.dtypes)
    named = rows.select("id", "features", *[(F.col(c) if c in kinds else F.lit(v)).cast(t).alias(c) for c, t, v in (("label", "double", 0.0), ("fold", "int", 0))], F.xxhash64(F.col("id").cast("string")).alias("name"))
    return named.mapInArrow(run, f"id {kinds['id']}, label double, fold int, name long, bins binary, margins array<double>")


def _refreshed(rows: DataFrame, settings: list[Setting], pending: list[list[Tree]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _margins(batch, _bins(batch), settings, pending) if batch.num_rows else np.empty((0, len(settings)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * len(settings), pa.int32()), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "fold", "name", "bins")), lists], names=["id", "label", "fold", "name", "bins", "margins"])

    return rows.mapInArrow(run, rows.schema)


@dataclass
class Boosted:
    """Models with the edges of their bins."""

    settings: list[Setting]
    edges: list[list[float]]
    trees: list[list[Tree]] = field(default_factory=list)

    def score(self, rows: DataFrame) -> DataFrame:
        """(id, label, fold, probabilities): one probability a model, of rows with id and features."""
        done = _refreshed(binned(rows, self.edges, len(self.settings)), self.settings, self.trees)
        return done.select("id", "label", "fold", F.transform("margins", lambda m: 1 / (1 + F.exp(-m))).alias("probabilities"))

    def importance(self, model: int = 0) -> np.ndarray:
        """Each feature's share of the gain."""
        out = np.zeros(len(self.edges))
        for t in self.trees[model]:
            np.add.at(out, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
        return out / max(out.sum(), 1e-300)


def fit(rows: DataFrame, settings: list[Setting], trees: int = 100, bins: int = BINS) -> Boosted:
    """Boost all models at once: rows have id, features (an array of doubles), label (0 or 1) and fold.

    A level of a tree is one pass for all models: tasks add up gradients and Hessians of their rows by node, feature
    and bin, what they found meets by node and piece of features, and the driver gets the best split of each piece.
    Features are cut where a quantile sketch over all rows says, once; margins are stored every REFRESH trees, and
    between, tasks apply the trees since. Equal gains take the smaller feature and bin."""
    edges = quantile_edges(rows, bins)
    n, width, model = len(edges), bins + 1, Boosted(settings, edges, [[] for _ in settings])
    data = stored(binned(rows, edges, len(settings)))
    pending: list[list[Tree]] = [[] for _ in settings]
    for tree in range(trees if n else 0):
        current = [Tree.empty(s.depth) for s in settings]
        for level in range(max(s.depth for s in settings)):
            parts = data.mapInArrow(_histograms(settings, pending, current, level, tree, n, width), "model int, node int, begin int, sums array<double>")
            best: dict[tuple[int, int], tuple] = {}
            for r in parts.repartition("model", "node", "begin").mapInArrow(_best(settings, tree, n, width), _BEST).collect():
                key, own = (r["model"], r["node"]), (-r["gain"], r["feature"], r["bin"], r)
                best[key] = min(best.get(key, own), own, key=lambda x: x[:3])
            for (m, node), (gain, feature, bin_, r) in best.items():
                t, s = current[m], settings[m]
                if not level:
                    t.value[node] = leaf(r["all_g"], r["all_h"], s)
                if -gain > 1e-9 and np.isfinite(gain):
                    t.feature[node], t.bin[node], t.gain[node] = feature, bin_, -gain
                    t.value[2 * node + 1], t.value[2 * node + 2] = leaf(r["g"], r["h"], s), leaf(r["all_g"] - r["g"], r["all_h"] - r["h"], s)
            if not best:
                break
        for m, t in enumerate(current):
            model.trees[m].append(t)
            pending[m].append(t)
        if len(pending[0]) == REFRESH:
            data, pending = stored(_refreshed(data, settings, pending)), [[] for _ in settings]
    return model


#: What the search tries: the reference's depths and rates.
GRID = [Setting(depth=d, rate=r, rows=0.8, columns=0.8) for d in (3, 5) for r in (0.05, 0.1)]


def as_rows(table: DataFrame, names: tuple[str, ...] = learned.FEATURES) -> DataFrame:
    return table.select(F.col("repertoire_id").alias("id"), F.array(*[F.col(c).cast("double") for c in names]).alias("features"), "label", "fold")


def boosted_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold probabilities of five models, one without each fold, boosted together."""
    rows = stored(as_rows(learned.table_of_features(spark, sf_dir)))
    settings = [Setting(without=k, l1=0.1, rows=0.8, columns=0.8) for k in range(5)]
    scored = fit(rows, settings, trees=30).score(rows)
    return scored.select(F.col("id").alias("repertoire_id"), F.element_at("probabilities", F.col("fold") + 1).alias("probability"))


def boosted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths and rates by their area out of fold; all settings and folds are boosted in the same passes."""
    rows = stored(as_rows(learned.table_of_features(spark, sf_dir)))
    settings = [Setting(k, g.rate, g.depth, rows=g.rows, columns=g.columns) for g in GRID for k in range(5)]
    scored = stored(fit(rows, settings, trees=12).score(rows))
    found = []
    for i, g in enumerate(GRID):
        own = scored.select("label", F.element_at("probabilities", F.col("fold") + 1 + 5 * i).alias("probability"))
        found.append((g.depth, g.rate, learned.area(own)))
    return spark.createDataFrame(found, "depth int, rate double, auc double").orderBy(F.desc("auc"), "depth", "rate")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"boosted_predict": boosted_predict, "boosted_search": boosted_search}
