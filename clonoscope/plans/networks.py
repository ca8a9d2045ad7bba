"""Trained graph convolutions: whole graphs are classified, and gradients flow back over the same edge table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoscope.operators import graph as G
from clonoscope.operators import sampling as P
from clonoscope.sources import adapters as A
from clonoscope.sources.store import stored

#: Partial gradients that the driver adds up; more are first added in tasks.
PARTS = 16
#: Probabilities are told apart to so many steps for the area under the curve.
STEPS = 10_000

Parameters = dict[str, np.ndarray]


def _names(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(n)]


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names]) if batch.num_rows else np.empty((0, len(names)))


def _rows(batch: pa.RecordBatch, keys: list[str], prefix: str, values: np.ndarray) -> pa.RecordBatch:
    """The batch's keys with a matrix as columns."""
    names = _names(prefix, values.shape[1])
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(np.ascontiguousarray(values[:, i])) for i in range(values.shape[1]))], names=[*keys, *names])


def _schema(df: DataFrame, keys: list[str], prefix: str, n: int) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{c} double" for c in _names(prefix, n))])


def edge_weights(nodes: DataFrame, links: DataFrame, how: str = "gcn") -> DataFrame:
    """(repertoire_id, src, dst, w): what flows from dst into src in one step, each node its own neighbour too. `gcn`
    weighs by 1 / sqrt(d d'), `mean` by 1 / d, `sum` (graph isomorphism networks) by 1; parallel edges add up."""
    if how not in ("gcn", "mean", "sum"):
        raise ValueError(f"unknown weights: {how}")
    loops = nodes.select("repertoire_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    whole = links.select("repertoire_id", "src", "dst").unionByName(loops).groupBy("repertoire_id", "src", "dst").agg(F.count("*").alias("m"))
    deg = whole.groupBy("repertoire_id", "src").agg(F.sum("m").alias("d"))
    other = deg.select("repertoire_id", F.col("src").alias("dst"), F.col("d").alias("d2"))
    both = whole.join(deg, ["repertoire_id", "src"]).join(other, ["repertoire_id", "dst"])
    weight = {"gcn": F.col("m") / F.sqrt(F.col("d") * F.col("d2")), "mean": F.col("m") / F.col("d"), "sum": F.col("m").cast("double")}[how]
    return both.select("repertoire_id", "src", "dst", weight.alias("w"))


def standards(nodes: DataFrame) -> list[tuple[float, float]]:
    """The mean and deviation of each feature."""
    dims = nodes.select(F.max(F.size("x"))).first()[0] or 0
    stats = nodes.agg(*[f(F.get("x", F.lit(i))).alias(f"{n}{i}") for i in range(dims) for n, f in (("m", F.avg), ("s", F.stddev_pop))] or [F.lit(0)]).first()
    return [(stats[f"m{i}"], stats[f"s{i}"]) for i in range(dims)]


def _varies(mean: float, deviation: float) -> bool:
    return bool(deviation and deviation > 1e-9 * max(1.0, abs(mean)))


@dataclass
class Graphs:
    """Graphs made ready for training: `edges` (v, from, to, rep, w) between numbered nodes, dealt by where a state
    comes from, and `first`, the nodes' features after the first step, which no parameter changes."""

    edges: DataFrame
    first: DataFrame
    dims: int

    @staticmethod
    def of(nodes: DataFrame, links: DataFrame, how: str = "gcn", scale: list[tuple[float, float]] | None = None) -> tuple[Graphs, list[tuple[float, float]]]:
        """Features are standardised by `scale`, or by these nodes; a feature that is constant but for rounding is 0."""
        numbers = stored(nodes.select("repertoire_id", "node_id", "x", F.monotonically_increasing_id().alias("v")))
        scale = standards(numbers) if scale is None else scale
        scaled = [(F.round((F.get("x", F.lit(i)) - m) / s, 9) if _varies(m, s) else F.lit(0.0)).alias(f"x{i}") for i, (m, s) in enumerate(scale)]
        states = numbers.select("v", F.col("repertoire_id").alias("rep"), *scaled)
        ends = lambda c: numbers.select("repertoire_id", F.col("node_id").alias(c), F.col("v").alias(f"v_{c}"))
        weights = edge_weights(nodes, links, how).join(ends("src"), ["repertoire_id", "src"]).join(ends("dst"), ["repertoire_id", "dst"])
        edges = stored(weights.select(F.col("v_dst").alias("source"), F.col("v_src").alias("target"), F.col("repertoire_id").alias("rep"), "w").repartition("source"))
        return Graphs(edges, stored(passed(states, edges, "source", "target", "x", len(scale))), len(scale)), scale


def packs(nodes: DataFrame, links: DataFrame, labels: DataFrame | None, how: str, scale: list[tuple[float, float]], block: int = G.BLOCK) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """Graphs of one block, some to a row: `reps`, where the nodes of each begin, their labels (null: unknown) and
    whether they are learnt from, edges between places of nodes, by target, and `first` as Graphs has it; and (nodes,
    links) of larger ones, if any."""
    kind = dict(nodes.dtypes)["repertoire_id"]
    ends = links.select("repertoire_id", "src", "dst", F.lit(None).cast("double").alias("label"), F.lit(None).cast("double").alias("learnt"))
    if labels is not None:
        none = F.lit(None).cast(dict(links.dtypes)["src"])
        ends = ends.unionByName(labels.select(F.col("rep").alias("repertoire_id"), none.alias("src"), none.alias("dst"), "label", "learnt"))
    wanted = nodes.select("repertoire_id", "node_id", F.col("x").cast("array<double>").alias("x"))
    (own, ends), larger = G.packed(nodes, wanted, ends, block=block)
    schema = f"reps array<{kind}>, begins array<long>, label array<double>, learnt array<double>, source array<long>, target array<long>, w array<double>, first binary"
    rows = own.groupBy("pack").cogroup(ends.groupBy("pack")).applyInArrow(_packed(how, scale), schema)
    return rows, (larger[0], larger[1].where("src is not null").select("repertoire_id", "src", "dst")) if larger else None


def _flow(w: np.ndarray, source: np.ndarray, target: np.ndarray, states: np.ndarray) -> np.ndarray:
    """Each node's weighted sum of the states that flow to it; edges are by target, and each node is one."""
    return np.add.reduceat(w[:, None] * states[source], np.flatnonzero(np.diff(target, prepend=-1)), axis=0)


def _row_kinds(rep: pa.DataType) -> dict[str, pa.DataType]:
    whole, real = pa.list_(pa.int64()), pa.list_(pa.float64())
    return {"reps": pa.list_(rep), "begins": whole, "label": real, "learnt": real, "source": whole, "target": whole, "w": real, "first": pa.binary()}


def _packed(how: str, scale: list[tuple[float, float]]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(nodes: pa.Table, ends: pa.Table) -> pa.Table:
        told = ends.filter(pa.compute.is_null(ends.column("src")))
        known = {r: (a, b) for r, a, b in zip(*(told.column(c).to_pylist() for c in ("repertoire_id", "label", "learnt")), strict=True)}
        nodes, begins, s, d = G.coded(nodes, ends.filter(pa.compute.is_valid(ends.column("src"))))
        n = nodes.num_rows
        if not n:
            return pa.table({c: pa.array([], t) for c, t in _row_kinds(nodes.schema.field("repertoire_id").type).items()})
        codes, m = np.unique(np.append(s, np.arange(n)) * n + np.append(d, np.arange(n)), return_counts=True)
        s, d = codes // n, codes % n
        deg = np.bincount(s, weights=m, minlength=n)
        w = {"gcn": m / np.sqrt(deg[s] * deg[d]), "mean": m / deg[s], "sum": m.astype(float)}[how]
        x = G.vectors(nodes)
        x = np.column_stack([np.round((x[:, i] - a) / b, 9) if _varies(a, b) else np.zeros(n) for i, (a, b) in enumerate(scale)]) if scale else np.zeros((n, 0))
        reps = nodes.column("repertoire_id").take(pa.array(begins[:-1])).to_pylist()
        row = {"reps": [reps], "begins": [begins], "label": [[known.get(r, (None, 0.0))[0] for r in reps]], "learnt": [[known.get(r, (None, 0.0))[1] for r in reps]], "source": [d], "target": [s], "w": [w], "first": [_flow(w, d, s, x).tobytes()]}
        return pa.table({c: pa.array(row[c], t) for c, t in _row_kinds(nodes.schema.field("repertoire_id").type).items()})

    return run


def _learnt(parameters: Parameters, n: int, checked: bool | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Forward and back through the graphs of packs: each task's shares of the loss and of the gradient, by part, and how
    many validation graphs (without such, `checked`: known ones) of each class there are at each step of probability.
    With `checked` None, the graphs' probabilities instead."""
    layers = sum(k.startswith("layer") for k in parameters) // 2
    w0, b0, w1, b1 = (parameters[k] for k in ("head0.w", "head0.b", "head1.w", "head1.b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Parameters = {}
        for batch in batches:
            for i in range(batch.num_rows):
                begins, label, learnt, source, target, w = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("begins", "label", "learnt", "source", "target", "w"))
                a = [np.frombuffer(batch.column("first")[i].as_buffer(), dtype=float).reshape(begins[-1], -1)]
                z = []
                for k in range(layers):
                    z.append(a[k] @ parameters[f"layer{k}.w"] + parameters[f"layer{k}.b"])
                    if k < layers - 1:
                        a.append(_flow(w, source, target, np.maximum(z[k], 0)))
                sizes = np.diff(begins)
                pooled = np.add.reduceat(np.maximum(z[-1], 0), begins[:-1], axis=0) / sizes[:, None]
                inner = np.maximum(pooled @ w0 + b0, 0)
                logit = (inner @ w1 + b1)[:, 0]
                p = 0.5 * (1 + np.tanh(logit / 2))
                if checked is None:
                    yield pa.RecordBatch.from_arrays([batch.column("reps")[i].values, pa.array(p)], names=["rep", "p"])
                    continue
                known, y = ~np.isnan(label), np.nan_to_num(label)
                d_logit = np.where(learnt > 0, p - y, 0)[:, None] / max(n, 1)
                d_inner = d_logit @ w1.T * (inner > 0)
                loss = np.where(learnt > 0, np.logaddexp(0, logit) - y * logit, 0).sum() / max(n, 1)
                found = {"head": np.concatenate([[loss], (pooled.T @ d_inner).ravel(), d_inner.sum(axis=0), (inner.T @ d_logit).ravel(), d_logit.sum(axis=0)])}
                change = np.repeat(d_inner @ w0.T / sizes[:, None], sizes, axis=0)
                back = np.argsort(source, kind="stable")
                for k in reversed(range(layers)):
                    change = change * (z[k] > 0)
                    found[f"layer{k}"] = np.concatenate([(a[k].T @ change).ravel(), change.sum(axis=0)])
                    if k:
                        change = _flow(w[back], target[back], source[back], change @ parameters[f"layer{k}.w"].T)
                at, seen = np.floor(p * STEPS + 0.5).astype(int), known & ((learnt == 0) | (not checked))
                found["seen"] = np.concatenate([np.bincount(at[seen], weights=v[seen], minlength=STEPS + 1) for v in (y, 1 - y)])
                for part, values in found.items():
                    sums[part] = sums[part] + values if part in sums else values
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["part", "values"])

    return run


def passed(states: DataFrame, edges: DataFrame, source: str, target: str, prefix: str, n: int) -> DataFrame:
    """Each node's weighted sum of the states that flow to it, as v, rep and columns a0, a1, ...; with source and target
    exchanged, the way back. Sums are combined before they are shuffled, so that a hub brings a row a task."""
    sent = states.drop("rep").join(edges, F.col("v") == F.col(source))
    sums = [F.sum(F.col("w") * F.col(c)).alias(f"a{i}") for i, c in enumerate(_names(prefix, n))]
    return sent.groupBy(F.col(target).alias("to")).agg(F.first("rep").alias("rep"), *sums).withColumnRenamed("to", "v")


def initial(dims: int, hidden: int, layers: int, seed: int = 42) -> Parameters:
    """Uniform weights by the number of their inputs and outputs, and biases of 0."""
    random, out = np.random.default_rng(seed), {}
    sizes = [dims, *[hidden] * layers, max(hidden // 2, 1), 1]
    for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
        name = f"layer{k}" if k < layers else f"head{k - layers}"
        out[f"{name}.w"] = random.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
        out[f"{name}.b"] = np.zeros(b)
    return out


def _activated(w: np.ndarray, b: np.ndarray, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """States of the next layer from sums over neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows(batch, ["v", "rep"], "h", np.maximum(_matrix(batch, _names("a", dims)) @ w + b, 0))

    return run


def _summed(w: np.ndarray, b: np.ndarray, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The last layer's states added up by graph within each batch, with the number of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("rep").dictionary_encode()
            values = np.maximum(_matrix(batch, _names("a", dims)) @ w + b, 0)
            sums = np.zeros((len(coded.dictionary), w.shape[1] + 1))
            np.add.at(sums, coded.indices.to_numpy(zero_copy_only=False), np.column_stack([values, np.ones(len(values))]))
            yield _rows(pa.RecordBatch.from_arrays([coded.dictionary], names=["rep"]), ["rep"], "h", sums)

    return run


def _head(parameters: Parameters, hidden: int, n: int, back: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The graphs' probabilities, and how the mean loss of the `n` learnt graphs changes with a node's last state (that
    graph's own share; 0 for graphs that are not learnt from). With `back`, instead each task's share of the loss and
    of the head's gradient."""
    w0, b0, w1, b1 = (parameters[k] for k in ("head0.w", "head0.b", "head1.w", "head1.b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + w0.size + b0.size + w1.size + b1.size)
        for batch in batches:
            sums = _matrix(batch, _names("h", hidden + 1))
            pooled = sums[:, :hidden] / sums[:, hidden:]
            inner = np.maximum(pooled @ w0 + b0, 0)
            logit = (inner @ w1 + b1)[:, 0]
            p = 0.5 * (1 + np.tanh(logit / 2))
            label, learnt = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("label", "learnt"))
            d_logit = np.where(learnt > 0, p - label, 0)[:, None] / max(n, 1)
            d_inner = d_logit @ w1.T * (inner > 0)
            if back:
                loss = np.where(learnt > 0, np.logaddexp(0, logit) - label * logit, 0).sum() / max(n, 1)
                total += np.concatenate([[loss], (pooled.T @ d_inner).ravel(), d_inner.sum(axis=0), (inner.T @ d_logit).ravel(), d_logit.sum(axis=0)])
            else:
                yield _rows(batch, ["rep", "label", "learnt"], "g", np.column_stack([d_inner @ w0.T / sums[:, hidden:], p]))
        if back:
            yield pa.RecordBatch.from_arrays([pa.array(["head"]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part", "values"])

    return run


def _layer_back(w: np.ndarray, b: np.ndarray, dims: int, upstream: str, name: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Through one layer: each task's share of its gradient, or (without a name) what flows on to its inputs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(w.size + b.size)
        for batch in batches:
            inputs = _matrix(batch, _names("a", dims))
            change = _matrix(batch, _names(upstream, w.shape[1])) * (inputs @ w + b > 0)
            if name is None:
                yield _rows(batch, ["v", "rep"], "d", change @ w.T)
            else:
                total += np.concatenate([(inputs.T @ change).ravel(), change.sum(axis=0)])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part", "values"])

    return run


def _added(parts: DataFrame) -> dict[str, np.ndarray]:
    """The sum of the parts of each name: in a tree, so that the driver gets a few rows however many tasks there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = values.values.to_numpy()
                sums[name] = sums[name] + own if name in sums else own
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["part", "values"])

    rows = parts.coalesce(PARTS).mapInArrow(run, "part string, values array<double>").collect()
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out[r["part"]] = out.get(r["part"], 0) + np.array(r["values"])
    return out


def scored(graphs: Graphs, parameters: Parameters, labels: DataFrame) -> tuple[DataFrame, list[DataFrame], int]:
    """Forward: the graphs' probabilities (last of the columns g), the sums over neighbours that each layer saw, and the
    number of learnt graphs. `labels` has rep, label (0 or 1) and learnt."""
    layers = sum(k.startswith("layer") for k in parameters) // 2
    sums, seen = graphs.first, []
    for k in range(layers):
        seen.append(sums)
        w, b = parameters[f"layer{k}.w"], parameters[f"layer{k}.b"]
        if k < layers - 1:
            states = sums.mapInArrow(_activated(w, b, w.shape[0]), _schema(sums, ["v", "rep"], "h", w.shape[1]))
            sums = passed(states, graphs.edges, "source", "target", "h", w.shape[1]).persist()
    hidden = w.shape[1]
    summed = sums.mapInArrow(_summed(w, b, w.shape[0]), _schema(sums, ["rep"], "h", hidden + 1))
    pooled = summed.groupBy("rep").agg(*[F.sum(c).alias(c) for c in _names("h", hidden + 1)]).join(labels, "rep", "left").na.fill({"label": 0.0, "learnt": 0.0}).persist()
    return pooled, seen, hidden


def _slopes(found: dict[str, np.ndarray], parameters: Parameters) -> Parameters:
    out: Parameters = {}
    for part, values in found.items():
        at = int(part == "head")
        for name in [k for k in parameters if k.startswith(part)]:
            size = parameters[name].size
            out[name] = values[at : at + size].reshape(parameters[name].shape)
            at += size
    return out


def gradients(graphs: Graphs, parameters: Parameters, labels: DataFrame, n: int) -> tuple[float, Parameters, DataFrame]:
    """The mean loss of the learnt graphs, its gradient, and (rep, label, learnt, p)."""
    pooled, seen, hidden = scored(graphs, parameters, labels)
    kinds = _schema(pooled, ["rep", "label", "learnt"], "g", hidden + 1)
    after = pooled.mapInArrow(_head(parameters, hidden, n, False), kinds).persist()
    parts = [pooled.mapInArrow(_head(parameters, hidden, n, True), "part string, values array<double>")]
    flow, on, prefix = after.select("rep", *_names("g", hidden)), "rep", "g"
    for k in reversed(range(len(seen))):
        w, b = parameters[f"layer{k}.w"], parameters[f"layer{k}.b"]
        met = seen[k].join(flow, on)
        parts.append(met.mapInArrow(_layer_back(w, b, w.shape[0], prefix, f"layer{k}"), "part string, values array<double>"))
        if k:
            inputs = met.mapInArrow(_layer_back(w, b, w.shape[0], prefix, None), _schema(met, ["v", "rep"], "d", w.shape[0]))
            back = passed(inputs, graphs.edges, "target", "source", "d", w.shape[0])
            flow, on, prefix = back.select("v", *[F.col(f"a{i}").alias(f"u{i}") for i in range(w.shape[0])]), "v", "u"
    found = _added(reduce(DataFrame.unionByName, parts))
    out = _slopes(found, parameters)
    result = stored(after.select("rep", "label", "learnt", F.col(f"g{hidden}").alias("p")))
    for held in (pooled, after, *seen[1:]):
        held.unpersist()
    return float(found["head"][0]), out, result


def steps(rows: DataFrame) -> np.ndarray:
    """How many of (label, p) of each class are at each step of probability, positives first."""
    out = np.zeros((2, STEPS + 1))
    for r in rows.groupBy(F.round(F.col("p") * STEPS).cast("int").alias("s")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).collect():
        out[:, r["s"]] = r["pos"], r["neg"]
    return out


def area_of(counts: np.ndarray) -> float:
    pos, neg = counts
    whole = pos.sum() * neg.sum()
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / whole) if whole else 0.5


def area(rows: DataFrame) -> float:
    """The ROC area of (label, p), ties counting half; 0.5 where a class is missing. At most STEPS + 1 rows are read."""
    return area_of(steps(rows))


@dataclass
class Network:
    """A trained network with what its features were standardised by, and the course of its training."""

    parameters: Parameters
    scale: list[tuple[float, float]]
    how: str = "gcn"
    history: list[dict] = field(default_factory=list)
    block: int = G.BLOCK

    def score(self, nodes: DataFrame, links: DataFrame) -> DataFrame:
        """(repertoire_id, probability) of graphs; one without nodes has no row."""
        kind = dict(nodes.dtypes)["repertoire_id"]
        rows, larger = packs(nodes, links, None, self.how, self.scale, self.block)
        whole = rows.mapInArrow(_learnt(self.parameters, 1, None), f"rep {kind}, p double").select(F.col("rep").alias("repertoire_id"), F.col("p").alias("probability"))
        if not larger:
            return whole
        nodes, links = larger
        graphs, _ = Graphs.of(nodes, links, self.how, self.scale)
        labels = nodes.select(F.col("repertoire_id").alias("rep"), F.lit(0.0).alias("label"), F.lit(0.0).alias("learnt")).distinct()
        pooled, _, hidden = scored(graphs, self.parameters, labels)
        far = pooled.mapInArrow(_head(self.parameters, hidden, 1, False), _schema(pooled, ["rep", "label", "learnt"], "g", hidden + 1))
        return whole.unionByName(far.select(F.col("rep").alias("repertoire_id"), F.col(f"g{hidden}").alias("probability")))


def train(nodes: DataFrame, links: DataFrame, meta: DataFrame, hidden: int = 16, layers: int = 2, epochs: int = 100, patience: int = 30, rate: float = 0.01, decay: float = 1e-4, how: str = "gcn", seed: int = 42, block: int = G.BLOCK) -> Network:
    """A graph convolution with mean pooling and a head of two layers, by Adam on the mean cross entropy of all learnt
    graphs at once. `meta` has repertoire_id, label_positive and is_validation; the validation graphs' ROC area
    halves the rate after 20 epochs without a better one, ends training after `patience`, and chooses the parameters.

    Graphs of one block are held by packs, and an epoch goes forward and back through each where it is, without a shuffle
    but of the sums. Over larger ones every epoch is two jobs: forward, states move along the edge table and are summed by node and by graph; back, what
    the loss asks of them moves along the same edges the other way, and each task adds up its share of the gradient.
    Edges never move, no larger graph is held by one task, and the driver holds parameters only. Batch normalisation and
    dropout are left out: features are standardised, and weights decay."""
    scale = standards(nodes)
    known = meta.where("label_positive is not null")
    labels = stored(known.select(F.col("repertoire_id").alias("rep"), F.col("label_positive").cast("double").alias("label"), (~F.col("is_validation")).cast("double").alias("learnt")))
    n = labels.join(nodes.select(F.col("repertoire_id").alias("rep")).distinct(), "rep", "left_semi").where("learnt > 0").count()
    rows, larger = packs(nodes, links, labels, how, scale, block)
    rows, graphs = stored(rows), Graphs.of(*larger, how, scale)[0] if larger else None
    parameters = initial(len(scale), hidden, layers, seed)
    one, two = ({k: np.zeros_like(v) for k, v in parameters.items()} for _ in range(2))
    best, chosen, since, waited, history = -1.0, parameters, 0, 0, []
    checked = labels.where("learnt = 0").limit(1).count() > 0
    for epoch in range(1, epochs + 1):
        found = _added(rows.mapInArrow(_learnt(parameters, n, checked), "part string, values array<double>"))
        loss, seen, slopes = float(found["head"][0]) if found else 0.0, found.pop("seen", np.zeros(2 * (STEPS + 1))).reshape(2, -1), {k: np.zeros_like(v) for k, v in parameters.items()} | _slopes(found, parameters)
        if graphs:
            far, more, result = gradients(graphs, parameters, labels, n)
            held = result.join(labels.select("rep"), "rep", "left_semi")
            loss, seen, slopes = loss + far, seen + steps(held.where("learnt = 0") if checked else held), {k: v + more.get(k, 0) for k, v in slopes.items()}
        value = area_of(seen)
        history.append({"epoch": epoch, "loss": loss, "roc_auc": value, "rate": rate})
        if value > best:
            best, chosen, since, waited = value, {k: v.copy() for k, v in parameters.items()}, 0, 0
        else:
            since, waited = since + 1, waited + 1
        if waited > 20:
            rate, waited = max(rate / 2, 1e-6), 0
        if since >= patience:
            break
        for k, v in parameters.items():
            slope = slopes[k] + decay * v
            one[k] = 0.9 * one[k] + 0.1 * slope
            two[k] = 0.999 * two[k] + 0.001 * slope**2
            parameters[k] = v - rate * (one[k] / (1 - 0.9**epoch)) / (np.sqrt(two[k] / (1 - 0.999**epoch)) + 1e-8)
    return Network(chosen, scale, how, history, block)


def gcn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network learnt on the suppliers' training graphs, with a fifth of them for validation, applied to the others."""
    rep, split = A.clone_repertoire(spark, sf_dir), stored(P.stratified_split(A.clone_metadata(spark, sf_dir)))
    nodes, links = G.built(rep, 5)
    nodes, links = stored(nodes), stored(links)
    train_meta = P.stratified_split(split.where(~F.col("is_test")).select("repertoire_id", "label_positive"), seed=43).withColumnRenamed("is_test", "is_validation")
    learnt = lambda df: df.join(train_meta.select("repertoire_id"), "repertoire_id", "left_semi")
    network = train(learnt(nodes), learnt(links), train_meta, rate=0.02)
    asked = split.where("is_test").select("repertoire_id")
    return network.score(nodes.join(asked, "repertoire_id", "left_semi"), links.join(asked, "repertoire_id", "left_semi"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"gcn_predict": gcn_predict}
