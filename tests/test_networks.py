"""Graph networks against dense ones, their gradients against differences, and a class that only edges tell."""

import random
from inspect import signature

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonoscope.plans import networks as N


def small(spark, graphs=5, dims=3, seed=1):
    r = random.Random(seed)
    nodes, links = [], []
    for g in range(graphs):
        size = r.choice((2, 3, 5))
        nodes += [(g, i, [r.gauss(0, 1) for _ in range(dims)]) for i in range(size)]
        for _ in range(size + 1):
            a, b = r.sample(range(size), 2)
            links += [(g, a, b), (g, b, a)]
    return nodes, links, spark.createDataFrame(nodes, "repertoire_id long, node_id long, x array<double>"), spark.createDataFrame(links, "repertoire_id long, src long, dst long")


def dense_loss(nodes, links, parameters, labels, layers, how="gcn"):
    every = np.array([x for _, _, x in nodes])
    mean, deviation = every.mean(axis=0), every.std(axis=0)
    losses = []
    for g, label in labels.items():
        own = [n for n in nodes if n[0] == g]
        x = (np.array([n[2] for n in own]) - mean) / deviation
        a = np.eye(len(own))
        for h, i, j in links:
            if h == g:
                a[i, j] += 1
        d = a.sum(axis=1)
        a = {"gcn": a / np.sqrt(np.outer(d, d)), "mean": a / d[:, None], "sum": a}[how]
        for k in range(layers):
            x = np.maximum(a @ x @ parameters[f"layer{k}.w"] + parameters[f"layer{k}.b"], 0)
        z = (np.maximum(x.mean(axis=0) @ parameters["head0.w"] + parameters["head0.b"], 0) @ parameters["head1.w"] + parameters["head1.b"])[0]
        losses.append(np.logaddexp(0, z) - label * z)
    return float(np.mean(losses))


@pytest.mark.parametrize("how", ["gcn", "mean", "sum"])
def test_loss_and_gradient(spark, how):
    """The loss is the dense one's, and the gradient its differences."""
    nodes, links, a, b = small(spark)
    labels = {0: 1, 1: 0, 2: 1, 3: 0}
    known = spark.createDataFrame([(g, float(v), 1.0) for g, v in labels.items()], "rep long, label double, learnt double")
    graphs, _ = N.Graphs.of(a, b, how)
    parameters = N.initial(3, 4, 2, seed=7)
    for name in parameters:
        if name.endswith(".b"):
            parameters[name] = np.random.default_rng(3).normal(0.1, 0.2, parameters[name].shape)
    loss, slopes, result = N.gradients(graphs, parameters, known, len(labels))
    assert loss == pytest.approx(dense_loss(nodes, links, parameters, labels, 2, how), abs=1e-7)
    assert result.count() == 5
    for name, values in parameters.items():
        for at in np.ndindex(values.shape):
            moved = []
            for step in (1e-5, -1e-5):
                other = {k: v.copy() for k, v in parameters.items()}
                other[name][at] += step
                moved.append(dense_loss(nodes, links, other, labels, 2, how))
            assert slopes[name][at] == pytest.approx((moved[0] - moved[1]) / 2e-5, abs=1e-5), (name, at)


def test_learns_what_only_edges_tell(spark):
    """Rings of equal and of alternating neighbours, with the same features."""
    r = random.Random(2)
    nodes, links, meta = [], [], []
    for g in range(32):
        size, same = 12, g % 2 == 1
        nodes += [(g, i, [1.0 if (i < size // 2 if same else i % 2) else -1.0, 5.0]) for i in range(size)]
        links += [(g, i, (i + s) % size) for i in range(size) for s in (1, -1)]
        meta.append((g, same, r.random() < 0.3))
    a = spark.createDataFrame(nodes, "repertoire_id long, node_id long, x array<double>")
    b = spark.createDataFrame(links, "repertoire_id long, src long, dst long")
    m = spark.createDataFrame(meta, "repertoire_id long, label_positive boolean, is_validation boolean")
    network = N.train(a, b, m, hidden=6, epochs=14, rate=0.05)
    assert network.history[-1]["loss"] < 0.6 * network.history[0]["loss"]
    got = network.score(a, b).join(m, "repertoire_id").collect()
    assert len(got) == 32 and max(h["roc_auc"] for h in network.history) == 1.0
    assert min(x["probability"] for x in got if x["label_positive"]) > max(x["probability"] for x in got if not x["label_positive"])


def test_area(spark):
    rows = spark.createDataFrame([(1.0, 0.5), (0.0, 0.5), (1.0, 0.9), (0.0, 0.1)], "label double, p double")
    assert N.area(rows) == 0.875 and N.area(rows.where("label = 1")) == 0.5 and N.area(rows.where(F.lit(False))) == 0.5


def test_query_trains_in_full(spark, monkeypatch):
    """As many epochs as a network has unless told otherwise, and fewer only where they bring nothing more."""
    seen, plain = [], N.train

    def spied(*args, **named):
        told = signature(plain).bind(*args, **named)
        told.apply_defaults()
        seen.extend([told, plain(*args, **named)])
        return seen[1]

    monkeypatch.setattr(N, "train", spied)
    assert N.gcn_predict(spark, "/root/testdata/sf0.001").count() > 0
    told, history = seen[0].arguments, seen[1].history
    assert told["epochs"] == 100 and told["patience"] == 30
    best = max(range(len(history)), key=lambda i: history[i]["roc_auc"])
    assert len(history) == 100 or len(history) == best + 1 + 30
