"""Repertoires of one block go by packs, larger ones by joins, with the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from clonoscope.operators import graph as G
from clonoscope.plans import networks as N


@pytest.fixture(scope="module")
def graphs(spark):
    """Repertoires of 1 to 20 different sequences, and one without any row."""
    r = random.Random(5)
    rows = [(g, "".join(r.choice("ACDE") for _ in range(r.randint(4, 7)))) for g, n in enumerate((1, 2, 3, 9, 14, 20)) for _ in range(n)]
    nodes, links = G.built(spark.createDataFrame(rows, "repertoire_id long, junction_aa string"), 3)
    return nodes, links


def rows(df):
    return sorted((*key, *[round(v, 9) for v in (values if isinstance(values, list) else [values])]) for *key, values in df.collect())


def test_node_features(graphs):
    nodes, links = graphs
    want = rows(G.node_features(nodes, links, k=3, block=0))
    assert len(want) == nodes.count() and any(w[2 + 25] for w in want)
    assert rows(G.node_features(nodes, links, k=3)) == want
    assert rows(G.node_features(nodes, links, k=3, block=10)) == want
    assert rows(G.node_features(nodes, links, k=30)) == rows(G.node_features(nodes, links, k=30, block=0))


@pytest.mark.parametrize("how", ["gcn", "sum", "mean"])
def test_pooled(graphs, how):
    nodes, links = graphs
    want = rows(G.pooled(nodes, links, how=how, block=0))
    assert rows(G.pooled(nodes, links, how=how)) == want == rows(G.pooled(nodes, links, how=how, block=10))


def test_nearest(graphs):
    nodes, _ = graphs
    of = lambda block: sorted(map(tuple, G.knn(nodes, 3, "l2", block=block).select("repertoire_id", "src", "dst", "rank").collect()))
    assert of(1024) == of(4)


def test_small_repertoires_are_not_joined(graphs):
    """Every step over small repertoires was a join of its own, and a call of its own a repertoire."""
    nodes, links = graphs
    plan = G.node_features(nodes, links, k=3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange") <= 2


def test_equal_sequences_are_embedded_once(spark):
    """Sequences of many repertoires were embedded for each."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def embed(s):
        made.add(1)
        return [float(len(s)), 1.0]

    rep = spark.createDataFrame([(g, s) for g in range(50) for s in ("CASS", "CASSLG")], "repertoire_id long, junction_aa string")
    nodes = G.sequence_nodes(rep, lambda c: embed(c))
    assert nodes.count() == 100 and nodes.where("x[0] <> length(junction_aa)").isEmpty()
    assert made.value <= 4


@pytest.mark.parametrize("how", ["gcn", "mean", "sum"])
def test_network(spark, graphs, how):
    """Training goes through packs, or along the edge table, with the same course; each epoch shuffled all states."""
    nodes, links = graphs
    meta = spark.createDataFrame([(0, True, False), (1, False, False), (2, True, True), (3, False, True), (4, True, False)], "repertoire_id long, label_positive boolean, is_validation boolean")
    trained = {block: N.train(nodes, links, meta, hidden=4, epochs=3, how=how, block=block) for block in (0, 1024, 5)}
    for block in (1024, 5):
        assert [list(map(lambda v: round(v, 7), h.values())) for h in trained[block].history] == [list(map(lambda v: round(v, 7), h.values())) for h in trained[0].history]
        want, got = ({r["repertoire_id"]: r["probability"] for r in trained[b].score(nodes, links).collect()} for b in (0, block))
        assert got == pytest.approx(want, abs=1e-7) and len(got) == 6
