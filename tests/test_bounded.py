"""Operators that never hold a whole repertoire: the same rows as plain ones, and less work."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonoscope.functions import sequence as S
from clonoscope.operators import counts as C
from clonoscope.operators import graph as G
from clonoscope.operators import sampling as P


def frames(spark, nodes, links):
    return spark.createDataFrame(nodes, "repertoire_id long, node_id long, x array<double>"), spark.createDataFrame(links, "repertoire_id long, src long, dst long")


def test_triangles_of_a_multigraph(spark):
    r = random.Random(1)
    pairs = [tuple(r.sample(range(25), 2)) for _ in range(140)]
    _, links = frames(spark, [(0, 0, [0.0])], [(0, a, b) for p in pairs for a, b in (p, p[::-1])])
    m = Counter(frozenset(p) for p in pairs)
    want = Counter()
    for t in combinations(range(25), 3):
        for n in t:
            want[n] += math.prod(m[frozenset(e)] for e in combinations(t, 2))
    assert {x["node_id"]: x["triangles"] for x in G.triangles(links).collect()} == {n: c for n, c in want.items() if c}


def test_a_hub_leads_no_wedges(spark):
    edges = [(0, i) for i in range(1, 401)] + [(i, i + 1) for i in range(1, 400)]
    _, links = frames(spark, [(0, 0, [0.0])], [(0, a, b) for p in edges for a, b in (p, p[::-1])])
    assert G.wedges(links).count() <= 2 * len(edges) < 400 * 399 / 2
    assert G.triangles(links).where("node_id = 0").first()["triangles"] == 399


@pytest.mark.parametrize("hub", [3, 1024])
def test_attention_in_parts(spark, hub):
    r = np.random.default_rng(2)
    x = r.normal(0, 20, (30, 3))
    edges = [(0, i) for i in range(1, 30)] + [(3, 5), (3, 5)]
    nodes, links = frames(spark, [(7, i, v.tolist()) for i, v in enumerate(x)], [(7, a, b) for p in edges for a, b in (p, p[::-1])])
    own, other = [1.0, -2.0, 0.5], [3.0, 1.0, 2.0]
    got = {n["node_id"]: n["x"] for n in G.attended(nodes, links, own, other, hub=hub).collect()}
    for i in range(30):
        near = [i, *(b for p in edges for a, b in (p, p[::-1]) if a == i)]
        e = np.array([x[i] @ own + x[j] @ other for j in near])
        e = np.where(e > 0, e, 0.2 * e)
        w = np.exp(e - e.max())
        assert got[i] == pytest.approx((w / w.sum()) @ x[near], abs=1e-9)


@pytest.mark.parametrize(("how", "layers"), [("gcn", 2), ("gcn", 0), ("mean", 3), ("sum", 1), ("max", 1)])
def test_pooling_moves_numbers_and_not_vectors(spark, monkeypatch, how, layers):
    """The mean of the steps' own vectors, for graphs with parallel edges and lone nodes, and none of those vectors made."""
    r = np.random.default_rng(4)
    edges = [(k, a, b) for k in (1, 2) for a, b in [tuple(r.choice(9, 2, replace=False).tolist()) for _ in range(12)] + [(0, 1), (0, 1)]]
    nodes, links = frames(spark, [(k, i, r.normal(0, 3, 3).tolist()) for k in (1, 2, 3) for i in range(10)], [(k, *p) for k, a, b in edges for p in ((a, b), (b, a))])
    plain = nodes
    for _ in range(layers):
        plain = G.as_nodes(G.convolved(plain, links, how))
    want = {(n["repertoire_id"], n["dim"]): n["mean"] for n in G.mean_pool(plain).collect()}
    if how != "max":
        monkeypatch.setattr(G, "convolved", None)
    got = {(n["repertoire_id"], n["dim"]): n["mean"] for n in G.pooled(nodes, links, layers, how).collect()}
    assert len(got) == 9
    assert got == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_pruned_neighbours(spark, metric):
    """Clusters, copies and single nodes: the rows of the plain search from far fewer distances."""
    r = np.random.default_rng(3)
    centres = r.normal(0, 10, (30, 6))
    x = np.concatenate([*(c + r.normal(0, 0.1, (40, 6)) for c in centres), np.repeat(centres[:1], 50, axis=0), r.normal(0, 10, (20, 6))])
    nodes = spark.createDataFrame([(i % 2, i, v.tolist()) for i, v in enumerate(x)], "repertoire_id long, node_id long, x array<double>")
    nodes = nodes.unionByName(spark.createDataFrame([(5, 1, [1.0] * 6), (5, 2, [2.0] * 5 + [1.0]), (6, 9, [1.0] * 6)], nodes.schema))
    plain = {tuple(n) for n in G.knn(nodes, 4, metric).select("repertoire_id", "src", "dst", "distance", "rank").collect()}
    assert {tuple(n) for n in G.knn_pruned(nodes, 4, metric, cell=20, block=64).select("repertoire_id", "src", "dst", "distance", "rank").collect()} == plain
    compared = G.pruned(nodes, 4, metric, 20, 64).groupBy("repertoire_id", "cell", "part", "other_cell", "other_part").agg((F.count_if("asks") * F.count_if(~F.col("asks"))).alias("n")).agg(F.sum("n")).first()[0]
    assert compared < 0.3 * 2 * (len(x) // 2) ** 2


def test_cells_of_the_pruned_search_grow_with_the_repertoire(spark):
    """Vectors in all directions, of which nothing can be left out: the same rows, and a node goes to few parts."""
    x = np.random.default_rng(5).normal(0, 1, (600, 16))
    nodes = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "repertoire_id long, node_id long, x array<double>")
    assert G.pruned(nodes, 3, "cosine", 4, 8).count() < 70 * 600
    plain = {tuple(n) for n in G.knn(nodes, 3).select("src", "dst", "distance", "rank").collect()}
    assert {tuple(n) for n in G.knn_pruned(nodes, 3, cell=4, block=8).select("src", "dst", "distance", "rank").collect()} == plain


def test_equal_distances_are_taken_by_node(spark):
    nodes = spark.createDataFrame([(1, i, [1.0, float(i % 2)]) for i in range(40)], "repertoire_id long, node_id long, x array<double>")
    got = {(n["src"], n["rank"]): (n["dst"], n["distance"]) for n in G.knn(nodes, 3, block=16).collect()}
    for i in range(40):
        assert [got[i, r] for r in (1, 2, 3)] == [(j, 0.0) for j in range(40) if j % 2 == i % 2 and j != i][:3]


def test_draws_divided_among_ranges_are_one_multinomial(spark, monkeypatch):
    weights = {i: 1 + 7 * (i % 13) for i in range(150)}
    rows = spark.createDataFrame([(r, f"s{i:03d}", w * 1000) for r in (1, 2) for i, w in weights.items()], "repertoire_id long, junction_aa string, templates long")
    monkeypatch.setattr(P, "FAN", 0)  # no repertoire is a single draw
    target = 30_000
    got = P.downsampled(rows, ["junction_aa"], target, fan=6).collect()
    total = sum(weights.values())
    found = [{r["junction_aa"]: r["templates"] for r in got if r["repertoire_id"] == k} for k in (1, 2)]
    assert found[0] != found[1]
    for one in found:
        assert sum(one.values()) == target
        chi2 = sum((one.get(f"s{i:03d}", 0) - target * w / total) ** 2 / (target * w / total) for i, w in weights.items())
        assert 90 < chi2 < 225  # 149 degrees of freedom
    again = P.downsampled(rows.repartition(7), ["junction_aa"], target, fan=6).where("repertoire_id = 2").collect()
    assert {r["junction_aa"]: r["templates"] for r in again} == found[1]


def test_a_small_repertoire_is_one_draw_and_one_below_the_target_stays(spark):
    rows = spark.createDataFrame([(1, "a", 50), (1, "b", 30), (1, "c", 20), (2, "a", 3), (2, "a", 3), (3, "z", None)], "repertoire_id long, junction_aa string, templates int")
    got = sorted((r["repertoire_id"], r["junction_aa"], r["templates"]) for r in P.downsampled(rows, ["junction_aa"], 10).collect() if r["templates"] is not None)
    assert got == [(1, "a", 4), (1, "b", 2), (1, "c", 4), (2, "a", 3), (2, "a", 3)]
    assert P.downsampled(rows.limit(0), ["junction_aa"], 10).count() == 0


def test_a_scan_that_has_enough_opens_no_further_file(spark, tmp_path):
    meta = spark.createDataFrame([(f"r{i}", f"{tmp_path}/r{i}.tsv", i % 3 == 0) for i in range(12)], "repertoire_id string, filename string, label_positive boolean")
    order = C.in_priority(meta)
    assert [o.rsplit("/", 1)[1] for o in order[:4]] == ["r0.tsv", "r3.tsv", "r6.tsv", "r9.tsv"]
    for k, path in enumerate(order[:4]):  # the others do not exist
        lines = [f"CAS{chr(65 + k)}{chr(65 + i)}G\tV{k}\tJ1" for i in range(10)] + ["GGGG\tV\tJ", f"CASSHARED\tV{9 - k}\tJ"]
        with open(path, "w") as f:
            f.write("junction_aa\tv_call\tj_call\n" + "\n".join(lines) + "\n")

    def candidates(rows):
        found = rows.where(S.kmers(F.col("junction_aa"), 3)[0] == "CAS")
        return found.groupBy("junction_aa").agg(F.lit(1.0).alias("score"), F.min("v_call").alias("v_call"), F.min("j_call").alias("j_call"))

    read = lambda some: spark.read.option("sep", "\t").option("header", True).csv(some)
    got = {r["junction_aa"]: (r["chunk"], r["v_call"]) for r in C.scanned(read, order, candidates, chunk=2, enough=25).collect()}
    assert len(got) == 41 and got["CASSHARED"] == (0, "V8") and got["CASDAG"] == (1, "V3") and "GGGG" not in got
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        C.scanned(read, order, candidates, chunk=2, enough=1000).count()
