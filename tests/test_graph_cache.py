"""Stored graphs: built once, found in any folder, verified, and only changed repertoires built anew."""

import shutil

from clonoscope.operators import graph as G
from clonoscope.sources import graph_cache


def rows_of(frames):
    return [sorted(map(repr, f.select(*sorted(f.columns)).collect())) for f in frames]


def test_graphs_are_built_once(spark, tmp_path, monkeypatch):
    rep = spark.createDataFrame([(r, s, "V1", "J1") for r in (1, 2, 3) for s in ("CASSLG", "CASSLQ", "CAWMKT", f"CTTT{'ACD'[r - 1]}")], "repertoire_id long, junction_aa string, v_call string, j_call string")
    built = []
    plain = G.knn
    monkeypatch.setattr(G, "knn", lambda nodes, k: built.append({n["repertoire_id"] for n in nodes.collect()}) or plain(nodes, k))
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    want = rows_of(G.built(rep, 2))
    built.clear()
    assert rows_of(G.built(rep, 2, folders=[old])) == want and built == [{1, 2, 3}]
    assert rows_of(G.built(rep, 2, folders=[new, old])) == want and len(built) == 1  # nothing to build, found in the second folder
    changed = rep.where("repertoire_id <> 2").unionByName(spark.createDataFrame([(2, "CASSLG", "V1", "J1"), (2, "CPPPR", "V1", "J1")], rep.schema))
    got = rows_of(G.built(changed, 2, folders=[new, old]))
    assert built[1:] == [{2}] and got == rows_of(G.built(changed, 2))
    built.clear()
    G.built(rep, 3, folders=[old])
    G.built(rep, 2, folders=[old], name="another")
    assert built == [{1, 2, 3}] * 2  # k and the embedder are part of the key
    assert G.built(rep.limit(0), 2, folders=[old])[0].count() == 0


def test_broken_and_uncommitted_graphs_are_not_found(spark, tmp_path):
    rep = spark.createDataFrame([(r, s, "V1", "J1") for r in ("a", "b") for s in ("CASSLG", "CASSLQ", "CAWMKT")], "repertoire_id string, junction_aa string, v_call string, j_call string")
    folder = str(tmp_path / "graphs")
    want = rows_of(G.built(rep, 1, folders=[folder]))
    keys = graph_cache.files.content_key(rep, f"version {graph_cache.VERSION}", "k=1", "hashed")
    assert graph_cache.found(spark, [folder], keys)[0].count() == 2
    (batch,) = (tmp_path / "graphs").glob("batch_*")
    edges = spark.createDataFrame(spark.read.parquet(f"{batch}/edges").where("repertoire_id = 'a'").collect())
    edges.write.mode("overwrite").parquet(f"{batch}/edges")
    assert [r["repertoire_id"] for r in graph_cache.found(spark, [folder], keys)[0].collect()] == ["a"]
    assert rows_of(G.built(rep, 1, folders=[folder])) == want
    shutil.rmtree(tmp_path / "graphs" / "manifest")
    assert graph_cache.found(spark, [folder], keys)[0].count() == 0
