"""Windows are counted where a repertoire's packed sequences are, as by hand, and large repertoires as small ones."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from clonoscope.operators import enrich as E
from clonoscope.operators import packs as PK
from clonoscope.operators import ranking as R
from clonoscope.plans import catalogue, more
from clonoscope.sources import adapters as A

WORDS = ["CASSL", "CASSL", "ÀÉ✓𝄞XYZ", "AB", "", None, "A.BC.DE", "A\x00BCDE", "KKKKKKKK"]


def by_hand(rows, ks, gaps):
    out = Counter()
    for rep, label, s in rows:
        for k in ks:
            for i in range(len(s or "") - k + 1):
                out[rep, label, k, s[i : i + k]] += 1
            for i in range(len(s or "") - k if gaps and k >= 4 else 0):
                out[rep, label, k, s[i : i + k // 2] + "." + s[i + k // 2 + 1 : i + k + 1]] += 1
    return {(*key, n) for key, n in out.items()}


def table(spark, rows):
    return spark.createDataFrame(rows, "repertoire_id string, label_positive boolean, junction_aa string").repartition(3, F.rand(1))


@pytest.mark.parametrize("most", [2_000_000, 60, 5])
def test_counts_by_hand(spark, monkeypatch, most):
    """Any letters, no label, and repertoires of several rows; all, some and none of them small."""
    monkeypatch.setattr(E, "WINDOWS", most)
    rows = [(r, label, w) for r, label in (("a", True), ("b", False), ("c", None), (None, True)) for w in WORDS[: 3 if r == "b" else None]]
    for ks, gaps in (((3, 4, 5, 6), True), ((3, 4, 5), False)):
        got = [tuple(r) for r in E.pattern_counts(table(spark, rows), ks, gaps).select("repertoire_id", "label_positive", "k", "kmer", "cnt").collect()]
        assert len(got) == len(set(got)) and set(got) == by_hand(rows, ks, gaps)


def test_many_letters(spark, monkeypatch):
    """Keys of windows are numbered anew before they are too large."""
    monkeypatch.setattr(PK, "MOST", 5_000)
    monkeypatch.setattr(PK, "CHUNK", 20)
    monkeypatch.setattr(PK, "ROWS", 2)
    rows = [(str(r), r % 2 == 0, "".join(chr(0x4E00 + (7 * r + i * i) % 90) for i in range(n))) for r in range(5) for n in (4, 9, 30)]
    assert {tuple(r) for r in E.pattern_counts(table(spark, rows), (3, 6), True).collect()} == by_hand(rows, (3, 6), True)


def test_windows_of_small_repertoires_are_not_shuffled(spark, monkeypatch):
    """What goes by repertoire is packed; what is summed by pattern is summed in each task first."""
    monkeypatch.setattr(E, "WINDOWS", 100)
    rows = spark.range(40).select(F.col("id").alias("repertoire_id"), (F.col("id") % 2 == 0).alias("label_positive"), F.explode(F.lit(["CASSLG", "CASSL", "QYF"])).alias("junction_aa"))
    plan = E.pattern_presence(E.pattern_counts(rows, (3, 4)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "partial_" in plan.split("Exchange hashpartitioning(k")[1].split("MapInArrow")[0]
    assert "Generate" not in plan


def test_features_read_counts_once(spark):
    counts = E.pattern_counts(table(spark, [("a", True, "CASSL"), ("a", True, "CASXX"), ("b", False, "QQQ")]), (3,))
    patterns = spark.createDataFrame([(3, "CAS"), (3, "SSL")], "k int, kmer string")
    ids = spark.createDataFrame([("a",), ("b",), ("none",)], "repertoire_id string")
    found = E.pattern_features(counts, patterns, ids, (3,))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    rows = {r["repertoire_id"]: r for r in found.collect()}
    assert [rows["a"][c] for c in ("count", "abundance", "max", "n_kmers", "total")] == [2, 3, 2, 5, 6]
    assert rows["a"]["diversity"] == pytest.approx(0.636514, abs=1e-6)
    assert [rows["b"][c] for c in ("count", "abundance", "n_kmers", "total")] == [0, 0, 1, 1] and rows["none"]["total"] == 0


def test_labelled_texts_are_joined_before_their_words(spark, tmp_path):
    spark.createDataFrame([(1, "abc, de fgh abc", "en", "s"), (2, "xyz", "fr", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    words = A.labelled_words(spark, str(tmp_path), A.word_metadata(spark, str(tmp_path)))
    assert sorted((r["repertoire_id"], r["row_idx"], r["junction_aa"], r["v_call"], r["label_positive"]) for r in words.collect()) == [(1, 1, "ABC", "en", True), (1, 3, "FGH", "en", True), (1, 4, "ABC", "en", True)]
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")


def test_gapped_windows_are_not_shuffled(spark, monkeypatch):
    """What the selection sums by pattern comes from packed rows."""
    plans, plain = [], E.pattern_presence
    monkeypatch.setattr(E, "pattern_presence", lambda counts: (plans.append(counts._jdf.queryExecution().optimizedPlan().toString()), plain(counts))[1])
    more.QUERIES["pattern_gapped_strict"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and "MapInArrow" in plans[0] and "Generate" not in plans[0]


def test_longest_pattern_shuffles_no_windows(spark):
    seqs = spark.createDataFrame([("CASSL",), ("CAXXL",), ("QQQQ",)], "junction_aa string")
    patterns = spark.createDataFrame([(3, "CAS"), (4, "CAS.L"), (4, "ASSL")], "k int, kmer string").repartition("kmer")
    found = R.longest_pattern(seqs, patterns)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [tuple(r) for r in found.collect()] == [("CASSL", 4)]


@pytest.mark.parametrize("name", ["pattern_features_wide", "pattern_features_strict"])
def test_words_are_packed_once(spark, monkeypatch, name):
    """Patterns are selected and looked for in the same packed sequences."""
    calls, plain = [], E.pattern_counts
    monkeypatch.setattr(E, "pattern_counts", lambda *a: (calls.append(a), plain(*a))[1])
    catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
