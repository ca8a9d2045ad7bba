"""Patterns and Fisher's tests are dealt to tasks by their number, with the same results."""

from math import comb

import pytest
from pyspark.sql import functions as F

from clonoscope.operators import enrich as E


def test_windows_are_dealt_by_their_number(spark, monkeypatch):
    words = [f"{chr(65 + i % 26)}{chr(65 + i // 26)}CASSL" for i in range(300)]
    rows = spark.createDataFrame([(r, r % 2 == 0, w) for r in range(4) for w in words[r:] + words[:5]], "repertoire_id long, label_positive boolean, junction_aa string")
    plain = {tuple(r) for r in E.pattern_counts(rows, (3, 4), True).collect()}
    monkeypatch.setattr(E, "WINDOWS", 1000)
    dealt = E.pattern_counts(rows, (3, 4), True)
    assert dealt.rdd.getNumPartitions() >= 10
    assert {tuple(r) for r in dealt.collect()} == plain
    assert sum(r[4] for r in plain) == sum(5 + 4 + 3 for r in range(4) for w in words[r:] + words[:5])


def test_tests_are_dealt_by_their_terms(spark, monkeypatch):
    monkeypatch.setattr(E, "TERMS", 50)
    seen = []
    plain = E.small
    monkeypatch.setattr(E, "small", lambda t: (seen.append(t.rdd.getNumPartitions()), plain(t))[1])
    cand = spark.createDataFrame([(a, b, 30, 25) for a in range(1, 30) for b in range(25)], "a long, b long, n_pos long, n_neg long")
    got = E.with_fisher(cand.select("*", F.lit("x").alias("kmer"))).collect()
    assert seen[0] > 20 and len(got) == 29 * 25
    for r in got:
        k = r["a"] + r["b"]
        assert r["p_value"] == pytest.approx(sum(comb(30, x) * comb(25, k - x) for x in range(r["a"], min(30, k) + 1)) / comb(55, k), rel=1e-9)


def test_no_rows(spark):
    rows = spark.createDataFrame([], "repertoire_id long, label_positive boolean, junction_aa string")
    assert E.pattern_counts(rows, (3,)).count() == 0
