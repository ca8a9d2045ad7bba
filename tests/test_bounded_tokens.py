"""Tokens and vectors of repertoires: their work follows the repertoires' sequences, not every token of each."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from clonoscope.functions import sequence as S
from clonoscope.operators import diversity as D
from clonoscope.plans import pipelines


def tokens(s):
    return {"".join(c if keep else "." for c, keep in zip(s[i:], m, strict=False)) for m in S.masks() for i in range(len(s) - len(m) + 1)}


def test_tokens_of_the_same_sequences_are_counted_once(spark):
    """Each repertoire had a row for each of its tokens."""
    held = {r: {"CASSLGQETQYF", "CASSPGQ"[: 4 + r], "CAWMLKTGNTIYF"[r:]} for r in range(4)}
    rep = spark.createDataFrame([(r, s) for r, seqs in held.items() for s in seqs for _ in range(2)] + [(9, None)], "repertoire_id long, junction_aa string")
    got, named = pipelines._tokens(rep)
    got = got.distinct()
    assert got.count() * 10 < sum(len(set().union(*map(tokens, seqs))) for seqs in held.values())
    assert {tuple(r) for r in got.join(named, "same").select("repertoire_id", "term").collect()} == {(r, t) for r, seqs in held.items() for s in seqs for t in tokens(s)}
    chosen = spark.createDataFrame([(t, i) for i, t in enumerate(("AWML", "CASS", "C.SSP", "QYF", "NTIY"))], "term string, place long")
    want = {r: [float(any(t in tokens(s) for s in held.get(r, ()))) for t in ("AWML", "CASS", "C.SSP", "QYF", "NTIY")] for r in (*held, 9)}
    assert {r["repertoire_id"]: r["v"] for r in pipelines._token_terms(rep, chosen).select("repertoire_id", vector_to_array("term_counts").alias("v")).collect()} == want


@pytest.mark.parametrize("dense", [10_000, 0])
def test_vectors_are_filled_by_batches(spark, monkeypatch, dense):
    """Each number of a vector was an object of a Python call by row."""
    monkeypatch.setattr(pipelines, "DENSE", dense)
    rep = spark.range(600).select(F.col("id").alias("repertoire_id"))
    held = rep.where("repertoire_id % 3 > 0").select("repertoire_id", F.explode(F.expr("array_repeat(concat('t', repertoire_id % 7), cast(repertoire_id % 3 as int))")).alias("term"))
    chosen = spark.createDataFrame([(f"t{i}", i) for i in range(7)], "term string, place long")
    made = pipelines._terms(rep, held, chosen)
    assert {r["repertoire_id"]: r["v"] for r in made.select("repertoire_id", vector_to_array("term_counts").alias("v")).collect()} == {i: [float(i % 3) if j == i % 7 else 0.0 for j in range(7)] for i in range(600)}
    assert ("BatchEvalPython" in made._jdf.queryExecution().executedPlan().toString()) == (dense == 0)


def test_equal_sequences_are_cut_once_and_weighed(spark):
    """Words, lengths and letters were taken from every row."""
    rep = spark.createDataFrame([(r, s) for r in (1, 2) for s, n in (("CASSL", 2 + r), ("CAWMLKT", 1), ("CA", 2)) for _ in range(n)] + [(2, None)], "repertoire_id long, junction_aa string")
    counted = rep.groupBy("repertoire_id", "junction_aa").agg(F.count("*").alias("n"))
    for of in (lambda rows, *w: D.length_histogram(rows, [2, 5, 6], 9, *w), D.composition):
        assert sorted(map(tuple, of(counted, F.col("n")).collect())) == sorted(map(tuple, of(rep).collect()))
    chosen = pipelines._all_words(rep, None, None)
    assert [r["term"] for r in chosen.collect()][:3] == ["ASS", "CAS", "SSL"]
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [junction_aa" in plan.split("Generate", 1)[1]
