"""Rankings keep as many sequences as the reference."""

import pytest

from clonoscope.operators import ranking
from clonoscope.plans import catalogue


@pytest.mark.parametrize("name", ["rank_reference_whole", "rank_witness_bonus_whole"])
def test_whole_rank(spark, monkeypatch, name):
    words = " ".join(f"w{i}x" for i in range(6000))
    rows = spark.createDataFrame([(w,) for w in words.split()], "junction_aa string")
    counts = rows.selectExpr("junction_aa", "1L as pos_count", "0L as neg_count")
    monkeypatch.setattr(catalogue, "counts_w", lambda s, d: counts)
    monkeypatch.setattr(catalogue.A, "reference_set", lambda s, d: rows.limit(10))
    assert ranking.TOP == 50_000 and catalogue.QUERIES[name](spark, "").count() == 6000


def test_selected_tokens_are_not_shuffled_with_all(spark):
    """Every token of every sequence was shuffled to be joined with the selected ones; sequences were read twice."""
    from clonoscope.operators import ranking as R
    from clonoscope.plans import rankings

    seqs = spark.createDataFrame([("CASSLG",), ("AAAA",), ("CAS",)], "junction_aa string")
    tokens = spark.createDataFrame([("CASS", 0.5), ("C..S", 1.0)], "token string, importance double")
    found = R.token_importance(seqs, tokens.repartition(3))
    assert {r["junction_aa"]: r["importance"] for r in found.collect()} == {"CASSLG": 0.75, "AAAA": 0.0, "CAS": 0.0}
    rows = spark.createDataFrame([("CASS", "v2", None, True), ("CASS", "v1", None, False), ("CASS", "v1", "j", True), ("CA", "v", "j", True)], "junction_aa string, v_call string, j_call string, label_positive boolean")
    counted = rankings.counted(rows)
    assert [tuple(r) for r in counted.select("junction_aa", "pos_count", "neg_count", "v_call", "j_call").collect()] == [("CASS", 2, 1, "v1", "j")]
    assert "Join" not in counted._jdf.queryExecution().executedPlan().toString()
