"""Draws from repertoires of one range need no order over the whole table."""

from clonoscope.operators import sampling as P
from clonoscope.plans import rankings


def test_small_repertoires_are_not_numbered_over_the_table(spark, monkeypatch):
    rows = spark.createDataFrame([(r, f"s{((r or 3) * 5 + i) % 9}", 10 + i) for r in (1, 2, None) for i in range(9)], "repertoire_id long, junction_aa string, templates long")
    key = lambda got: sorted((str(r["repertoire_id"]), r["junction_aa"], r["templates"]) for r in got)
    plain = key(P.downsampled(rows, ["junction_aa"], 50).collect())
    monkeypatch.setattr(P, "numbered", None)
    got = key(P.downsampled(rows.repartition(5), ["junction_aa"], 50).collect())
    assert got == plain
    assert {k: sum(n for r, _, n in got if r == k) for k in ("1", "2", "None")} == {"1": 50, "2": 50, "None": 50}


def test_small_repertoires_are_drawn_from_by_packs(spark):
    """Each repertoire was a call of its own, and the rows' join with their sums was a shuffle of its own."""
    rows = spark.createDataFrame([(r, f"s{i}", 10 + i) for r in range(200) for i in range(3)], "repertoire_id long, junction_aa string, templates long")
    got = P.downsampled(rows, ["junction_aa"], 20)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "Join" not in plan
    assert [r["n"] for r in got.groupBy("repertoire_id").agg({"templates": "sum"}).toDF("r", "n").collect()] == [20] * 200


def test_a_ranking_by_templates_reads_its_rows_once(spark):
    """Draws that were ranked were made twice, for sums and for genes."""
    rows = spark.createDataFrame([(r, f"s{i}", f"V{r % 2}", "J", 10 + i, r % 2 == 0) for r in range(6) for i in range(3)], "repertoire_id long, junction_aa string, v_call string, j_call string, templates long, label_positive boolean")
    got = rankings.by_templates(P.downsampled(rows, ["junction_aa"], 20))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1
    assert got.count() == 3
