"""Draws, graphs, a network and boosting together, and a calibrated recipe."""

import pytest
from pyspark.sql import functions as F

from clonoscope.plans import ensembles, pipelines
from test_learned import toy


def test_both_models_agree_on_planted_repertoires(spark, tmp_path):
    rep, meta, _ = toy(spark)
    # positives have far more of one clone
    rep = rep.withColumn("templates", F.when((F.col("junction_aa") == "CASSLGQ") & (F.col("row_idx") == 0), 400).otherwise(F.col("templates")))
    model = ensembles.fit(rep, meta, ["row_idx"], k=2, target=300, trees=6, epochs=4, rate=0.05, folders=[str(tmp_path / "graphs")])
    got = {r["repertoire_id"]: r["probability"] for r in model.score(rep, ["row_idx"], [str(tmp_path / "graphs")]).collect()}
    assert len(got) == 24 and all(0 <= p <= 1 for p in got.values())
    positive, negative = ([p for i, p in got.items() if int(i[1:]) % 2 == k] for k in (1, 0))
    assert sum(positive) / 12 > sum(negative) / 12 + 0.1
    best = ensembles.ranked(rep, meta, ["row_idx"], 300).first()
    assert best["junction_aa"] == "CASSLGQ" and best["v_call"] == "V0"


def test_a_calibrated_recipe(spark, tmp_path):
    rep, meta, reference = toy(spark)
    fitted = pipelines.fit("reference", rep, meta, reference)
    assert fitted.calibration is not None
    fitted.save(str(tmp_path / "m"))
    first = {r["repertoire_id"]: r["probability"] for r in fitted.score(rep).collect()}
    again = {r["repertoire_id"]: r["probability"] for r in pipelines.Fitted.load(spark, str(tmp_path / "m")).score(rep).collect()}
    assert first == pytest.approx(again) and all((p > 0.5) == bool(int(i[1:]) % 2) for i, p in first.items())
