"""Models on the smallest tables: whole results, probabilities, no leak, and what is stored is what was fitted."""

import os

import pytest
from pyspark.sql import functions as F

from clonoscope.__main__ import run
from clonoscope.operators import evaluate as V
from clonoscope.plans import learned, pipelines
from clonoscope.sources import files

TABLES = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


@needs_tables
@pytest.mark.parametrize("name", ["lr_predict", "rf_predict", "soft_vote_predict", "stacked_predict", "isotonic_predict", "nested_cv_predict"])
def test_each_repertoire_has_one_probability(spark, name):
    got = learned.QUERIES[name](spark, TABLES).collect()
    assert len(got) == len({r["repertoire_id"] for r in got}) == 10
    assert all(0 <= r["probability"] <= 1 for r in got)


@needs_tables
def test_reports(spark):
    assert learned.cross_validated(spark, TABLES).count() == 5 * len(learned.MODELS)
    assert {r["feature"] for r in learned.importances(spark, TABLES).collect()} == set(learned.FEATURES)
    assert learned.polynomial(spark, TABLES).count() > 0


def test_scaling_learns_from_training_rows_only(spark):
    rows = spark.createDataFrame([(i, float(i % 2), float(i), i % 5) for i in range(20)], "repertoire_id long, label double, x double, fold int")
    train = rows.where("repertoire_id < 10")
    fitted, asked = learned.prepared(train, ("x",), rows.where("repertoire_id >= 10"))
    mean, deviation = train.agg(F.avg("x"), F.stddev_pop("x")).first()
    assert {r["repertoire_id"]: round(float(r["features"][0]), 9) for r in asked.collect()} == {i: round((i - mean) / deviation, 9) for i in range(10, 20)}
    assert fitted.agg(F.avg(F.col("weight"))).first()[0] == pytest.approx(1.0)


def test_out_of_fold_finds_a_separable_class(spark):
    rows = spark.createDataFrame([(i, float(i % 2), float(i % 2) + 0.01 * i, i % 5) for i in range(60)], "repertoire_id long, label double, x double, fold int")
    assert learned.area(learned.out_of_fold(rows, learned.logistic(), ("x",))) > 0.9
    assert learned.forward_selection(rows.withColumn("noise", F.col("repertoire_id") % 3 * 1.0), ("noise", "x"), 2)[0][1] == "x"


def toy(spark):
    """Positives hold CASSLGQ, negatives CAWMLKT, all some other."""
    rows = []
    for i in range(24):
        own = "CASSLGQ" if i % 2 else "CAWMLKT"
        rows += [(f"r{i:02d}", j, s, f"V{j % 3}", f"J{j % 2}", None, 2 + j) for j, s in enumerate([own, own, "CTTTE" + "ACDEFG"[i % 6], "CPPPR", own[:5] + "W"])]
    rep = spark.createDataFrame(rows, "repertoire_id string, row_idx long, junction_aa string, v_call string, j_call string, d_call string, templates long")
    meta = spark.createDataFrame([(f"r{i:02d}", bool(i % 2)) for i in range(24)], "repertoire_id string, label_positive boolean")
    return rep, meta, spark.createDataFrame([("CASSLGQ",), ("CPPPR",)], "junction_aa string")


@pytest.mark.parametrize("recipe", sorted(pipelines.RECIPES))
def test_fit_save_load_score(spark, tmp_path, recipe):
    rep, meta, reference = toy(spark)
    fitted = pipelines.fit(recipe, rep, meta.where("repertoire_id < 'r16'"), reference)
    fitted.save(str(tmp_path / "m"))
    new = rep.where("repertoire_id >= 'r16'")
    first = {r["repertoire_id"]: r["probability"] for r in fitted.score(new).collect()}
    again = {r["repertoire_id"]: r["probability"] for r in pipelines.Fitted.load(spark, str(tmp_path / "m")).score(new).collect()}
    assert len(first) == 8 and first == pytest.approx(again)
    assert all((p > 0.5) == bool(int(i[1:]) % 2) for i, p in first.items())


def test_report_and_ensemble(spark):
    rep, meta, reference = toy(spark)
    scored = pipelines.fit("vocabulary", rep, meta, reference).score(rep)
    both = pipelines.ensemble([scored, scored])
    assert {r["repertoire_id"]: r["probability"] for r in both.collect()} == pytest.approx({r["repertoire_id"]: r["probability"] for r in scored.collect()})
    assert pipelines.report(scored, meta).where("class = 'macro avg'").first()["f1"] == pytest.approx(1.0)


def test_command_line(spark, tmp_path):
    train, test = tmp_path / "train_dataset_4", tmp_path / "test_dataset_4_1"
    train.mkdir(), test.mkdir()
    rep, meta, _ = toy(spark)
    for r, rows in rep.toPandas().groupby("repertoire_id"):
        (train if r < "r16" else test).joinpath(f"{r}.tsv").write_text(rows[["j_call", "junction_aa", "v_call"]].to_csv(sep="\t", index=False))
    (train / "metadata.csv").write_text("repertoire_id,filename,label_positive\n" + "".join(f"r{i:02d},r{i:02d}.tsv,{bool(i % 2)}\n" for i in range(16)))
    out = str(tmp_path / "out")
    result = run(spark, str(train), [str(test)], out)
    tests = {r["ID"]: r["label_positive_probability"] for r in result.where("dataset = 'test_dataset_4_1'").collect()}
    assert len(tests) == 8 and all((p > 0.5) == bool(int(i[1:]) % 2) for i, p in tests.items())
    best = result.where("ID = 'train_dataset_4_seq_top_1'").first()
    assert best["junction_aa"] == "CASSLGQ" and files.read_result(spark, out + "/none", out + "/predictions").count() == result.count()
    again = run(spark, str(train), [str(test)], out, skip_training=True)
    assert again.count() == result.count()


def test_histories(spark):
    rows = spark.createDataFrame([("a", i, v, 1.0 * i) for i, v in enumerate((0.5, 0.7, 0.6, 0.6, 0.8))], "run string, step int, auc double, s double")
    got = V.progress(rows, "run", "step", "auc", "s", 2).orderBy("step").collect()
    assert [r["waited"] for r in got] == [0, 0, 1, 2, 0] and got[-1]["mean_seconds"] == 3.5


@pytest.mark.parametrize("recipe", sorted(pipelines.RECIPES))
def test_each_recipe_ranks_in_its_own_way(spark, recipe):
    rep, meta, reference = toy(spark)
    fitted = pipelines.fit(recipe, rep, meta, reference)
    got = pipelines.ranked(fitted, rep, meta, reference).collect()
    best = got[0]
    # by templates, and by density with fewer windows, another sequence of the positives comes first; the longest
    # pattern is as long in several
    assert best["junction_aa"] in {"graph": ("CASSLW",), "patterns_fdr": ("CASSLW",), "patterns": ("CASSLGQ", "CASSLW", "CAWMLKT", "CAWMLW")}.get(recipe, ("CASSLGQ",))
    scores = [r["importance_score"] for r in got]
    assert scores == sorted(scores, reverse=True) and best["v_call"] in ("V0", "V1") or recipe == "graph"
    assert len({r["junction_aa"] for r in got}) == len(got)
    if recipe == "vocabulary":
        weights = {r["term"]: r["importance"] for r in fitted.term_importance().collect()}
        assert best["importance_score"] == pytest.approx(0.6 * weights["CASSLGQ"] + 0.3 + 0.1)
    if recipe == "differential":
        assert best["importance_score"] > 2


def test_a_vocabulary_of_any_size_is_joined(spark):
    rep, meta, _ = toy(spark)
    reference = spark.range(30_000).selectExpr("concat('Q', cast(id as string)) as junction_aa").union(spark.createDataFrame([("CASSLGQ",)], "junction_aa string"))
    fitted = pipelines.fit("vocabulary", rep, meta, reference)
    assert fitted.chosen.count() == 30_001
    assert all((r["probability"] > 0.5) == bool(int(r["repertoire_id"][1:]) % 2) for r in fitted.score(rep).collect())
    assert {r["term"] for r in fitted.term_importance().collect()} == {"CASSLGQ"}


def test_folds_are_fitted_at_a_time(spark):
    """Folds were fitted one after another, so that the driver's part of each added up."""
    import threading

    from pyspark.ml.classification import LogisticRegression

    together = threading.Barrier(5, timeout=60)

    class Waiting(LogisticRegression):
        def _fit(self, data):
            together.wait()
            return super()._fit(data)

    rows = spark.createDataFrame([(i, float(i % 2), i % 5, float(i)) for i in range(40)], "repertoire_id long, label double, fold int, x double")
    got = learned.out_of_fold(rows, lambda n: Waiting(maxIter=2, weightCol="weight"), ("x",))
    assert sorted(r["repertoire_id"] for r in got.collect()) == list(range(40))
