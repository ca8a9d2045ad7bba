"""Sources, sinks and streams on small files."""

from pyspark.sql import functions as F

from clonoscope.operators import sampling as P
from clonoscope.sources import files, store
from clonoscope.streaming import counts as stream_counts


def test_repertoires_round_trip(spark, tmp_path):
    folder = tmp_path / "train_dataset_3"
    folder.mkdir()
    (folder / "a.tsv").write_text("junction_aa\tv_call\tj_call\ttemplates\nCASS\tV1\tJ1\t3\nCAWM\tV2\tJ1\tx\n")
    (folder / "b.tsv").write_text("junction_aa\tv_call\tj_call\ttemplates\nCASS\tV1\t\t2\n")
    (folder / "notes.txt").write_text("no")
    rows = files.read_repertoires(spark, str(folder)).collect()
    assert {(r["repertoire_id"], r["dataset"], r["junction_aa"], r["templates"]) for r in rows} == {("a", "train_dataset_3", "CASS", 3), ("a", "train_dataset_3", "CAWM", None), ("b", "train_dataset_3", "CASS", 2)}
    assert {r["d_call"] for r in rows} == {None}
    (tmp_path / "metadata.csv").write_text("repertoire_id,filename,label_positive\na,a.tsv,True\nb,b.tsv,False\nc,c.tsv,maybe\n")
    meta = files.read_metadata(spark, str(tmp_path / "metadata.csv"))
    assert {r["repertoire_id"]: r["label_positive"] for r in meta.collect()} == {"a": True, "b": False, "c": None}
    whole = files.labelled_or_empty(meta, files.read_repertoires(spark, str(folder)))
    assert whole.where("repertoire_id = 'c'").count() == 1
    assert files.content_key(whole).count() == 3


def test_names():
    assert files.dataset_number("/x/train_dataset_7") == 7
    assert files.pairs_of(["train_dataset_1"], ["test_dataset_1", "test_dataset_2", "test_dataset_1_2"]) == {"train_dataset_1": ["test_dataset_1", "test_dataset_1_2"]}


def test_sinks(spark, tmp_path):
    rep = spark.createDataFrame([("a", "CASS", 30), ("a", "CAWM", 10)], "repertoire_id string, junction_aa string, templates long")
    files.write_parts(rep, str(tmp_path / "parts"))
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 2
    got = files.manifest(rep, P.downsampled(rep, ["junction_aa"], 20)).first()
    assert (got["original_templates"], got["downsampled_templates"], got["reduction_pct"]) == (40, 20, 50.0)
    files.write_json(rep, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).agg(F.sum("templates")).first()[0] == 40


def test_stream(spark, tmp_path):
    spark.createDataFrame([("CASS", True), ("CASS", False), ("CAWM", True)], "junction_aa string, label_positive boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("junction_aa string, label_positive boolean").parquet(str(tmp_path / "in"))
    stream_counts.start(stream_counts.incremental_counts(stream), "witness_stream", str(tmp_path / "state")).awaitTermination(120)
    assert {(r[0], r[1], r[2]) for r in spark.table("witness_stream").collect()} == {("CASS", 1, 1), ("CAWM", 1, 0)}


def test_folders_with_unlike_headers(spark, tmp_path):
    a, b = tmp_path / "test_dataset_1", tmp_path / "test_dataset_2"
    a.mkdir(), b.mkdir()
    (a / "x.tsv").write_text("junction_aa\tv_call\tj_call\nCASS\tnan\tJ1\n")
    (a / "y.tsv").write_text("templates\td_call\tj_call\tv_call\tjunction_aa\n5\tD1\tJ2\tV2\t CAWM \nbad\tD1\t\tV2\tnan\n")
    (b / "x.tsv").write_text("v_call\tjunction_aa\tnote\nV3\tCTTT\tz\n")
    (b / "empty.tsv").write_text("")
    rows = files.read_repertoires(spark, str(a), str(b))
    got = {(r["dataset"], r["repertoire_id"], r["junction_aa"], r["v_call"], r["j_call"], r["d_call"], r["templates"]) for r in rows.collect()}
    assert got == {
        ("test_dataset_1", "x", "CASS", None, "J1", None, None),
        ("test_dataset_1", "y", "CAWM", "V2", "J2", "D1", 5),
        ("test_dataset_1", "y", None, "V2", None, "D1", None),
        ("test_dataset_2", "x", "CTTT", "V3", None, None, None),
    }
    (tmp_path / "none").mkdir()
    assert files.read_repertoires(spark, str(tmp_path / "none")).count() == 0


def test_keys_tell_nulls_apart(spark):
    rows = spark.createDataFrame([("a", "CASS", None, "J1"), ("b", "CASS", "J1", None), ("c", "CASS", "", "J1")], "repertoire_id string, junction_aa string, v_call string, j_call string")
    keys = {r["content_key"] for r in files.content_key(rows).collect()}
    assert len(keys) == 3 and not keys & {r["content_key"] for r in files.content_key(rows, "k=5").collect()}
    assert {r["repertoire_id"]: r["same"] for r in files.verified(rows.where("repertoire_id <> 'c'"), rows).collect()} == {"a": True, "b": True, "c": False}


def test_results(spark, tmp_path):
    result = spark.createDataFrame([("r1", "d", 0.5, "-999.0", "-999.0", "-999.0"), ("t1", "d", -999.0, "CASS", "V1", "J1")], "ID string, dataset string, label_positive_probability double, junction_aa string, v_call string, j_call string")
    files.write_result(result, str(tmp_path / "named"))
    assert {tuple(r) for r in files.read_result(spark, str(tmp_path / "missing"), str(tmp_path / "named")).select("ID", "label_positive_probability").collect()} == {("r1", "0.5"), ("t1", "-999.0")}
    manifest = files.result_manifest(result).first()
    assert (manifest["n"], manifest["n_probabilities"], manifest["n_sequences"]) == (2, 1, 1)


def test_caches(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert store.cached(spark, [str(tmp_path / "new"), str(tmp_path / "old")], "key", make).count() == 3
    assert made == [1]
    ids = spark.createDataFrame([("a",), ("b",)], "repertoire_id string")
    rows = lambda todo: todo.withColumn("n", F.lit(len(made)))
    assert store.added(spark, str(tmp_path / "graphs"), ids.limit(1), rows).count() == 1
    made.append(1)
    assert {r["n"] for r in store.added(spark, str(tmp_path / "graphs"), ids, rows).collect()} == {1, 2}
    store.write_about(spark, {"k": [1, 2]}, str(tmp_path / "about"))
    assert store.read_about(spark, str(tmp_path / "about")) == {"k": [1, 2]}


def test_other_draws(spark):
    rows = spark.createDataFrame([("r", i, 50) for i in range(4)], "repertoire_id string, row_idx long, templates long")
    assert P.downsampled(rows, ["row_idx"], 30, draws="choice").agg(F.sum("templates")).first()[0] == 30
