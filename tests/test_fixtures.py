"""Hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from clonoscope.functions import sequence as S
from clonoscope.functions import stats
from clonoscope.operators import counts as C
from clonoscope.operators import diversity as D
from clonoscope.operators import enrich as E
from clonoscope.operators import evaluate as V
from clonoscope.operators import graph as G
from clonoscope.operators import ranking as R
from clonoscope.operators import sampling as P


@pytest.fixture
def rows(spark):
    bags = {"r1": (True, ["CASSLG", "CASSLG", "CASSXY", None]), "r2": (True, ["CASSLG", "AC"]), "r3": (False, ["CASSXY", "CAWML"])}
    data = [(r, i, s, y) for r, (y, seqs) in bags.items() for i, s in enumerate(seqs)]
    return spark.createDataFrame(data, "repertoire_id string, row_idx long, junction_aa string, label_positive boolean").where("length(junction_aa) >= 3")


def as_dict(df, key, *values):
    return {r[key]: tuple(r[v] for v in values) for r in df.collect()}


def test_row_and_presence_counts(rows):
    assert as_dict(C.row_counts(rows, "junction_aa"), "junction_aa", "pos_count", "neg_count") == {"CASSLG": (3, 0), "CASSXY": (1, 1), "CAWML": (0, 1)}
    assert as_dict(C.presence_counts(rows, "junction_aa"), "junction_aa", "pos_count", "neg_count") == {"CASSLG": (2, 0), "CASSXY": (1, 1), "CAWML": (0, 1)}


def test_witness(rows):
    ranked = R.rank_by_witness(C.row_counts(rows, "junction_aa"), F.lit(0.5))
    got = as_dict(ranked, "junction_aa", "witness", "witness_norm")
    assert got["CASSLG"] == (2.0, 1.0) and got["CAWML"] == (-1.0, 0.0)
    assert got["CASSXY"][1] == pytest.approx(1 / 3)
    with pytest.raises(ValueError):
        stats.witness(F.lit(1), F.lit(1), "other")


def test_tokens(spark):
    one = lambda c, s: spark.createDataFrame([(s,)], "s string").select(c).first()[0]
    assert one(S.kmers(F.col("s"), 3), "CASSLG") == ["CAS", "ASS", "SSL", "SLG"]
    assert one(S.kmers(F.col("s"), 3), "CA") == []
    assert one(S.kmers_with_gap(F.col("s"), 4), "CASSL") == ["CASS", "ASSL", "CA.SL"]
    for s, n in (("AC", 0), ("CASS", 4), ("CASSLG", 43), ("A" * 16, 313)):
        assert len(one(S.gapped_tokens(F.col("s")), s)) == n
    assert "A.LP" in one(S.gapped_tokens(F.col("s")), "AKLP")


def test_fisher_and_adjustment(spark):
    a, b, n = F.lit(3), F.lit(0), F.lit(10)
    assert spark.range(1).select(stats.fisher_greater(a, b, n, n)).first()[0] == pytest.approx(0.105263157894737, abs=1e-12)
    big = spark.range(1).select(stats.log_factorial(F.lit(1000))).first()[0]
    import math

    assert big == pytest.approx(math.lgamma(1001), rel=1e-14)
    p = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03), ("d", 0.5)], "kmer string, p_value double")
    got = as_dict(E.benjamini_hochberg(p), "kmer", "p_adjusted")
    assert [round(got[k][0], 9) for k in "abcd"] == [0.04, 0.04, 0.04, 0.5]


def test_moments(spark):
    rows = spark.createDataFrame([("r", float(x)) for x in (1, 2, 3, 10)], "repertoire_id string, x double")
    got = D.moments(rows, F.col("x")).first()
    want = {"std_pop": 3.535534, "std_samp": 4.082483, "q25": 1.75, "median": 2.5, "skew": 1.763633, "kurtosis": 3.228}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-5)


def test_length_histogram(spark):
    rows = spark.createDataFrame([("r", "A" * n) for n in (4, 5, 5, 24, 25, 26, 100, 101)], "repertoire_id string, junction_aa string")
    got = D.length_histogram(rows, list(range(5, 26)), 100).first()
    assert (got["len_5_6"] * 8, got["len_24_25"] * 8, got["len_25_100"] * 8) == (2, 1, 3)


def test_ties(spark):
    rows = spark.createDataFrame([("s", g, g) for g in "baba"], "junction_aa string, v_call string, j_call string")
    assert C.gene_mode(rows, "junction_aa").first()["v_call"] == "a"
    flat = R.normalised(spark.createDataFrame([("a", 1.0), ("b", 1.0)], "k string, x double"), "x")
    assert {r["x_norm"] for r in flat.collect()} == {1.0}


def test_downsample(spark):
    rows = spark.createDataFrame([("r", i, t) for i, t in enumerate((50, 30, 20))], "repertoire_id string, row_idx long, templates long")
    got = as_dict(P.downsampled(rows, ["row_idx"], 10), "row_idx", "templates")
    assert [got[i][0] for i in range(3)] == [4, 2, 4]
    assert P.downsampled(rows, ["row_idx"], 1000).agg(F.sum("templates")).first()[0] == 100
    dirty = spark.createDataFrame([(x,) for x in ("x", None, "0", "-1", "Infinity", "7")], "templates string")
    assert [r[0] for r in P.clean_templates(dirty).collect()] == [7.0]


def test_graph(spark):
    import math

    nodes = spark.createDataFrame([("r", i, [math.cos(math.radians(a)), math.sin(math.radians(a))]) for i, a in enumerate((0, 10, 90, 100))], "repertoire_id string, node_id long, x array<double>")
    links = G.edges(G.knn(nodes, 1))
    assert sorted((r["src"], r["dst"]) for r in links.collect()) == [(0, 1)] * 2 + [(1, 0)] * 2 + [(2, 3)] * 2 + [(3, 2)] * 2
    assert {r["deg"] for r in G.degrees(nodes, links).collect()} == {2}


def test_roc_with_ties(spark):
    scored = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "score double, label int")
    assert V.roc_auc(scored).first()[0] == pytest.approx(0.875)


def test_assembly(spark):
    ranked = spark.createDataFrame([("x_1", "train_dataset_1", "CASS", "J1")], "ID string, dataset string, junction_aa string, j_call string")
    got = R.assembled([ranked]).first()
    assert (got["v_call"], got["j_call"], got["label_positive_probability"]) == ("-999.0", "J1", -999.0)
    assert R.validated(R.assembled([ranked])).first()["n_null"] == 0
