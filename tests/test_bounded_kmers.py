"""K-mers of repertoires are counted in as many tasks as their letters need."""

from collections import Counter

from clonoscope.operators import counts as C


def test_kmers_are_dealt_by_letters(spark, monkeypatch):
    words = {r: [f"{chr(65 + (r * 7 + i * i) % 26)}A{chr(65 + i % 5)}A" for i in range(30)] + ["A", "AAAA"] for r in range(40)}
    rep = spark.createDataFrame([(r, w) for r, some in words.items() for w in some], "repertoire_id long, junction_aa string")
    monkeypatch.setattr(C, "LETTERS", 500)
    got = C.kmer_counts(rep, 2, 40 * 125)
    assert got.rdd.getNumPartitions() == 10
    want = {r: Counter(w[i : i + 2] for w in some for i in range(len(w) - 1)) for r, some in words.items()}
    assert {(x["repertoire_id"], x["kmer"]): x["cnt"] for x in got.collect()} == {(r, g): n for r, c in want.items() for g, n in c.items()}
    assert C.kmer_counts(rep.limit(0), 2, None).count() == 0
