"""MinHash classes against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from clonoscope.llm import minhash


def sets_of(texts):
    out = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    return out


def all_pairs(texts, percent=85):
    sets = sets_of(texts)
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), root(i) == i) for i, s in enumerate(sets)}


def edited(r, words, edits, vocabulary):
    out = list(words)
    for at in r.sample(range(len(out)), edits):
        out[at] = r.choice(vocabulary)
    return " ".join(out)


def found(spark, texts, **k):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, **k).collect()}


def test_groups_around_the_threshold(spark):
    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    passage, texts = r.choices(vocabulary, k=60), []
    for _ in range(25):
        base = r.choice(([], passage)) + r.choices(vocabulary, k=r.choice((7, 30, 120, 400)))
        texts += [edited(r, base, min(len(base), r.choice((0, 0, 1, 2, 3, 5, 8))), vocabulary) for _ in range(8)]
        texts.append(" ".join(base).upper())
    texts += ["", " \n", "one two", "two one", "one two", "a b c d e", "A b c d E"]
    assert found(spark, texts) == all_pairs(texts)


def test_a_large_group_and_pages_of_one_template(spark, monkeypatch):
    """Copies that link only through others, and pages that share most of their words and do not link."""
    monkeypatch.setattr(minhash, "PART", 16)
    r = random.Random(9)
    vocabulary = [f"v{i}" for i in range(5000)]
    base, template = r.choices(vocabulary, k=300), r.choices(vocabulary, k=180)
    texts = [edited(r, base, r.choice((2, 4, 5, 6)), vocabulary) for _ in range(120)]
    texts += [" ".join(template + r.choices(vocabulary, k=r.choice((20, 24, 28, 34, 40)))) for _ in range(120)]
    assert found(spark, texts) == all_pairs(texts)


@pytest.mark.parametrize(("positions", "distance", "errors"), [(96, 35, 1), (24, 11, 2), (10, 4, 0), (7, 6, 1)])
def test_all_within_the_distance_share_a_key(positions, distance, errors):
    r = np.random.default_rng(1)
    one = r.integers(0, 256, (400, positions), dtype=np.uint8)
    two = one.copy()
    for row in two:
        at = r.choice(positions, r.integers(0, distance + 1), replace=False)
        row[at] ^= r.integers(1, 256, len(at), dtype=np.uint8)
    n = 400
    batch = pa.record_batch([pa.array(range(2 * n), pa.int64()), pa.array([1] * 2 * n, pa.int64()), pa.array([x.tobytes() for x in [*one, *two]], pa.binary())], names=["c", "n", "signature"])
    keys = {}
    for b in minhash._indexed(positions, distance, errors)(iter([batch])):
        for k, c in zip(b["key"].to_pylist(), b["c"].to_pylist(), strict=True):
            keys.setdefault(c, set()).add(k)
    assert all(keys[i] & keys[n + i] for i in range(n))
    if positions == 96:
        assert sum(bool(keys[i] & keys[j]) for i in range(30) for j in range(i)) == 0


def test_a_pair_is_made_once(spark):
    """30 sets that share 200 shingles, and pairs of which share 30 more, meet once each and not at every shingle."""
    tokens = lambda i: [*range(200), *range(1000 * (i // 2), 1000 * (i // 2) + 30)] if i > 1 else [*range(200), *range(5000 * (i + 20), 5000 * (i + 20) + 30)]
    sets = spark.createDataFrame([(i, tokens(i), [-1] * minhash.MAP) for i in range(30)], "c long, tokens array<long>, bits array<long>")
    open_ = spark.createDataFrame([(i, 230, i) for i in range(30)], "c long, n long, label long")
    met = minhash._across(minhash._open(minhash._prefixes(open_, sets, 75)), 75)
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in met.collect()]
    assert len(set(pairs)) == 30 * 29 // 2
    assert len(pairs) == len(set(pairs))


def test_signatures_tell_likeness():
    r = np.random.default_rng(2)
    shared, own = r.integers(0, 1 << 63, 700, dtype=np.uint64), r.integers(0, 1 << 63, 300, dtype=np.uint64)
    values = np.concatenate([np.sort(shared), np.sort(np.concatenate([shared, own]))])
    one, two = minhash.signatures(values, np.array([0, 700, 700, 1700]), 256)
    assert abs((one == two).mean() - 0.7) < 0.1


def test_edges(spark):
    text = "one two three four five six seven"
    rows = [(None, text, "x"), (4, text, "x"), (4, text, "y"), (4, "other words", "x"), (2, None, "x"), (None, "", "x"), (None, "alone here", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted(tuple(map(str, r)) for r in minhash.near_duplicates(docs).collect())
    assert got == sorted([("None", "3", "4", "False"), ("4", "3", "4", "True"), ("4", "3", "4", "True"), ("4", "1", "4", "True"), ("2", "0", "2", "True"), ("None", "0", "None", "True"), ("None", "1", "None", "True")])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
