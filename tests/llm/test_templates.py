"""Pages of one template that do not link: the right components, and joins in proportion."""

import random

from clonoscope.llm import jaccard
from test_edges import brute_components


def pages(n, seed=5, words=200, own=(40, 50, 60)):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(20_000)]
    template = r.choices(vocabulary, k=words)
    return [" ".join(template + r.choices(vocabulary, k=r.choice(own))) for _ in range(n)]


def test_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 16)
    r = random.Random(6)
    texts = pages(130)
    texts += [t + " and one more" for t in r.sample(texts, 20)] + pages(40, 7, 200, (5, 12, 20, 30))
    want, _ = brute_components(texts)
    got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == dict(enumerate(want))


def test_pages_that_their_own_shingles_tell_apart_do_not_meet(spark, monkeypatch):
    met = []
    across = jaccard._across
    monkeypatch.setattr(jaccard, "_across", lambda index: met.append(across(index).count()) or across(index))
    texts = pages(300)
    got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(x["doc_id"] == x["component_id"] for x in got) and sum(met) <= len(texts)


def test_repeated_rows_bring_a_set_once(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(58))
    rows = [(1, a)] * 40 + [(2, b)] * 40
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 80 and {x["component_id"] for x in got} == {1}
