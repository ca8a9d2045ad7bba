"""Divergence of sources against a plain version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from clonoscope.llm import divergence


def plain(rows, least, top):
    rows = [(lang or "", source or "", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) for _, text, lang, source in rows]
    docs, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        docs[lang].update(set(found))
        n[lang, source].update(found)
    out = set()
    for lang in {r[0] for r in rows}:
        kept = [t for t, k in docs[lang].items() if k >= least]
        groups = sorted(s for x, s in n if x == lang)
        share = lambda c: {t: 1 + (10**9 * (c[t] + 5)) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(n[lang, s]) for s in groups}
        q = share(sum((n[lang, s] for s in groups), Counter()))
        for s in groups:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(found)}
    return out


def table(seed=3, n=400):
    r = random.Random(seed)
    words = [*"Ab ab éé É ÉÉ 漢字 it's x1y a_b Straße K".split(), *(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120))]
    out = []
    for i in range(n):
        lang = r.choice(["en", "en", "en", "de", None, ""])
        source = r.choice([*(f"s{k}" for k in range(9)), "Ω", None]) if lang == "en" else r.choice(["one", "s1"])
        out.append((i, " ".join(r.choices(words, weights=[3 if (hash_ := (k * 7 + len(source or "")) % 5) else 1 for k in range(len(words))], k=r.choice((0, 1, 30)))) if r.random() < 0.95 else None, lang, source))
    return [*out, (900, "lonely words", "fr", "only"), (901, "of few", "it", "a"), (902, None, "it", "b"), (903, "", "en", "wordless")]


@pytest.mark.parametrize(("terms", "groups", "least", "top"), [(1024, 256, 30, 50), (16, 3, 5, 4), (1, 1, 30, 2)])
def test_as_plain(spark, terms, groups, least, top):
    rows = table()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {tuple(r) for r in divergence.divergence(docs, least=least, top=top, terms=terms, groups=groups).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == plain(rows, least, top)


def test_shares_are_whole_numbers():
    counts, of = np.array([[0, 1, 10**15, 9 * 10**15]]), np.array([[9 * 10**15 + 7]])
    assert divergence._shares(counts, of)[0].tolist() == [1 + 10**9 * c // int(of[0, 0]) for c in counts[0].tolist()]


def test_edges(spark):
    schema = "term string, doc_id long, text string, lang string, source string, value string"
    docs = spark.createDataFrame([("x", None, None, None, None, "y"), ("x", 1, "", None, "b", "y")], schema)
    assert sorted(tuple(r) for r in divergence.divergence(docs).collect()) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]
    assert divergence.divergence(docs.limit(0)).count() == 0
    assert divergence.divergence(docs.limit(1)).count() == 0
