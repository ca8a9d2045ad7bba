"""Operators against plain versions of themselves."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from clonoscope.llm import jaccard, license, lm, mixing, packing, toxicity, words
from test_edges import brute_components


def ids_of(rows, column):
    return {r["doc_id"]: r[column] for r in rows}


def near_copies(r, base, vocabulary, edits):
    out = list(base)
    for at in r.sample(range(len(base)), edits):
        out[at] = r.choice(vocabulary)
    return " ".join(out)


def test_jaccard_many_middling_groups_on_one_passage(spark):
    """Groups of near copies that all hold one passage, with copies near the threshold."""
    r = random.Random(11)
    vocabulary = [f"v{i}" for i in range(4000)]
    passage = r.choices(vocabulary, k=60)
    texts = []
    for _ in range(9):
        base = passage + r.choices(vocabulary, k=r.choice((10, 14, 60)))
        texts += [near_copies(r, base, vocabulary, r.choice((0, 1, 2, 3, 4, 5))) for _ in range(14)]
    want, sizes = brute_components(texts)
    got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert ids_of(got, "n_shingles") == dict(enumerate(sizes)) and ids_of(got, "component_id") == dict(enumerate(want))


def test_jaccard_beyond_the_told_shingles(spark, monkeypatch):
    """Few shingles are told and columns are heavy early: the same classes."""
    monkeypatch.setattr(jaccard, "TOLD", 5)
    monkeypatch.setattr(jaccard, "HEAVY", 30)
    r = random.Random(12)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = r.choices(vocabulary, k=90)
    texts = [near_copies(r, base, vocabulary, r.choice((0, 1, 2, 3, 4, 5))) for _ in range(70)]
    texts += [" ".join(base[:40] + r.choices(vocabulary, k=r.choice((4, 9, 40)))) for _ in range(50)]
    want, _ = brute_components(texts)
    got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)).collect()
    assert ids_of(got, "component_id") == dict(enumerate(want))


def test_shingles_of_many_texts_are_those_of_each():
    r, hashes = random.Random(3), words.WordHashes()
    texts = [" ".join(r.choices("abcdefg", k=k)).encode() for k in (0, 1, 3, 4, 5, 6, 40, 0, 200)]
    each = [hashes(t) for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in each])])
    values, at = jaccard.shingle_sets(np.concatenate(each), bounds)
    for i, w in enumerate(each):
        alone, _ = jaccard.shingle_sets(w, np.array([0, len(w)]))
        assert (values[at[i] : at[i + 1]] == alone).all()
        tokens = texts[i].split()
        assert len(alone) == len({tuple(tokens[j : j + 5]) for j in range(len(tokens) - 4)} if len(tokens) >= 5 else {tuple(tokens)} - {()})


def test_lm_score_is_near_the_exact_model(spark):
    """The filter's quantised counts against exact ones: within a tenth of a decimal digit a token, on average."""
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(200)]
    texts = {i: " ".join(r.choices(vocabulary, weights=[1 / (k + 1) for k in range(200)], k=r.choice((5, 40, 120)))) for i in range(150)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    tokens = {i: [*t.split(), "<end>"] for i, t in texts.items()}
    one = Counter(w for i in texts if not held[i] for w in tokens[i])
    two = Counter(p for i in texts if not held[i] for p in zip(["<end>", *tokens[i]], tokens[i], strict=False))
    total = sum(one.values()) + len(one) + 1

    def exact(i):
        out = 0.0
        for h, w in zip(["<end>", *tokens[i]], tokens[i], strict=False):
            p = (one[w] + 1) / total
            out += math.log10(min(1.0, lm.WEIGHT * (two[h, w] + lm.PRIOR * p) / (one[h] + lm.PRIOR) + (1 - lm.WEIGHT) * p))
        return out

    got = ids_of(lm.score_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), "score")
    errors = [abs(got[i] - exact(i)) / len(tokens[i]) for i in texts]
    assert sum(errors) / len(errors) < 0.1 and max(errors) < 0.25


def test_packing_ids_are_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["plain words of a text", "<|endoftext|> x <|endoftext|>", "ünïcödé — 日本 \n\n  spaces\t", "", "w " * 5000, "it's 1234567 O'Neill"]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, t in enumerate(texts):
        ids = [*theirs.encode(t, add_special_tokens=False).ids, 0]
        pieces = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [p["start"] for p in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
        assert sum(p["length"] for p in pieces) == len(ids)
        assert all(p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], dtype="<u4").tobytes()) for p in pieces)
        assert all(p["length"] == 2048 for p in pieces[1:])


def test_mixing_reaches_its_targets(spark):
    """The shares that rates reach, worked out from posteriors by hand, are the targets within a hundredth."""
    rows = [(i, " ".join(f"{'xyz'[i % 3]}{(i * k) % 17}" for k in range(20 + i % 9)), "xyz"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(150)], "doc_id long, quality int")
    targets = {"x+": 0.5, "y+": 0.3, "z+": 0.2}
    rates = mixing.mix(docs, labels, targets)
    got = {r["domain"]: r["reached"] for r in mixing.shares(rates, targets).collect()}
    held = rates.collect()
    whole = sum(r["rate"] * r["n_tokens"] for r in held)
    by_hand = {d: sum(r["rate"] * r["n_tokens"] * r["posterior"][k] for r in held) / whole for k, d in enumerate(held[0]["domains"])}
    assert got == pytest.approx(by_hand) and all(abs(got[d] - v) < 0.01 for d, v in targets.items())


def test_toxicity_score_is_the_noisy_or(spark):
    model = toxicity.Model({"vile": 4.0, "word*": 2.0, "calm": -1.0}, bias=-2.0, leak=0.1)
    text = "Calm here. A VILE wordy thing!\nwords, vile vile"
    logits = [-1.0 - 2.0, 4.0 + 2.0 - 2.0, 2.0 + 8.0 - 2.0]
    want = 1 - 0.9 * math.prod(1 - 1 / (1 + math.exp(-z)) for z in logits)
    got = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert got["score"] == pytest.approx(want) and got["n_sentences"] == 3
    assert [text[s["start"] : s["end"]] for s in got["offending"]] == [" A VILE wordy thing", "words, vile vile"]


def test_toxicity_takes_whole_texts_up_to_its_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "CHARACTERS", 450)
    got = toxicity.labelled_sample(docs, labels).collect()
    assert len(got) == 5 and {len(r["text"]) for r in got} == {100}


def test_license_scores_are_the_fitted_coefficients(spark):
    rows = [(i, "words of every day\nReleased under the MIT License.\nLicensed under CC BY 4.0.\n" + f"line {i} of talk and more talk") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classifier = license.train(docs)
    _, findings = license.scan_licenses(docs.where("doc_id = 3"), classifier)
    got = {r["paragraph"]: (r["family"], r["probability"], r["likeness"]) for r in findings.where("more = 0").collect()}
    place = {t: i for i, t in enumerate(classifier.vocabulary.vocabulary)}
    matrix, intercept = classifier.model.coefficientMatrix.toArray(), classifier.model.interceptVector.toArray()
    for line, text in enumerate(["words of every day", "released under the mit license", "licensed under cc by 4.0", "line 3 of talk and more talk"]):
        w = text.split()
        terms = {place[t] for t in [*w, *map(" ".join, zip(w, w[1:], strict=False))] if t in place}
        logits = intercept + matrix[:, sorted(terms)].sum(axis=1)
        e = np.exp((logits - logits.max()) / classifier.temperature)
        family, p = license.FAMILIES[int(logits.argmax())], float(e.max() / e.sum())
        assert (line in got) == (family != license.UNKNOWN and p >= license.CERTAIN)
        if line in got:
            assert got[line][0] == family and got[line][1] == pytest.approx(p)
    assert got[1][0] == "mit" and got[1][2] == 1.0


def test_toxicity_sample_counts_words_and_stems_by_sentence(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "Vile words. !! Wordy calm\nrare") for i in (0, 1, 3, 4, 5, 8, 9, 10)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic")
    monkeypatch.setattr(toxicity, "LEAST_DOCS", 2)
    monkeypatch.setattr(toxicity, "BLOCK", 2)
    took = []
    monkeypatch.setattr(toxicity, "fit", took.append)
    toxicity.train(docs, labels)
    (sample,) = took
    n, names = len(sample.labels), sample.names
    assert [names[i] for i in sample.words] == ["vile", "words", "wordy", "calm", "rare"] * n
    assert sample.sizes.tolist() == [2, 2, 1] * n and sample.owner.tolist() == [d for d in range(n) for _ in range(3)]
    stems = sample.stems
    assert {w: names[stems[i]] for i, w in enumerate(names) if stems[i] < len(names)} == {"vile": "vile*", "words": "word*", "wordy": "word*", "calm": "calm*", "rare": "rare*"}
    blocks = sample.blocks()
    assert [s.start for s, _ in blocks] == [0] + [s.stop for s, _ in blocks[:-1]] and blocks[-1][0].stop == len(sample.sizes)
    assert all(int(sample.sizes[s].sum()) == w.stop - w.start for s, w in blocks) and blocks[-1][1].stop == len(sample.words)
