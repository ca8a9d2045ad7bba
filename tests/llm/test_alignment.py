"""Token alignment against a plain version that goes token by token."""

import hashlib
import random
from collections import Counter

import pytest

from clonoscope.llm import alignment


def plain(texts):
    """Rows by place: n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    one = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters = {}
    spare = 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            letters[chr(b)] = b
        else:
            letters[chr(256 + spare)] = b
            spare += 1
    assert ByteLevel().decode(["Ġa"]) == " a"

    def piece(i):
        p = two.id_to_piece(i)
        return bytes([int(p[1:-1], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    rows, links_of = [], []
    for text in texts:
        whole = f" {text}".encode()
        a = [(i, bytes(letters[c] for c in one.id_to_token(i))) for i in one.encode(f" {text}", add_special_tokens=False).ids] if text else []
        b = [(i, piece(i)) for i in two.encode(text)] if text else []
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            rows.append([0, 0, 0, 0, ""])
            links_of.append([])
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, begin = [], 0
        for end in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if begin <= s and e <= end) for side in spans))
            begin = end
        links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e]
        rows.append([len(a), len(b), len(cuts), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()])
        links_of.append(links)
    count = Counter(p for links in links_of for p in set(links))
    most = Counter()
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    return [(*r, sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links)) for r, links in zip(rows, links_of, strict=True)], count, most


ALPHABET = [*"abcdefgthe    \n\t.,'1203éß漢字🙂​́﻿\x00", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "the", " of", "  ", "▁", "ing ", "internationalisation", "▁"]


@pytest.mark.parametrize("block", [alignment.BLOCK, 40])
def test_as_token_by_token(spark, block):
    r = random.Random(5)
    texts = ["".join(r.choices(ALPHABET, k=r.choice((1, 3, 12, 40)))) for _ in range(150)]
    texts += ["", " ", "a", "\n", "the the the", "the the the", "x" * 3000, "plain words of everyday talk " * 200]
    want, count, most = plain(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got, pairs = alignment.align(docs, block=block)
    names = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in got.collect()} == dict(enumerate(want))
    assert {(r["a_id"], r["b_id"]): (r["count"], r["best"]) for r in pairs.collect()} == {p: (n, n == most[p[0]]) for p, n in count.items()}


def test_pieces_of_a_batch_do_not_matter(spark, monkeypatch):
    sides = alignment._Sides(*alignment.TOKENIZERS)
    texts = ["one two", "", "three▁", "four five six", " "]
    counts, hashes, pairs, times, bounds = alignment._aligned(sides, texts)
    for k, t in enumerate(texts):
        c, h, p, n, _ = alignment._aligned(sides, [t])
        assert c[:, 0].tolist() == counts[:, k].tolist() and h == [hashes[k]]
        assert p.tolist() == pairs[bounds[k] : bounds[k + 1]].tolist() and n.tolist() == times[bounds[k] : bounds[k + 1]].tolist()


def test_edges(spark):
    rows = [(None, "a word", "x"), (1, None, "x"), (2, "", "x"), (3, "a word", "x"), (3, "a word", "y"), (4, "not▁a space", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string")
    got = alignment.align(docs)[0].collect()
    assert sorted((str(r["doc_id"]), r["n_a"], r["count_sum"]) for r in got) == [("1", 0, 0), ("2", 0, 0), ("3", 2, 6), ("3", 2, 6), ("4", 0, 0), ("None", 2, 6)]
    assert alignment.align(docs.limit(0))[0].count() == 0
