"""Results that smaller jobs would miss."""

import zlib

import numpy as np

from clonoscope.llm import jaccard, license, lm, mixing, packing

HELD = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
LEARNT = [i for i in range(200) if i not in HELD]


def test_lm_knows_bigrams_seen_once(spark):
    rows = [(i, " ".join(f"w{(i * 31 + k * k) % 40}" for k in range(20))) for i in LEARNT[:40]]
    once = "alpha beta gamma delta"
    rows += [(LEARNT[50], once), (HELD[0], once), (HELD[1], "delta gamma beta alpha")]
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[HELD[0]] > got[HELD[1]] + 0.1


def test_lm_filter_holds_all_in_shards(spark, monkeypatch):
    counts = spark.range(20_000).selectExpr("xxhash64(id) as h", "1 + id % 9 as c")
    rows = counts.toPandas()
    h, c = rows["h"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy()
    whole = lm.train(counts)
    monkeypatch.setattr(lm, "SHARD", 1 << 13)
    sharded = lm.train(counts)
    assert len(whole.shards) == 1 and len(sharded.shards) == whole.size >> 13
    assert (sharded.level(h) == whole.level(h)).all() and (whole.level(h) >= lm.levels(c)).all()
    other = np.arange(1, 20_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (sharded.level(other) > 0).mean() < 0.05
    assert lm._size(8 << 40) > 1 << 40  # no bound


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights",
    "gpl-3.0": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
}


def test_licenses_in_wrapped_lines(spark):
    rows = [(i, f"a line of talk\n\n{t}\n\nthe end of it") for i, t in enumerate(WRAPPED.values())]
    rows += [(8, WRAPPED["bsd"].replace("\n", "\n\n")), (9, "plain words of every day\nand others that follow")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["families"], r["n_confirmed"]) for r in license.scan_licenses(docs)[0].collect()}
    assert got == {**{i: (f, 1) for i, f in enumerate(WRAPPED)}, 8: ("", 0), 9: ("", 0)}


def test_packing_has_the_tokenizers_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing._encoder(packing.TOKENIZER)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y\n", "<|endoftext|", "plain  words, it's 12 ü", ""):
        assert ours.encode(text, allowed_special="all") == theirs.encode(text, add_special_tokens=False).ids


def test_packing_counts_the_added_token_once(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    assert [r["length"] for r in packing.pack(docs).collect()] == [5]


def test_classifiers_have_their_features_and_steps():
    assert (mixing.FEATURES, mixing.STEPS) == (1 << 14, 30) and (license.FEATURES, license.STEPS) == (1 << 16, 40)


def test_stage_keeps_one_row_of_each_component(spark):
    a, b, c = ("one two three four five six", "red green blue grey pink teal", "up down left right in out")
    rows = [(1, a), (1, a), (2, a), (2, b), (1, b), (None, c), (None, c), (None, a), (None, ""), (7, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r["doc_id"]), r["text"]) for r in jaccard.stage(spark, docs, "").collect())
    assert got == sorted([("1", a), ("1", b), ("None", c), ("None", ""), ("7", "")])
