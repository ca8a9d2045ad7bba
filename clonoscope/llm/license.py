"""Licence scanning by a trained paragraph classifier, in DataFrame and pyspark.ml operations only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoscope.llm.common import cut, table

UNKNOWN = "unknown"
#: Notices and key sentences by licence family.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file in the project root for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License.",
    ),
    "lgpl-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "agpl-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "mpl-2.0": (
        "Released under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": ("Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
}
FAMILIES = (*sorted(TEMPLATES), UNKNOWN)
#: Documents whose paragraphs teach the unknown class, at most, by the order of a hash of their id.
SAMPLE = 300
#: Words and word pairs that are features at most, the training rows that each must stand in, and steps.
FEATURES, LEAST_ROWS, STEPS, PENALTY = 1 << 16, 2, 40, 1e-4
#: Calibrated probability from which a family counts, and the share of a template's word triples that confirms it.
CERTAIN, CONFIRMED = 0.5, 0.6
TEMPERATURES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and dots inside numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:\.[\p{N}]+)*"), F.lit(0))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often `then` names it and wherever the optimiser puts it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def grams(w: Column, n: int) -> Column:
    """Word n-grams; none where there are fewer words."""
    each = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    return once(w, lambda w: F.when(F.size(w) >= n, each(w)).otherwise(F.array().cast("array<string>")))


def _terms(rows: DataFrame) -> DataFrame:
    """rows(words) with their words and word pairs."""
    return rows.withColumn("terms", once(F.col("words"), lambda w: F.concat(w, F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.coalesce(F.concat(a, F.lit(" "), b), a)))))


@dataclass
class Classifier:
    vocabulary: CountVectorizerModel
    model: LogisticRegressionModel
    temperature: float


@dataclass
class Templates:
    """The fixed templates' words, from the same function that cuts texts into words."""

    rows: list[tuple[int, list[str]]]

    @staticmethod
    def read(spark: SparkSession) -> Templates:
        return Templates([(r["label"], r["words"]) for r in _templates(spark).select("label", "words").collect()])

    @staticmethod
    def triples(w: list[str]) -> list[str]:
        return list(dict.fromkeys(" ".join(w[i : i + 3]) for i in range(len(w) - 2)))

    @property
    def longest(self) -> int:
        return max(len(w) for _, w in self.rows)

    @staticmethod
    def strings(values: list[str]) -> Column:
        return F.array(*map(F.lit, values)).cast("array<string>")

    def of_family(self) -> Column:
        """By label, the triples of each of its templates."""
        return F.array(*[F.array(*[self.strings(self.triples(w)) for label, w in self.rows if label == k]) for k in range(len(FAMILIES) - 1)])

    def every(self) -> Column:
        return F.array(*[self.strings(self.triples(w)) for _, w in self.rows])

    def known(self) -> Column:
        """All templates' triples."""
        return self.strings(sorted({g for _, w in self.rows for g in self.triples(w)}))

    def words(self) -> Column:
        return self.strings(sorted({x for _, w in self.rows for x in w}))

    def needed(self) -> Column:
        """Of each template its distinct words, and how many of them any text has that has enough of its triples. Each
        missing word spoils the triples that hold it, and a triple is counted for three words at most."""
        each = []
        for _, w in self.rows:
            triples, distinct = self.triples(w), sorted(set(w))
            spare = 3 * math.floor((1 - CONFIRMED) * len(triples) + 1e-9)
            missing = 0
            for spoilt in sorted(sum(x in g.split(" ") for g in triples) for x in distinct):
                spare -= spoilt
                missing += spare >= 0
            each.append(F.struct(self.strings(distinct).alias("words"), F.lit(len(distinct) - missing).alias("least")))
        return F.array(*each)


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(FAMILIES.index(f), i, t) for f in FAMILIES if f != UNKNOWN for i, t in enumerate(TEMPLATES[f])]
    return spark.createDataFrame(rows, "label int, part int, text string").withColumn("words", words(F.col("text")))


def _probability(raw: Column, temperature: Column) -> Column:
    """Softmax of logits over a temperature."""
    scaled = once(raw, lambda r: F.transform(r, lambda x: x / temperature))
    e = once(scaled, lambda v: once(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))))
    return once(e, lambda v: once(F.aggregate(v, F.lit(0.0), lambda a, y: a + y), lambda whole: F.transform(v, lambda x: x / whole)))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Multinomial logistic regression over words and word pairs, with a sparse penalty.

    Families learn from their templates, each with variants that lack every fifth word or have some of its words
    repeated before it; the unknown class from the paragraphs of at most SAMPLE documents that share no
    word triple with a template. Features are the terms of at least LEAST_ROWS training rows, FEATURES at most. Every
    third row is kept back to choose the temperature that calibrates the
    probabilities, the unknown class's among them. The sample is chosen by ids; texts stay where they are read."""
    spark = docs.sparkSession
    known = _templates(spark)
    fixed = Templates.read(spark)
    variants = known.select("label", "words").union(
        known.select("label", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"), "words").select("label", F.expr("filter(words, (w, i) -> i % 5 <> k)"))
    ).union(known.select("label", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"), "words").select("label", F.expr("concat(slice(words, 1 + k, k), words)")))
    keyed = docs.select(F.col(f"`{id_col}`").alias("i"), F.xxhash64(F.lit("t"), f"`{text_col}`").alias("t"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    chosen = keyed.select(F.struct("i").alias("ci"), F.col("t").alias("ct")).orderBy(F.xxhash64("ci"), "ct").limit(SAMPLE).distinct()
    sample = keyed.join(F.broadcast(chosen), F.struct("i").eqNullSafe(F.col("ci")) & (F.col("t") == F.col("ct")), "left_semi")
    other = (
        sample.select(F.explode(F.split("text", "\n")).alias("p"))
        .select(words(F.col("p")).alias("words"))
        .where(F.size("words") > 0)
        .where(~F.arrays_overlap(grams(F.col("words"), 3), fixed.known()))
        .select(F.lit(len(FAMILIES) - 1).alias("label"), "words")
    )
    # families together weigh as much as the unknown class, whose rows stand for nearly all paragraphs
    rows = cut(_terms(variants.unionByName(other).repartition(2)).withColumn("fold", F.pmod(F.xxhash64("words"), F.lit(3))).withColumn("weight", F.when(F.col("label") < len(FAMILIES) - 1, 10.0).otherwise(1.0)).withColumn("label", F.col("label").cast("double")))
    vocabulary = CountVectorizer(inputCol="terms", outputCol="features", vocabSize=FEATURES, minDF=LEAST_ROWS, binary=True).fit(rows)
    rows = vocabulary.transform(rows)
    model = LogisticRegression(family="multinomial", maxIter=STEPS, regParam=PENALTY, elasticNetParam=0.5, standardization=False, weightCol="weight", aggregationDepth=2).fit(rows.where("fold > 0"))
    if model.numClasses != len(FAMILIES):  # no unknown paragraph in the sample
        model = LogisticRegression(family="multinomial", maxIter=STEPS, regParam=PENALTY, standardization=False).fit(rows)
    held = model.transform(rows.where("fold = 0")).select(F.col("label").cast("int").alias("y"), vector_to_array("rawPrediction").alias("raw"), "weight")
    loss = [F.sum(-F.col("weight") * F.log(F.greatest(F.get(_probability(F.col("raw"), F.lit(t)), F.col("y")), F.lit(1e-12)))).alias(str(i)) for i, t in enumerate(TEMPERATURES)]
    got = held.agg(*loss).first()
    best = min(range(len(TEMPERATURES)), key=lambda i: (got[i] if got[i] is not None else 0.0, abs(TEMPERATURES[i] - 1)))
    return Classifier(vocabulary, model, TEMPERATURES[best])


def _share(g: Column, own: Column) -> Column:
    """The share of a template's triples that are among others."""
    return F.size(F.array_intersect(g, own)) / F.greatest(F.size(g), F.lit(1))


def _found(rows: DataFrame, classifier: Classifier, fixed: Templates) -> DataFrame:
    """Findings among rows(d, t, paragraph, more, words). Logits leave through an array of one that is taken apart, which
    the optimiser does not look through, so that no filter on them makes the classifier run once more."""
    logits = classifier.model.transform(classifier.vocabulary.transform(_terms(rows)))
    raw = logits.select("d", "t", "paragraph", "more", "words", F.explode(F.array(vector_to_array("rawPrediction"))).alias("raw"))
    likely = raw.withColumn("label", F.array_position("raw", F.array_max("raw")).cast("int") - 1).where(F.col("label") < len(FAMILIES) - 1)
    scored = likely.withColumn("x", F.explode(F.array(F.struct(F.array_max(_probability(F.col("raw"), F.lit(classifier.temperature))).alias("probability"), grams(F.col("words"), 3).alias("own"))))).where(F.col("x.probability") >= CERTAIN)
    likeness = F.array_max(F.transform(F.get(fixed.of_family(), F.col("label")), lambda g: _share(g, F.col("x.own"))))
    return scored.select("d", "t", "paragraph", "more", F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.col("label") + 1).alias("family"), "x.probability", likeness.alias("likeness")).withColumn("confirmed", F.col("likeness") >= CONFIRMED)


def _wrapped(keyed: DataFrame, classifier: Classifier, fixed: Templates) -> DataFrame:
    """Confirmed findings in runs of neighbouring lines, as _found's. Runs have no line without words, and all
    lines but the first and last within the longest template's words; only documents that have enough of a template's
    triples are cut, which a look at their words tells for nearly all. Of runs of a family that overlap, a line by
    itself stays, or else the likest, shortest, first."""
    most = fixed.longest
    text = words(F.array_join("lines", "\n"))
    enough = lambda w: once(F.array_intersect(fixed.words(), w), lambda own: F.exists(fixed.needed(), lambda x: F.size(F.array_intersect(x["words"], own)) >= x["least"]))
    shared = lambda w: once(F.array_intersect(grams(w, 3), fixed.known()), lambda own: F.exists(fixed.every(), lambda g: _share(g, own) >= CONFIRMED))
    near = keyed.where(once(text, lambda w: F.when(enough(w), shared(w)).otherwise(False))).select("d", "t", F.explode(F.array(F.transform("lines", words))).alias("w"))
    first = near.select("d", "t", "w", F.posexplode("w").alias("paragraph", "first")).where(F.size("first") > 0)
    after = first.select("d", "t", "paragraph", "first", F.slice("w", F.col("paragraph") + 2, most + 1).alias("after"))
    runs = (
        after.select("d", "t", "paragraph", "first", "after", F.explode(F.sequence(F.lit(0), F.size("after"))).alias("more"))
        .where(F.forall(F.slice("after", F.lit(1), F.col("more")), lambda x: F.size(x) > 0))
        .where(F.size(F.flatten(F.slice("after", F.lit(1), F.greatest(F.col("more") - 1, F.lit(0))))) < most)
        .select("d", "t", "paragraph", "more", F.concat("first", F.flatten(F.slice("after", F.lit(1), F.col("more")))).alias("words"))
    )
    order = F.struct((F.col("more") > 0).alias("several"), (-F.col("likeness")).alias("unlike"), "more", "paragraph", "probability")
    best = _found(runs, classifier, fixed).where("confirmed").groupBy("d", "t", "family").agg(F.array_sort(F.collect_set(order)).alias("x"))
    apart = lambda a, b: (a["paragraph"] + a["more"] < b["paragraph"]) | (b["paragraph"] + b["more"] < a["paragraph"])
    kept = F.aggregate("x", F.slice("x", 1, 0), lambda acc, x: F.when(F.forall(acc, lambda y: apart(x, y)), F.array_append(acc, x)).otherwise(acc))
    return best.select("d", "t", "family", F.explode(kept).alias("x")).where("x.several").select("d", "t", "x.paragraph", "x.more", "family", "x.probability", (-F.col("x.unlike")).alias("likeness"), F.lit(True).alias("confirmed"))


def scan_licenses(docs: DataFrame, classifier: Classifier | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(per document, per finding).

    A paragraph is a line with words. Findings are paragraphs, and confirmed runs of neighbouring ones (texts that
    are wrapped), whose calibrated most likely class is a family with at least CERTAIN: d, t (the document's id and
    text hash), paragraph (its 0-based line, of a run the first), more (lines that follow in the run), family, probability,
    likeness (the largest share of a template's word triples that the paragraph has) and confirmed. Documents have
    their id, n_paragraphs, families (confirmed ones, sorted, comma-joined), n_found, n_confirmed.

    Defined cases: null and empty texts have no paragraphs; rows that agree in id and text count as one document in
    findings and keep a row each; a null id is an id; very long paragraphs are taken whole; extra columns are not
    read; an empty table gives no rows, from a classifier without unknown paragraphs.

    Scale: classification is a projection; runs are cut only from documents with most of a template's triples. Only
    findings are shuffled; templates are constants."""
    classifier = classifier or train(docs, id_col, text_col)
    text = F.col(f"`{text_col}`")
    keyed = docs.select(F.col(f"`{id_col}`").alias("d"), F.xxhash64(F.lit("t"), text).alias("t"), F.split(F.coalesce(text, F.lit("")), "\n", -1).alias("lines"))
    own = keyed.select("d", "t", F.size(F.filter("lines", lambda x: x.rlike(r"[\p{L}\p{N}]"))).cast("long").alias("n_paragraphs"))
    inked = lambda p: p.rlike(r"[\p{L}\p{N}]")
    paragraphs = keyed.select("d", "t", F.posexplode("lines").alias("paragraph", "p")).where(inked(F.col("p"))).select("d", "t", "paragraph", F.lit(0).alias("more"), words(F.col("p")).alias("words"))
    fixed = Templates.read(docs.sparkSession)
    findings = _found(paragraphs, classifier, fixed).unionByName(_wrapped(keyed, classifier, fixed))
    per = (
        findings.distinct()
        .groupBy(F.col("d").alias("d2"), F.col("t").alias("t2"))
        .agg(
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
            F.count("*").alias("n_found"),
            F.count_if("confirmed").alias("n_confirmed"),
        )
    )
    done = own.join(per, F.col("d").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2")), "left").select(
        F.col("d").alias(id_col),
        "n_paragraphs",
        F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"),
        F.coalesce("n_confirmed", F.lit(0)).cast("long").alias("n_confirmed"),
    )
    return done, findings


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))[0]
