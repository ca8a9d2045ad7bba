"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, learnt from document labels."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonoscope.llm.common import cut, settle, table

#: Labelled documents that are learnt from at most, by the order of a hash of their id, and the characters of whole
#: texts after which no further one is taken.
SAMPLE, CHARACTERS = 8_000, 64_000_000
#: Documents of the sample that a word or stem must stand in, and features at most.
LEAST_DOCS, WORDS = 5, 200_000
#: Adam's steps and rate; what a unit of weight costs, in documents' log likelihood.
STEPS, RATE, PENALTY = 250, 0.15, 0.5
#: Scores from which a document is toxic, and sentence probabilities from which a sentence is named.
THRESHOLD, OFFENDING = 0.3, 0.5
HELD_OUT, FOLDS = 2, 4

#: Letters of a word's stem, which is a feature beside the word, for words seen in other forms only.
STEM = 4
#: Words of the sample that are worked on at a time.
BLOCK = 1 << 20
#: Words whose weights a worker keeps.
CACHED = 500_000

_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_END = re.compile(r"[.!?\n]")
_ENDS = (".", "!", "?", "\n")


class _Weights(dict):
    """A word's weight with its stem's; not a number for the end of a sentence."""

    def __init__(self, own: dict[str, float]):
        super().__init__()
        self.own = own

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHED:
            self.clear()
        self[word] = w = float("nan") if word in _ENDS else self.own.get(word, 0.0) + self.own.get(_stem(word), 0.0)
        return w


def _stem(word: str) -> str:
    return word[:STEM] + "*"


@dataclass
class Model:
    """Weights of words and stems, a sentence's bias, and the leak: what a document has without any offending
    sentence."""

    weights: dict[str, float]
    bias: float = -6.0
    leak: float = 0.0

    def __post_init__(self) -> None:
        self.cache = _Weights(self.weights)

    def sentences(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The places among all pieces between ends of those that have words, and their logits."""
        found = _TOKEN.findall(text.lower())
        weights = np.fromiter(map(self.cache.__getitem__, found), dtype=float, count=len(found))
        stops = np.isnan(weights)
        piece = np.cumsum(stops)
        n = int(piece[-1]) + 1 if len(piece) else 0
        places = np.flatnonzero(np.bincount(piece[~stops], minlength=n))
        return places, np.bincount(piece[~stops], weights=weights[~stops], minlength=n)[places] + self.bias

    def score(self, logits: np.ndarray) -> float:
        """Noisy-or: 1 - (1 - leak) * product of (1 - p), over the sentences' probabilities."""
        return float(1.0 - (1.0 - self.leak) * np.exp(-np.logaddexp(0.0, logits).sum()))


@dataclass
class Sample:
    """Labelled documents as numbers: the places of their words among the names, sentence after sentence; each
    sentence's words and document; each document's label. A word's stem follows from it: `stems` holds its place, or
    the number of names where there is none. A word without a place stands there as its stem."""

    names: list[str]
    words: np.ndarray
    sizes: np.ndarray
    owner: np.ndarray
    labels: np.ndarray

    @property
    def stems(self) -> np.ndarray:
        place = {w: i for i, w in enumerate(self.names) if w.endswith("*")}
        return np.array([len(self.names) if w in place else place.get(_stem(w), len(self.names)) for w in self.names], dtype=np.int32)

    def blocks(self) -> list[tuple[slice, slice]]:
        """Sentences and their words, about BLOCK words at a time."""
        ends = np.cumsum(self.sizes, dtype=np.int64)
        cuts = np.searchsorted(ends, np.arange(BLOCK, len(self.words), BLOCK)) + 1
        bounds = np.unique([0, *cuts, len(ends)])
        at = np.append(0, ends)
        return [(slice(a, b), slice(at[a], at[b])) for a, b in zip(bounds, bounds[1:])]


def fit(sample: Sample) -> Model:
    """Maximum likelihood of document labels under the noisy-or, with a penalty on absolute weights (smoothed at
    zero), by Adam over the whole sample."""
    sizes, owner, y = sample.sizes, sample.owner, sample.labels.astype(float)
    n_docs, size, count = len(y), len(sample.names), len(owner)
    if not n_docs or len(set(y.tolist())) < 2:
        return Model({}, leak=float(np.mean(y)) if n_docs else 0.0)
    theta = np.zeros(size + 2)  # weights, bias, leak's logit
    theta[-2], theta[-1] = -6.0, -3.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    stems, blocks = sample.stems, sample.blocks()
    for step in range(1, STEPS + 1):
        weight = theta[:size] + np.append(theta[:size], 0.0)[stems]
        z = np.full(count, theta[-2])
        for s, w in blocks:
            n = s.stop - s.start
            z[s] += np.bincount(np.repeat(np.arange(n), sizes[s]), weights=weight[sample.words[w]], minlength=n)
        total = np.bincount(owner, weights=np.logaddexp(0.0, z), minlength=n_docs) + np.logaddexp(0.0, theta[-1])
        outer = np.where(y > 0, -1.0 / np.expm1(np.clip(total, 1e-9, 700)), 1.0) / n_docs
        inner = outer[owner] * np.exp(-np.logaddexp(0.0, -z))
        own = np.zeros(size)
        for s, w in blocks:
            own += np.bincount(sample.words[w], weights=np.repeat(inner[s], sizes[s]), minlength=size)
        grad = np.empty_like(theta)
        grad[:size] = PENALTY / n_docs * np.tanh(theta[:size] / 0.05) + own + np.bincount(stems, weights=own, minlength=size + 1)[:size]
        grad[-2], grad[-1] = inner.sum(), outer.sum() / (1.0 + np.exp(-theta[-1]))
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-10)
    weights = {name: w for name, w in zip(sample.names, theta[:size].tolist(), strict=True) if abs(w) > 1e-3}
    return Model(weights, float(theta[-2]), float(1.0 / (1.0 + np.exp(-theta[-1]))))


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text, and how many each of its sentences with words has."""
    for batch in batches:
        words, sizes = [], []
        for text in batch.column("text"):
            found = _TOKEN.findall((text.as_py() or "").lower())
            stop = np.array([w in _ENDS for w in found], dtype=bool)
            words.append([w for w in found if w not in _ENDS])
            sizes.append(np.unique(np.cumsum(stop)[~stop], return_counts=True)[1].astype(np.int32))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("d", "h", "label")), pa.array(words, pa.list_(pa.string())), pa.array(sizes, pa.list_(pa.int32()))], names=["d", "h", "label", "words", "sizes"])


def _numbered(names: Broadcast):
    """Words as places among the names, or their stems'; those that have neither go, and sentences keep the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(names.value)}
        for batch in batches:
            places, kept = [], []
            for words, sizes in zip(batch.column("words").to_pylist(), batch.column("sizes"), strict=True):
                at = np.array([place[w] if w in place else place.get(_stem(w), -1) for w in words], dtype=np.int32)
                sentence = np.repeat(np.arange(len(sizes)), sizes.values.to_numpy())
                places.append(at[at >= 0])
                kept.append(np.bincount(sentence[at >= 0], minlength=len(sizes)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("d", "h", "label")), pa.array(places, pa.list_(pa.int32())), pa.array(kept, pa.list_(pa.int32()))], names=["d", "h", "label", "places", "sizes"])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(d, h, label, text): whole texts of at most SAMPLE labelled documents outside the held-out fold. They are the
    first by a hash of the id, so that they do not depend on the tables' order, up to the one with which they reach
    CHARACTERS; their ids are few enough to broadcast."""
    key = F.col(f"`{id_col}`").cast("string").cast("binary")
    chosen = (
        labels.where(F.col(f"`{label_col}`").isNotNull() & (F.crc32(key) % FOLDS != HELD_OUT))
        .groupBy(F.col(f"`{id_col}`").alias("id"))
        .agg(F.max(f"`{label_col}`").cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(SAMPLE)
    )
    texts = docs.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    sizes = texts.select("d", F.length("text").cast("long").alias("n")).join(F.broadcast(chosen), F.col("d") == F.col("id")).groupBy("id", "label").agg(F.sum("n").alias("n"))
    # at most SAMPLE rows meet in this window
    before = F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1))
    kept = sizes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < CHARACTERS).select("id", "label")
    return texts.join(F.broadcast(kept), F.col("d") == F.col("id")).select("d", F.xxhash64("text").alias("h"), "label", "text")


def _gathered(numbers: DataFrame, names: list[str]) -> Sample:
    """The sample at the driver. What it is put together from goes before the model is fitted."""
    words, sizes, sentences, labels_ = [], [], [], []
    for batch in numbers.orderBy("d", "h").drop("d", "h").toArrow().to_batches():  # sums of floats depend on their order
        words.append(batch.column("places").flatten().to_numpy())
        sizes.append(batch.column("sizes").flatten().to_numpy())
        sentences.append(np.diff(batch.column("sizes").offsets.to_numpy()))
        labels_.append(batch.column("label").to_numpy())
    if not labels_:
        return Sample([], *[np.empty(0, dtype=np.int32)] * 4)
    each = np.concatenate(sentences)
    return Sample(names, np.concatenate(words), np.concatenate(sizes), np.repeat(np.arange(len(each), dtype=np.int32), each), np.concatenate(labels_))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from labelled_sample's rows. Texts are cut in tasks; the driver gets the names of at most WORDS words and
    stems that stand in LEAST_DOCS documents of the sample, and the sample as numbers."""
    rows = labelled_sample(docs, labels, id_col, text_col, label_col)
    stored = cut(rows.mapInArrow(_sentences, "d long, h long, label int, words array<string>, sizes array<int>"))
    stems = F.transform("words", lambda w: F.concat(F.substring(w, 1, STEM), F.lit("*")))
    seen = stored.select(F.explode(F.array_distinct(F.concat("words", stems))).alias("w")).groupBy("w").count().where(F.col("count") >= LEAST_DOCS)
    names = seen.orderBy(F.desc("count"), "w").limit(WORDS).select("w").toArrow().column("w").to_pylist()
    told = docs.sparkSession.sparkContext.broadcast(names)
    numbers = stored.mapInArrow(_numbered(told), "d long, h long, label int, places array<int>, sizes array<int>")
    settle(docs.sparkSession)
    sample = _gathered(numbers, names)
    told.destroy()
    return fit(sample)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, score, n_sentences and the offending sentences (start, end, p), in code points.

    Defined cases: null and empty texts score the leak; repeated rows keep a row each; whole texts of any length are
    scored; extra columns are not read. Rows never leave their task."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"`{id_col}` long, score double, n_sentences long, offending array<struct<start: long, end: long, p: double>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            scores, sizes, spans = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                places, logits = model.sentences(text)
                scores.append(model.score(logits))
                sizes.append(len(places))
                p = np.exp(-np.logaddexp(0.0, -logits))
                bad = np.flatnonzero(p >= OFFENDING)
                ends = [-1, *(m.start() for m in _END.finditer(text)), len(text)] if len(bad) else []
                spans.append([{"start": ends[places[i]] + 1, "end": ends[places[i] + 1], "p": float(p[i])} for i in bad])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()), pa.array(spans, kind)], names=[id_col, "score", "n_sentences", "offending"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of their labels."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", "offending")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the model rejects go; all columns of `docs`.

    Null and empty texts score the leak and are judged by it as others are; repeated rows are judged alike and all stay
    or go; ids play no part, so null or repeated ones change nothing; an empty table gives no rows; columns of any
    other name pass through."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return accepted(docs, model)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns; each task judges its own rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            yield batch.filter(pa.array([model.score(model.sentences(t.as_py() or "")[1]) < THRESHOLD for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
