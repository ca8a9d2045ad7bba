"""Language-model scoring with a log-frequency Bloom filter."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoscope.llm.common import cut, table, written
from clonoscope.llm.words import hashed

#: Counts are stored as levels: 1 + floor(log(count) / log(BASE)).
BASE = 1.6
#: Bits set for each level of an n-gram: the first level's, which tell members from others, and further levels'.
FIRST, MORE = 6, 3
#: Bits of the filter for each bit set, and its least size in bytes (a power of two is taken); it has no largest.
ROOM, LEAST_BYTES = 2.0, 1 << 16
#: Bytes of a shard of the filter (a power of two), and of a filter whose shards a task keeps once it has read them.
SHARD, KEPT = 1 << 24, 1 << 26
#: Tokens that are probed at a time, as each time reads the shards of a larger filter.
TURN = 500_000
#: Weight of the bigram estimate, and the prior mass, in words, that it gives the single-word estimate.
WEIGHT, PRIOR = 0.4, 5.0
#: Words whose exact counts are told to the workers; others' are joined.
TOLD = 1 << 19
HELD_OUT, FOLDS = 2, 7
#: Groups of blocks by which n-grams are dealt out: the low bits of a block's number in any filter of so many blocks.
PARTS = 1 << 16
#: N-grams that a task counts before it hands them on.
HELD = 3_000_000

_M1, _M2, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x5851F42D4C957F2D)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _M1
    x = x ^ (x >> np.uint64(29))
    x = x * _M2
    return x ^ (x >> np.uint64(32))


def bigram_hashes(words: np.ndarray) -> np.ndarray:
    """A hash for each token with the one before it; a text's first has the end before it, which is also the token that
    stands there where texts follow each other."""
    return _mix(np.concatenate([[_END], words[:-1]]) * _M2 + words * _M1 + np.uint64(1))


def with_ends(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The words of texts that stand one behind the other, with the end's hash after each text."""
    return np.insert(words, bounds[1:], _END)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def level_counts(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for, the geometric middle of the counts that it holds; 0 for level 0. Levels of
    which the smallest whole count is the only one stand for it."""
    low = np.ceil(BASE ** (np.maximum(level, 1) - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(BASE ** np.maximum(level, 1).astype(float) - 1e-9) - 1)
    return np.where(level > 0, np.sqrt(low * high), 0.0)


def _bits(hashes: np.ndarray, level: int, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Block and bit within 512 of each probe for one level; all of an n-gram's bits stand in one block."""
    block = (hashes >> np.uint64(20)) % np.uint64(blocks)
    seed = _mix(hashes + np.uint64(level * int(_M1) % (1 << 64)))
    for k in range(FIRST if level == 1 else MORE):
        yield block, (seed >> np.uint64(9 * k)) & np.uint64(511)


@dataclass
class LogFrequencyFilter:
    """A blocked Bloom filter over (n-gram, level): an n-gram of level q is entered for levels 1 to q. A probe climbs
    until a level is missing, so that counts are never underestimated and seldom overestimated."""

    data: np.ndarray  # bytes, 64 for a block

    @property
    def blocks(self) -> int:
        return len(self.data) // 64

    def level(self, hashes: np.ndarray, most: int = 64) -> np.ndarray:
        out = np.zeros(len(hashes), dtype=np.int64)
        at = np.arange(len(hashes))
        for q in range(1, most):
            if not len(at):
                break
            h = hashes[at]
            ok = np.ones(len(h), dtype=bool)
            for block, bit in _bits(h, q, self.blocks):
                byte = (block * np.uint64(64) + (bit >> np.uint64(3))).astype(np.int64)
                ok &= (self.data[byte] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
            at = at[ok]
            out[at] = q
        return out

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        unique, back = np.unique(hashes, return_inverse=True)
        return level_counts(self.level(unique))[back]


@dataclass
class ShardedFilter:
    """A filter of `size` bytes as broadcast shards, each the data of a LogFrequencyFilter over its own n-grams."""

    shards: list[Broadcast]
    size: int

    def level(self, hashes: np.ndarray) -> np.ndarray:
        """As LogFrequencyFilter's; shard by shard, and of a filter beyond KEPT one shard is held at a time."""
        # the block in the whole filter, by shards' blocks; sizes are powers of two, so _bits finds the rest in the shard
        of = ((hashes >> np.uint64(20)) % np.uint64(self.size // 64) // np.uint64(self.size // 64 // len(self.shards))).astype(np.int64)
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(len(self.shards) + 1))
        out = np.zeros(len(hashes), dtype=np.int64)
        for shard, low, high in zip(self.shards, bounds, bounds[1:]):
            if low < high:
                out[order[low:high]] = LogFrequencyFilter(shard.value).level(hashes[order[low:high]])
                if self.size > KEPT and getattr(shard, "_path", None):  # it can be read again
                    vars(shard).pop("_value", None)
        return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))


def _trained(texts: DataFrame) -> DataFrame:
    """Rows that the model may learn from; a null id has no remainder and is learnt from."""
    return texts.where(F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS, F.lit(-1)) != HELD_OUT)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, and of bigrams below 0 (which spares a column of the widest table), summed within the task as
    far as its memory allows."""
    held: dict[int, list[np.ndarray]] = {1: [], 2: []}
    rows = 0

    def flush() -> pa.RecordBatch:
        parts = [(k, *np.unique(np.concatenate(v), return_counts=True)) for k, v in held.items()]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([h for _, h, _ in parts]).view(np.int64)), pa.array(np.concatenate([c if k == 1 else -c for k, _, c in parts]).astype(np.int64))],
            names=["h", "n"],
        )

    for _, words, bounds in hashed(batches):
        flat = with_ends(words, bounds)
        held[1].append(flat)
        held[2].append(bigram_hashes(flat))
        rows += len(flat)
        if rows > HELD:
            yield flush()
            held, rows = {1: [], 2: []}, 0
    if rows:
        yield flush()


def build_filter(counts: DataFrame, size: int) -> ShardedFilter:
    """The filter of `size` bytes from counts(h, c). Each task fills the blocks that its n-grams have, so that counts
    which are dealt by PARTS send each block once. The driver holds one shard at a time."""
    blocks, per = size // 64, min(size, SHARD) // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, dtype=np.int64)
        data = np.zeros((0, 64), dtype=np.uint8)
        for batch in batches:
            h, c = batch.column("h").to_numpy().view(np.uint64), batch.column("c").to_numpy()
            if not len(h):
                continue
            block = ((h >> np.uint64(20)) % np.uint64(blocks)).astype(np.int64)
            every = np.union1d(known, block)
            if len(every) > len(known):
                grown = np.zeros((len(every), 64), dtype=np.uint8)
                grown[np.searchsorted(every, known)] = data
                known, data = every, grown
            flat = data.reshape(-1)
            base, top = np.searchsorted(known, block) * 64, levels(c)
            for q in range(1, int(top.max()) + 1):
                of = top >= q
                for _, bit in _bits(h[of], q, blocks):
                    np.bitwise_or.at(flat, base[of] + (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
        for s in np.unique(known // per).tolist():
            low, high = np.searchsorted(known, [s * per, (s + 1) * per])
            yield pa.RecordBatch.from_arrays(
                [pa.array([s], pa.int64()), pa.array([(known[low:high] - s * per).tobytes()], pa.binary()), pa.array([data[low:high].tobytes()], pa.binary())],
                names=["shard", "blocks", "data"],
            )

    context = counts.sparkSession.sparkContext
    rows = cut(counts.select("h", "c").mapInArrow(run, "shard long, blocks binary, data binary"))
    shards: list[Broadcast] = []
    data = np.zeros((per, 64), dtype=np.uint8)
    for row in rows.orderBy("shard").toLocalIterator():
        while len(shards) < row["shard"]:
            shards.append(context.broadcast(data.reshape(-1)))
            data = np.zeros_like(data)
        data[np.frombuffer(row["blocks"], dtype=np.int64)] |= np.frombuffer(row["data"], dtype=np.uint8).reshape(-1, 64)
    while len(shards) < blocks // per:
        shards.append(context.broadcast(data.reshape(-1)))
        data = np.zeros_like(data)
    return ShardedFilter(shards, size)


def _size(bits: float) -> int:
    return 1 << max(LEAST_BYTES.bit_length() - 1, math.ceil(math.log2(max(1.0, bits * ROOM / 8))))


def train(counts: DataFrame) -> ShardedFilter:
    """The filter over all n-grams of counts(h, c), of a size for all their levels' bits."""
    q = F.floor(F.log(BASE, F.greatest(F.col("c"), F.lit(1))) + 1e-9) + 1
    by = counts.groupBy(q.cast("int").alias("q")).agg(F.count("*").alias("n")).collect()
    return build_filter(counts, _size(sum(r["n"] * (FIRST + MORE * (r["q"] - 1)) for r in by)))


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, sizes and tokens of documents, about TURN tokens at a time."""
    ids: list[pa.Array] = []
    sizes: list[np.ndarray] = []
    flat: list[np.ndarray] = []

    def turn() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        out = pa.concat_arrays(ids), np.concatenate(sizes), np.concatenate(flat)
        for held in (ids, sizes, flat):
            held.clear()
        return out

    for part, words, bounds in hashed(batches):
        ids.append(part.column("id"))
        sizes.append(np.diff(bounds) + 1)
        flat.append(with_ends(words, bounds))
        if sum(map(len, flat)) >= TURN:
            yield turn()
    if ids:
        yield turn()


def _told(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of the most frequent words: those of the lowest count from which they are at most
    `most`."""
    least, held = None, 0
    for c, n in sorted(words.groupBy("c").count().collect(), reverse=True):
        held += n
        if held > most:
            break
        least = c
    top = words.where(F.col("c") >= least if least is not None else F.lit(False)).toPandas()
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(h)
    return h[by], top["c"].to_numpy(np.int64)[by]


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", told: int = TOLD) -> DataFrame:
    """Score every document by a bigram model learnt from the training rows.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score, score. Tokens are lower-cased words and one
    end; crc32(id) mod 7 = 2 marks the rows that are held out. base_score uses exact counts with one added; score is
    the log10 probability, each token's being WEIGHT * (c(h w) + PRIOR * p(w)) / (c(h) + PRIOR) + (1 - WEIGHT) * p(w),
    with all counts from probes of the filter; p(w) has one added as the base has.

    Defined cases: null and empty texts are the end alone; a null id is a training row with held_out false;
    repeated rows count as often as they stand; no training row at all leaves every count 0 (N and V 0); extra columns
    are not read; an empty table gives no rows.

    Scale: counts are summed within a task before the shuffle, so that frequent words cost a row a task. The filter's
    size follows the corpus without a bound, and every word and bigram is in it; it is broadcast in shards, of which a
    task holds one at a time once they are many. Exact counts of at most the `told` most frequent words are broadcast;
    all others are joined by hash, pre-aggregated by document.
    """
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col)
    part = F.shiftrightunsigned("h", 20) % PARTS
    summed = _trained(texts).mapInArrow(_counted, "h long, n long").withColumn("part", part).repartition("part").groupBy("part", "h", F.col("n") > 0).agg(F.sum("n").alias("n"))
    signed = written(summed.select("h", "n"))
    words = signed.where("n > 0").select("h", F.col("n").alias("c"))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    exact = _told(words, told)
    model = train(signed.select("h", F.abs("n").alias("c")))
    sent = spark.sparkContext.broadcast(exact)
    total = float(n + v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = sent.value
        for ids, sizes, flat in _turns(batches):
            starts = np.cumsum(sizes) - sizes
            pairs = bigram_hashes(flat)
            unique, back = np.unique(flat, return_inverse=True)
            bigrams, of_pair = np.unique(pairs, return_inverse=True)
            estimates = level_counts(model.level(np.concatenate([unique, bigrams])))
            c_word = estimates[back]
            c_history = np.concatenate([[0.0], c_word[:-1]])
            c_history[starts] = c_word[starts + sizes - 1]  # a text begins after an end, the last of its own tokens
            c_pair = np.minimum(estimates[len(unique) :][of_pair], np.minimum(c_word, c_history))
            p_word = (c_word + 1) / total
            p = WEIGHT * (c_pair + PRIOR * p_word) / (c_history + PRIOR) + (1 - WEIGHT) * p_word
            score = np.add.reduceat(np.log10(np.minimum(p, 1.0)), starts)
            at = np.minimum(np.searchsorted(known, unique), max(len(known) - 1, 0))
            told_ = known[at] == unique if len(known) else np.zeros(len(unique), dtype=bool)
            c = np.where(told_, times[at], 0) if len(known) else np.zeros(len(unique), dtype=np.int64)
            part_known = np.add.reduceat(told_[back].astype(np.int64), starts)
            part_logs = np.add.reduceat(np.log10(c + 1.0)[back], starts)
            rest = np.flatnonzero(~told_[back])
            of = np.searchsorted(starts, rest, side="right") - 1
            order = np.lexsort((flat[rest], of))
            of, others = of[order], flat[rest][order]
            first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (others[1:] != others[:-1])]) if len(of) else np.empty(0, np.int64)
            reps = np.diff(np.r_[first, len(of)])
            bounds = np.searchsorted(of[first], np.arange(len(sizes) + 1))
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int64())) for x in (others[first].view(np.int64), reps)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(part_known), pa.array(part_logs), pa.array(score), *lists],
                names=["id", "n_tokens", "known", "logs", "score", "others", "times"],
            )

    scored = cut(texts.mapInArrow(run, "id long, n_tokens long, known long, logs double, score double, others array<long>, times array<long>").withColumn("row", F.monotonically_increasing_id()))
    asked = scored.select("row", F.explode(F.arrays_zip("others", "times")).alias("x")).select("row", F.col("x.others").alias("h"), F.col("x.times").alias("t"))
    rare = words.select(F.col("h").alias("wh"), "c")
    got = asked.join(rare, F.col("h") == F.col("wh")).groupBy(F.col("row").alias("r")).agg(F.sum("t").alias("more"), F.sum(F.col("t") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    return scored.drop("others", "times").join(got, F.col("row") == F.col("r"), "left").select(
        F.col("id").alias(id_col),
        F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * math.log10(total)).alias("base_score"),
        "score",
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score_documents(table(spark, sf_dir, "documents"))
