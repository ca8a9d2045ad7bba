"""Aligning two tokenizers over a corpus: common cuts, linked tokens, and how many documents hold each linked pair."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonoscope.llm.common import table, written
from clonoscope.llm.words import places

TOKENIZERS = ("byte_bpe_50k", "piece_bpe_32k")
#: Bytes of text that are aligned at a time, or one longer text.
PIECE = 1 << 20
#: Linked pairs, a pair once a document, and documents that make a block full.
BLOCK = 250_000
#: Parts that a pair's first count is dealt to.
SALTS = 16

_COLUMNS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
#: A block's documents, with their pairs as places in the block's list and how often each, and then the list: a row
#: without `at`, with its pairs (A's id in the upper 32 bits, B's in the lower) and the documents of the block that hold each.
_STORED = f"{_COLUMNS}, at array<int>, times array<int>, pairs array<long>, docs array<long>"


class _Sides:
    """Both tokenizers with the bytes of each of their ids. Their paths are what public_tokenizers.path() gives; A is
    read from its ranks file, which has the same vocabulary and pattern as its JSON."""

    def __init__(self, a: str, b: str):
        import base64

        import public_tokenizers as P
        import sentencepiece
        import tiktoken

        with open(P.path(f"{a}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
        self.a = tiktoken.Encoding(a, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=P.path(f"{b}.model"))
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for x, i in ranks.items():
            self.bytes_a[i] = x
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in y], dtype=np.int64) for y in (self.bytes_a, self.bytes_b))
        # an id's decimal digits with what may follow it
        self.digits = [f"{i}{end}".encode() for i in range(max(len(self.bytes_a), len(self.bytes_b))) for end in ",|;"]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of a space and each text by A and by B (which adds the space). None where a text is empty or one side's
        bytes are not the text's."""
        side_a = [self.a.encode_ordinary(f" {t}") if t else [] for t in texts]
        side_b = self.b.encode(texts, num_threads=1) if texts else []
        for k, (t, x, y) in enumerate(zip(texts, side_a, side_b, strict=True)):
            whole = f" {t}".encode()
            if not t or b"".join(map(self.bytes_a.__getitem__, x)) != whole or b"".join(map(self.bytes_b.__getitem__, y)) != whole:
                side_a[k], side_b[k] = [], []
        return side_a, side_b


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists one behind the other, and their bounds."""
    bounds = np.cumsum([0, *map(len, ids)])
    out = np.empty(int(bounds[-1]), dtype=np.int64)
    for x, begin, end in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[begin:end] = x
    return out, bounds


def _aligned(sides: _Sides, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """For each text n_a, n_b, n_groups and n_links, and its groups' hash; and the texts' distinct linked pairs one behind
    the other, with how often each is linked, and their bounds. The texts are aligned as one long text, as both sides
    end a token where a text ends."""
    ids_a, ids_b = sides.encode(texts)
    (a, at_a), (b, at_b) = _flat(ids_a), _flat(ids_b)
    size_a, size_b = sides.lengths_a[a], sides.lengths_b[b]
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    begin_a, begin_b = end_a - size_a, end_b - size_b
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    # groups that end within each text
    ends = np.concatenate([[0], end_a])[at_a]
    groups = np.searchsorted(cuts, ends, side="right")
    # B's tokens that overlap each of A's stand side by side
    first = np.searchsorted(end_b, begin_a, side="right")
    many = np.searchsorted(begin_b, end_a, side="left") - first
    links = np.concatenate([[0], np.cumsum(many)])[at_a]
    text_of = np.repeat(np.arange(len(texts)), np.diff(links))
    codes = np.repeat(a, many) * len(sides.bytes_b) + b[places(first, many)]
    wide = len(sides.bytes_a) * len(sides.bytes_b)
    keys, times = np.unique(text_of * wide + codes, return_counts=True)
    bounds = np.searchsorted(keys, np.arange(len(texts) + 1) * wide)
    # both sides' ids in the order of the groups' text: A's of a group, then B's
    order = np.empty(len(a) + len(b), dtype=np.int64)
    every = np.arange(len(cuts))
    last_a, last_b = (np.concatenate([g[1:] != g[:-1], [True]])[: len(g)] for g in (group_a, group_b))
    order[np.arange(len(a)) + np.searchsorted(group_b, every)[group_a]] = 3 * a + last_a
    order[np.arange(len(b)) + np.searchsorted(group_a, every, side="right")[group_b]] = 3 * b + 2 * last_b
    hashes, digits = [], sides.digits
    for begin, end in zip((at_a + at_b)[:-1].tolist(), (at_a + at_b)[1:].tolist(), strict=True):
        hashes.append(hashlib.sha256(b"".join(map(digits.__getitem__, order[begin:end].tolist()))[:-1]).hexdigest() if end > begin else "")
    counts = np.stack([np.diff(x) for x in (at_a, at_b, groups, links)])
    return counts, hashes, keys % wide, times, bounds


def _align(a: str, b: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _Sides(a, b)
        name = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            """A block: its documents and the list of its pairs."""
            nonlocal name, size
            name, size = name + 1, 0
            doc_ids = [i for x in held for i in x[0]]
            counts = np.concatenate([x[1] for x in held], axis=1)
            every, times = (np.concatenate([x[k] for x in held]) for k in (3, 4))
            bounds = np.cumsum(np.concatenate([[0], *(np.diff(x[5]) for x in held)]))
            codes, at, docs = np.unique(every, return_inverse=True, return_counts=True)
            pairs = codes // len(sides.bytes_b) << 32 | codes % len(sides.bytes_b)
            listed = lambda v, t, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, t))
            none = lambda n, t: pa.nulls(n, pa.list_(t))
            n, hashes = len(doc_ids), [h for x in held for h in x[2]]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n + 1, name)),
                    pa.array([*doc_ids, None], pa.int64()),
                    *(pa.array([*c.tolist(), None], pa.int64()) for c in counts),
                    pa.array([*hashes, None], pa.string()),
                    pa.concat_arrays([listed(at, pa.int32(), bounds), none(1, pa.int32())]),
                    pa.concat_arrays([listed(times, pa.int32(), bounds), none(1, pa.int32())]),
                    pa.concat_arrays([none(n, pa.int64()), listed(pairs, pa.int64(), [0, len(pairs)])]),
                    pa.concat_arrays([none(n, pa.int64()), listed(docs, pa.int64(), [0, len(docs)])]),
                ],
                names=[c.split()[0] for c in _STORED.split(", ")],
            )

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            begin = 0
            while begin < len(ids):
                some: list[str] = []
                length = 0
                while begin + len(some) < len(ids) and (not some or length < PIECE):
                    text = texts[begin + len(some)].as_py() or b""
                    length += len(text)
                    some.append(text.decode("utf-8", "replace"))
                counts, hashes, pairs, times, bounds = _aligned(sides, some)
                held.append((ids[begin : begin + len(some)], counts, hashes, pairs, times, bounds))
                size += len(pairs) + len(some)
                begin += len(some)
                if size >= block:
                    yield flush()
        if held:
            yield flush()

    return run


def _summed(documents: pa.Table, pairs: pa.Table) -> pa.Table:
    """One block's documents with what their pairs count corpus-wide."""
    documents, pairs = documents.combine_chunks(), pairs.combine_chunks()
    where = pairs.column("pos").to_numpy()
    count, best = (np.zeros(int(where.max(initial=-1)) + 1, dtype=np.int64) for _ in range(2))
    count[where], best[where] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
    lists = [documents.column(c).combine_chunks() for c in ("at", "times")]
    at, times = (np.concatenate([np.empty(0, dtype=np.int64), x.flatten().to_numpy()]) for x in lists)
    at = at.astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy())])
    each = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[bounds]).astype(np.int64)
    out = documents.drop_columns(["block", "at", "times"])
    return out.append_column("n_best", pa.array(each(times * best[at]))).append_column("count_sum", pa.array(each(times * count[at])))


def align(docs: DataFrame, a: str = TOKENIZERS[0], b: str = TOKENIZERS[1], id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Every document's alignment, and every linked pair of ids with the documents that hold it.

    The first table has per document its id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum; the
    second a_id, b_id, count (documents that hold the pair linked) and best (no pair of its A id has more).

    A space and the text are encoded by both tokenizers, special tokens' strings being ordinary text. Ends of tokens are
    running sums of their bytes; ends that both sides have cut the text into groups, and an A and a B token whose bytes
    overlap are linked, however many there are.

    Scale: a text is encoded once. Documents go in blocks of about `block` pairs, and a block's list of distinct pairs
    with their documents is what is shuffled: counts are summed by pair and salt and then by pair, so that a pair
    which nearly all documents hold brings one row a block; what they come to goes back to the block by its name, where
    its documents, who know their pairs by place in the list, are summed. A block has a bounded size unless one
    document alone is longer, and its name is fixed in the stored table before anything is dealt by it.

    Defined cases: null and empty texts, and texts whose bytes one tokenizer does not give back (as with U+2581, which B
    writes for a space), have zeros and the empty string; repeated rows and ids are documents of their own and count
    each; null ids stay null; an empty table gives no rows; other columns are not read.
    """
    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    stored = written(read.mapInArrow(_align(a, b, block), _STORED))
    lists = stored.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("pos", "p"))
    held = lists.select("block", "pos", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    salted = held.groupBy("pair", F.pmod("block", F.lit(SALTS)).alias("salt")).agg(F.sum("docs").alias("docs"))
    counted = salted.groupBy("pair").agg(F.sum("docs").alias("count"))
    # an A id has at most as many pairs as B has ids
    most = F.max("count").over(Window.partitionBy("a_id"))
    pairs = written(counted.select(F.shiftright("pair", 32).cast("int").alias("a_id"), "pair", "count").withColumn("best", F.col("count") == most))
    known = held.select("block", "pos", "pair").join(pairs.select("pair", "count", "best"), "pair").select(F.col("block").alias("of"), "pos", "count", "best")
    documents = stored.where("pairs is null").select(*[c.split()[0] for c in _COLUMNS.split(", ")], "at", "times")
    schema = f"{_COLUMNS.removeprefix('block long, ')}, n_best long, count_sum long"
    summed = documents.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_summed, schema)
    return summed.withColumnRenamed("doc_id", id_col), pairs.select("a_id", F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b_id"), "count", "best")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizers aligned over all documents."""
    return align(table(spark, sf_dir, "documents"))[0]
