"""Packing documents into token sequences: hierarchical residual best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoscope.llm.common import cut, table

CAPACITY = 2048
#: Bins with at most so many free tokens are emitted as they are.
SLACK = 8
#: Bins that one packing task takes.
GROUP = 60_000
TOKENIZER = "byte_bpe_50k"
#: Fixed value: the tokenizer's added token, which is one id wherever a text has it.
ADDED = {"<|endoftext|>": 50256}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _encoder(name: str):
    """The tokenizer whose path is public_tokenizers.path(name + '.json'), through its ranks file: the same
    vocabulary, splitting pattern and added token, and so the same ids, several times as fast."""
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)


def tokenized(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: its ids and an id 0, cut only if longer than the capacity; then the first piece
    has what is over a multiple of the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encoder.encode(text or "", allowed_special="all"), 0], dtype="<u4").tobytes()
                n = len(ids) // 4
                at, view = 0, memoryview(ids)
                for piece, length in enumerate([n % capacity or capacity, *[capacity] * ((n - 1) // capacity)]):
                    for values, x in zip(out, (doc, piece, at, length, zlib.crc32(view[4 * at : 4 * (at + length)])), strict=True):
                        values.append(x)
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(run, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item by best-fit decreasing, for sizes from 1 to the capacity. Items of a size are told apart
    only at the end: bins are kept by their free space, so that a step costs a look at a bitmap."""
    order = np.argsort(-sizes, kind="stable")
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins, out = 0, 0, np.empty(len(sizes), dtype=np.int64)
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            space = size + ((fits & -fits).bit_length() - 1)
            at = free[space].pop()
            if not free[space]:
                mask ^= 1 << space
        else:
            at, space = bins, capacity
            bins += 1
        out[i] = at
        left = space - size
        if left:
            if not free[left]:
                mask |= 1 << left
            free[left].append(at)
    return out


def _round(capacity: int, slack: int):
    """One round on a group of bins with free space. Each goes to a place in a new bin, whose number comes from a
    member's, so that it is the same whenever and wherever the task runs."""

    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("bin", kind="stable", ignore_index=True)
        sizes = items["size"].to_numpy()
        to = best_fit(sizes, capacity)
        order = np.argsort(to, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(to[order]) > 0])
        before = np.cumsum(sizes[order]) - sizes[order]
        base = np.empty(len(items), dtype=np.int64)
        base[order] = before - np.repeat(before[starts], np.diff(np.r_[starts, len(order)]))
        fill = np.bincount(to, weights=sizes).astype(np.int64)
        name = items["bin"].to_numpy()[order[starts]]
        return pd.DataFrame({"bin": items["bin"], "to": name[to], "base": base, "fill": fill[to]})

    return run


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, slack: int = SLACK, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack documents into as few sequences of at most `capacity` tokens as best fit finds.

    Pieces of the whole capacity are sequences by themselves. The others are dealt at random into groups of about
    `group` items, each packed by best-fit decreasing; bins that are nearly full are emitted, the rest go on as
    items, in fewer groups, until one group has been packed or a round joins less than one bin in a hundred.
    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset; the pieces of a sequence have no
    gap between them and begin at 0.

    Defined cases: null and empty texts are the end id alone; repeated rows and ids are separate documents, null ids
    stay null; the added token's string is its one id, as the tokenizer has it; an empty table gives no rows; extra columns are not read.

    Scale: the text is read once and never shuffled. Piece numbers are fixed in the stored table of pieces before
    anything is dealt by them, so that a lost executor's work comes out the same. A round moves bins as rows of number
    and size, whatever they hold; pieces join their places once, at the end. A group's size does not depend on any key.
    """
    spark = docs.sparkSession
    pieces = tokenized(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), tokenizer, capacity)
    stored = cut(pieces.withColumn("bin", F.monotonically_increasing_id()))
    full = F.col("length") >= capacity - slack
    left = stored.where(~full).count()
    open_ = stored.where(~full).select("bin", F.col("length").alias("size"))
    # the place of each piece's own bin among the bins of the last round, as long as there are further ones
    placed: DataFrame | None = None
    ended: list[DataFrame] = []
    while left:
        groups = max(1, -(-left // group))
        bucket = F.pmod(F.xxhash64("bin", F.lit(groups)), F.lit(groups))
        moved = cut(open_.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(_round(capacity, slack), "bin long, to long, base long, fill long"))
        if placed is None:
            placed = moved.select("bin", "to", F.col("base").alias("offset"), "fill")
        else:
            step = moved.select(F.col("bin").alias("from"), F.col("to").alias("next"), "base", F.col("fill").alias("filled"))
            placed = cut(placed.join(step, F.col("to") == F.col("from")).select("bin", F.col("next").alias("to"), (F.col("offset") + F.col("base")).alias("offset"), F.col("filled").alias("fill")))
        open_ = moved.where(F.col("fill") < capacity - slack).groupBy(F.col("to").alias("bin")).agg(F.first("fill").alias("size"))
        before, left = left, open_.count()
        if groups == 1 or left > 0.99 * before:
            left = 0
        ended.append(placed if not left else placed.where(F.col("fill") >= capacity - slack))
        placed = placed.where(F.col("fill") < capacity - slack)
    whole = stored.where(full).withColumn("sequence_id", F.col("bin")).withColumn("offset", F.lit(0).cast("long"))
    if ended:
        places = reduce(DataFrame.unionByName, ended).select(F.col("bin").alias("own"), F.col("to").alias("sequence_id"), "offset")
        whole = whole.unionByName(stored.where(~full).join(places, F.col("bin") == F.col("own")).drop("own"))
    return whole.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the sequences that the kept documents make.

    Null and empty texts are their end alone; each of repeated rows is packed; null ids stay null; an empty table gives
    no rows; other columns are not read."""
    return pack(docs)
