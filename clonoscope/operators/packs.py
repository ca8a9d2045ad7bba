"""Sequences of repertoires as compact rows, and their windows counted where the rows are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes of sequences that are packed at a time, and windows that are counted at a time, about.
ROWS, BYTES, CHUNK = 100_000, 1 << 24, 500_000
#: Keys of windows stay below this.
MOST = 1 << 62

Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def variants(ks: tuple[int, ...], gaps: bool) -> list[tuple[int, int | None]]:
    """(k, place of the gap): k-mers and, from four letters and if asked, those with one gap in the middle."""
    return [(k, at) for k in ks for at in ((None, k // 2) if gaps and k >= 4 else (None,))]


def _keys(rows: DataFrame) -> str:
    return f"repertoire_id {dict(rows.dtypes)['repertoire_id']}, label_positive boolean"


def packed(rows: DataFrame, ks: tuple[int, ...], gaps: bool = False) -> DataFrame:
    """Sequences (not null) with how often each occurs, about a row for each repertoire and task: their `letters` on end,
    `marks` (bytes of each, times of each), both compressed, and the windows `n` that they have. A large repertoire has
    several rows, and a sequence may be in more than one of them."""
    schema = f"{_keys(rows)}, n long, words int, size int, letters binary, marks binary"
    return rows.select("repertoire_id", "label_positive", "junction_aa").mapInArrow(_pack(variants(ks, gaps)), schema)


def _pack(cuts: list[tuple[int, int | None]]) -> Step:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS or sum(b.nbytes for b in held) >= BYTES:
                yield _packed(pa.Table.from_batches(held), cuts)
                held = []
        if sum(b.num_rows for b in held):
            yield _packed(pa.Table.from_batches(held), cuts)

    return run


def _packed(table: pa.Table, cuts: list[tuple[int, int | None]]) -> pa.RecordBatch:
    keys = ["repertoire_id", "label_positive", "junction_aa"]
    found = table.group_by(keys, use_threads=False).aggregate([([], "count_all")])
    found = found.set_column(found.schema.get_field_index("label_positive"), "label_positive", found.column("label_positive").cast(pa.int8())).sort_by([(c, "ascending") for c in keys]).combine_chunks()
    codes = found.column("repertoire_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    label = found.column("label_positive").combine_chunks()
    sides = label.fill_null(-1).to_numpy(zero_copy_only=False)
    words = found.column("junction_aa").cast(pa.large_string()).combine_chunks()
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    letters = np.frombuffer(data, dtype=np.uint8)[: ends[-1]] if data else np.empty(0, np.uint8)
    begun = np.append(0, np.cumsum((letters & 0xC0) != 0x80))  # letters that begin before a byte
    lengths = np.diff(begun[ends])
    n = sum(np.maximum(lengths - k - (at is not None) + 1, 0) for k, at in cuts)
    firsts = np.flatnonzero(np.append(True, (np.diff(codes) != 0) | (np.diff(sides) != 0)))
    marks = np.stack([np.diff(ends), found.column("count_all").to_numpy()]).astype(np.int32)
    zipped = lambda x: pa.compress(x.tobytes(), codec="zstd", asbytes=True)
    spans = list(zip(firsts, np.append(firsts[1:], len(words)), strict=True))
    return pa.RecordBatch.from_arrays(
        [
            found.column("repertoire_id").combine_chunks().take(pa.array(firsts)),
            label.take(pa.array(firsts)).cast(pa.bool_()),
            pa.array(np.add.reduceat(n, firsts), pa.int64()),
            pa.array([b - a for a, b in spans], pa.int32()),
            pa.array([ends[b] - ends[a] for a, b in spans], pa.int32()),
            pa.array([zipped(letters[ends[a] : ends[b]]) for a, b in spans], pa.binary()),
            pa.array([zipped(marks[:, a:b]) for a, b in spans], pa.binary()),
        ],
        names=["repertoire_id", "label_positive", "n", "words", "size", "letters", "marks"],
    )


def _opened(batch: pa.RecordBatch, i: int) -> tuple[bytes, np.ndarray]:
    """The bytes of a row's sequences, and (bytes, times) of each."""
    words, size = batch.column("words")[i].as_py(), batch.column("size")[i].as_py()
    letters = pa.decompress(batch.column("letters")[i].as_py(), size, codec="zstd", asbytes=True) if size else b""
    return letters, np.frombuffer(pa.decompress(batch.column("marks")[i].as_py(), 8 * words, codec="zstd", asbytes=True), dtype=np.int32).reshape(2, words)


def unpacked(packs: DataFrame) -> DataFrame:
    """(repertoire_id, label_positive, junction_aa, w) of packed sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                letters, (sizes, w) = _opened(batch, i)
                ends = pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32))
                words = pa.StringArray.from_buffers(len(sizes), ends, pa.py_buffer(letters))
                own = pa.array(np.full(len(sizes), i))
                yield pa.RecordBatch.from_arrays([batch.column("repertoire_id").take(own), batch.column("label_positive").take(own), words, pa.array(w.astype(np.int64))], names=["repertoire_id", "label_positive", "junction_aa", "w"])

    return packs.mapInArrow(run, f"{_keys(packs)}, junction_aa string, w long")


def counted(packs: DataFrame, ks: tuple[int, ...], gaps: bool, tasks: int) -> DataFrame:
    """(repertoire_id, label_positive, k, kmer, cnt) of packed sequences. Rows of a repertoire come to one task, one after
    the other, and its windows are counted there: only packed rows are shuffled."""
    dealt = packs.repartition(tasks, "repertoire_id", "label_positive").sortWithinPartitions("repertoire_id", "label_positive")
    return dealt.mapInArrow(_count(variants(ks, gaps)), f"{_keys(packs)}, k int, kmer string, cnt long")


def _count(cuts: list[tuple[int, int | None]]) -> Step:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[tuple] = []  # (repertoire, label), its place among those held, its sequences
        size, last, kind = 0, None, None
        for batch in batches:
            kind = batch.schema.field("repertoire_id").type
            for i, key in enumerate(zip(batch.column("repertoire_id").to_pylist(), batch.column("label_positive").to_pylist(), strict=True)):
                if key != last and size >= CHUNK:
                    yield from _counts(whole, kind, cuts)
                    whole, size = [], 0
                place = 0 if not whole else whole[-1][1] + (key != last)
                whole.append((key, place, *_opened(batch, i)))
                size, last = size + batch.column("n")[i].as_py(), key
        if whole:
            yield from _counts(whole, kind, cuts)

    return run


def _counts(whole: list[tuple], kind: pa.DataType, cuts: list[tuple[int, int | None]]) -> Iterator[pa.RecordBatch]:
    owners = list(dict((place, key) for key, place, _, _ in whole).values())
    text = b"".join(letters for _, _, letters, _ in whole)
    sizes, w = np.concatenate([marks for *_, marks in whole], axis=1).astype(np.int64)
    of = np.repeat([place for _, place, _, _ in whole], [marks.shape[1] for *_, marks in whole])
    if text.isascii():
        codes = np.frombuffer(text, dtype=np.uint8)
    else:
        begun = np.append(0, np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80))
        sizes = np.diff(begun[np.append(0, np.cumsum(sizes))])
        codes = np.frombuffer(text.decode().encode("utf-32-le"), dtype=np.uint32)
    if not len(codes):
        return
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # letters from here to the sequence's end
    of, w = np.repeat(of, sizes), np.repeat(w, sizes)
    present = np.flatnonzero(np.bincount(codes))
    ranks = np.zeros(present[-1] + 1, dtype=np.int64)
    ranks[present] = np.arange(len(present))
    letter = ranks[codes]
    reps = pa.array([key[0] for key in owners], kind), pa.array([key[1] for key in owners], pa.bool_())
    for k, at in cuts:
        taken = [j for j in range(k + (at is not None)) if j != at]
        begin = np.flatnonzero(left > taken[-1])
        if not len(begin):
            continue
        key, bound = of[begin], len(owners)
        for j in taken:
            if bound > MOST // len(present):
                some, key = np.unique(key, return_inverse=True)
                bound = len(some)
            key, bound = key * len(present) + letter[begin + j], bound * len(present)
        order = np.argsort(key)
        firsts = np.flatnonzero(np.diff(key[order], prepend=-1))
        first = begin[order[firsts]]
        owner = pa.array(of[first])
        yield pa.RecordBatch.from_arrays(
            [*(c.take(owner) for c in reps), pa.array(np.full(len(first), k, dtype=np.int32)), _texts(codes, first, taken, at), pa.array(np.add.reduceat(w[begin[order]], firsts))],
            names=["repertoire_id", "label_positive", "k", "kmer", "cnt"],
        )


def _texts(codes: np.ndarray, first: np.ndarray, taken: list[int], at: int | None) -> pa.Array:
    """The letters at these places after each of `first`, with a dot for a gap."""
    cut = codes[first[:, None] + np.array(taken)]
    if at is not None:
        cut = np.insert(cut, at, ord("."), axis=1)
    n, width = cut.shape
    if cut.dtype == np.uint8:
        return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(cut)))
    text = np.ascontiguousarray(cut).tobytes().decode("utf-32-le")
    return pa.array([text[i : i + width] for i in range(0, n * width, width)], pa.string())
