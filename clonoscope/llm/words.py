"""Word hashes of whole texts, in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1
_FACTOR = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes that are hashed at a time; longer texts are cut at white space.
PIECE = 1 << 20

# a byte's code: one more than itself, A-Z as a-z, 0 for the six white spaces
_CODES = np.arange(1, 257).astype(np.uint64)
_CODES[65:91] = _CODES[97:123]
_CODES[[32, 9, 10, 11, 12, 13]] = 0


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHashes:
    """64-bit hashes of words: A-Z lower-cased, cut at space, tab, line feed, vertical tab, form feed and carriage
    return. A word's hash is a polynomial in its bytes modulo 2^64, from differences of running sums, then mixed."""

    def __init__(self) -> None:
        self._grow(1 << 14)

    def _grow(self, n: int) -> None:
        self.up, self.down = _powers(_FACTOR, n), _powers(pow(_FACTOR, -1, 1 << 64), n)

    def __call__(self, text: bytes) -> np.ndarray:
        """The hashes of one text's words."""
        parts, at = [np.empty(0, dtype=np.uint64)], 0
        while at < len(text):
            end = at + PIECE
            if end < len(text):
                cuts = [text.rfind(c, at, end) for c in b" \n\t\r\v\f"]
                later = [p for c in b" \n\t\r\v\f" if (p := text.find(c, end)) >= 0]
                end = max(cuts) if max(cuts) > at else min(later, default=len(text))
            piece = np.frombuffer(text, dtype=np.uint8)[at:end]
            parts.append(self._of(piece, np.array([0, len(piece)]))[0])
            at = end
        return np.concatenate(parts)

    def _of(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of texts that stand one behind the other, and where each text's begin and end."""
        n = len(data)
        if n > len(self.up):
            self._grow(1 << (n - 1).bit_length())
        code = _CODES[data]
        inked = code != 0
        edge = np.zeros(n + 1, dtype=bool)
        edge[bounds] = True
        starts = np.flatnonzero(inked & (~np.concatenate([[False], inked[:-1]])[:n] | edge[:n]))
        ends = np.flatnonzero(inked & (~np.concatenate([inked[1:], [False]])[:n] | edge[1:])) + 1
        sums = np.empty(n + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(code * self.up[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        h = (h ^ (h >> np.uint64(30))) * _MIX1
        h = (h ^ (h >> np.uint64(27))) * _MIX2
        return h ^ (h >> np.uint64(31)), np.searchsorted(starts, bounds)

    def blocks(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, hashes, bounds) for runs of texts of about PIECE bytes, or one longer text: text begin + i has
        the hashes from bounds[i] to bounds[i + 1]. Null is empty."""
        texts = pc.fill_null(texts, b"")
        wide = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
        _, offsets, values = texts.buffers()
        at = np.frombuffer(offsets, dtype=wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.empty(0, dtype=np.uint8)
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + PIECE, side="right")) - 1)
            piece = data[at[begin] : at[end]]
            if len(piece) > PIECE:
                h = self(piece.tobytes())
                yield begin, end, h, np.array([0, len(h)])
            else:
                yield begin, end, *self._of(piece, at[begin : end + 1] - at[begin])
            begin = end


def hashed(batches: Iterator[pa.RecordBatch], name: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the hashes of all their texts' words and their bounds."""
    hashes = WordHashes()
    for batch in batches:
        for begin, end, h, bounds in hashes.blocks(batch.column(name)):
            yield batch.slice(begin, end - begin), h, bounds


def places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """So many places from each start on, run by run."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - before, counts)
