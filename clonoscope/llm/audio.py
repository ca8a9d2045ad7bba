"""Media columns: payloads as 8-bit audio, and features of what is read back."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoscope.llm.common import table

RATE, UP, DOWN = 16_000, 5, 8
TARGET = RATE * UP // DOWN
FRAME, HOP, BANDS, PATCH = 256, 128, 20, 32
UNIT = 64
#: Rows of windows, and frames, that are worked on at a time, so that long payloads need little memory.
WINDOWS, FRAMES = 1 << 16, 1 << 12
#: Bytes of media and tensors after which a task hands its rows on.
HELD = 1 << 26


def _kernel() -> tuple[np.ndarray, int]:
    """The polyphase filter as a matrix: a window of input times it gives UP outputs, DOWN inputs further on each row.
    The second value is how far the window begins before the outputs' place."""
    half = 10 * max(UP, DOWN)
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / max(UP, DOWN)) * np.hanning(2 * half + 3)[1:-1] * UP / max(UP, DOWN)
    before = half // UP + 1
    width = before + (UP - 1) * DOWN // UP + half // UP + 2
    matrix = np.zeros((width, UP), dtype=np.float32)
    for r in range(UP):
        for i in range(width):
            k = r * DOWN - (i - before) * UP  # the tap between this output and this input, on the finer grid
            if -half <= k <= half:
                matrix[i, r] = taps[k + half]
    return matrix, before


def _mel() -> np.ndarray:
    """Triangles that are equally wide in mel, for power spectra of FRAME samples."""
    to, back = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = back(np.linspace(to(40.0), to(TARGET / 2), BANDS + 2))
    f = np.fft.rfftfreq(FRAME, 1 / TARGET)
    rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_KERNEL, _BEFORE = _kernel()
_MEL, _HANN = _mel(), np.hanning(FRAME + 1)[:-1].astype(np.float32)


def payload(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 bytes with zeros up to a positive multiple of UNIT, and their number before that."""
    data = (text or "").encode()
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data)), len(data)


def to_wave(data: bytes) -> bytes:
    """A mono WAVE file whose 8-bit samples are the bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, RATE, len(data), "NONE", ""))
        w.writeframes(data)
    return out.getvalue()


def from_wave(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def resample(x: np.ndarray) -> np.ndarray:
    """From RATE to TARGET samples a second, zeros around the signal."""
    n = -(-len(x) * UP // DOWN)
    rows = -(-n // UP)
    padded = np.zeros(rows * DOWN + len(_KERNEL), dtype=np.float32)
    padded[_BEFORE : _BEFORE + len(x)] = x
    view = np.lib.stride_tricks.sliding_window_view(padded, len(_KERNEL))[: rows * DOWN : DOWN]
    return np.concatenate([(view[i : i + WINDOWS] @ _KERNEL).ravel() for i in range(0, rows, WINDOWS)])[:n]


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel bands (frames, BANDS) and log energy of overlapping frames; at least one frame, zeros behind the end."""
    frames = 1 + max(0, -(-(len(y) - FRAME) // HOP))
    padded = np.zeros((frames - 1) * HOP + FRAME, dtype=np.float32)
    padded[: len(y)] = y[: len(padded)]
    view = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    mel, energy = np.empty((frames, BANDS), dtype=np.float32), np.empty(frames, dtype=np.float32)
    for i in range(0, frames, FRAMES):
        part = view[i : i + FRAMES]
        spectrum = np.fft.rfft(part * _HANN, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mel[i : i + FRAMES] = np.log(power @ _MEL + 1e-6)
        energy[i : i + FRAMES] = np.log10(np.einsum("ij,ij->i", part, part) / FRAME + 1e-9)
    return mel, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames above the mean that somewhere exceed it by half a deviation (hysteresis), end exclusive."""
    low = energy.mean(dtype=np.float64)
    high = low + 0.5 * energy.std(dtype=np.float64)
    edges = np.flatnonzero(np.diff(energy >= low, prepend=False, append=False))
    loud = np.concatenate([[0], np.cumsum(energy >= high)])
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if loud[b] > loud[a]]


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream of one batch: patches of PATCH frames as a fixed-shape tensor column, with their time spans."""
    n = -(-len(mel) // PATCH)
    patches = np.zeros((n * PATCH, BANDS), dtype=np.float32)
    patches[: len(mel)] = mel
    begin = np.arange(n) * PATCH
    end = np.minimum(begin + PATCH, len(mel))
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(patches.reshape(n, PATCH, BANDS))
    batch = pa.RecordBatch.from_arrays([pa.array(begin * HOP / TARGET), pa.array(((end - 1) * HOP + FRAME) / TARGET), column], names=["start_s", "end_s", "log_mel"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a WAVE file and the features of the samples read back from it.

    Returns id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes read back), media, n_frames,
    segments (start_s, end_s of loud runs), tensors (an Arrow stream of fixed-shape log-mel tensors with time spans)
    and feature, a short digest: frames, segments, loud seconds, and the mean of each band.

    Defined cases: null and empty texts are 64 zero bytes; equal texts have equal values, as each is worked on alone;
    repeated rows keep a row each; texts of any length are taken whole, in blocks; extra columns are not read. Rows
    never leave their task."""
    times = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    schema = (
        f"`{id_col}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, n_frames long, "
        "segments array<struct<start_s: double, end_s: double>>, tensors binary, feature string"
    )
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), times, pa.binary(), pa.string()]
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "n_frames", "segments", "tensors", "feature"]

    def one(doc: int, text: str | None) -> tuple:
        data, n = payload(text)
        media = to_wave(data)
        read = from_wave(media)
        mel, energy = log_mel(resample((np.frombuffer(read, dtype=np.uint8).astype(np.float32) - 128) / 128))
        spans = [{"start_s": a * HOP / TARGET, "end_s": ((b - 1) * HOP + FRAME) / TARGET} for a, b in segments(energy)]
        loud = sum(s["end_s"] - s["start_s"] for s in spans)
        bands = ",".join(f"{v:.2f}" for v in mel.mean(axis=0, dtype=np.float64))
        return doc, n, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-UNIT:]), media, len(mel), spans, tensors(mel), f"{len(mel)}|{len(spans)}|{loud:.3f}|{bands}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows.append(one(doc, text.as_py()))
                held += len(rows[-1][5]) + len(rows[-1][8])
                if held > HELD or len(rows) >= 200:
                    yield handed()
                    held = 0
        if rows:
            yield handed()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as audio, with digests of the stored media."""
    return media_columns(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
