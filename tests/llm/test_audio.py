"""Audio features against plain versions: direct convolution, sums of sines and loops over frames."""

import math
import random

import numpy as np
import pytest

from clonoscope.llm import audio


def plain_resample(x):
    """Five zeros-filled samples for each, the windowed sinc over them, and each eighth of that."""
    half = 10 * audio.DOWN
    window = [0.5 - 0.5 * math.cos(2 * math.pi * (k + half + 1) / (2 * half + 2)) for k in range(-half, half + 1)]
    taps = [window[k + half] * (1 if k == 0 else math.sin(math.pi * k / audio.DOWN) / (math.pi * k / audio.DOWN)) * audio.UP / audio.DOWN for k in range(-half, half + 1)]
    out = []
    for n in range(-(-len(x) * audio.UP // audio.DOWN)):
        at = n * audio.DOWN
        out.append(sum(x[i] * taps[at - i * audio.UP + half] for i in range(len(x)) if abs(at - i * audio.UP) <= half))
    return np.array(out)


def plain_mel(y):
    """The log of each band's power and the log of the energy, frame by frame."""
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    low, high = mel(40), mel(audio.TARGET / 2)
    edges = [700 * (10 ** ((low + (high - low) * i / (audio.BANDS + 1)) / 2595) - 1) for i in range(audio.BANDS + 2)]
    count = 1 + max(0, math.ceil((len(y) - audio.FRAME) / audio.HOP))
    bands, energy = [], []
    k, t = np.arange(audio.FRAME // 2 + 1), np.arange(audio.FRAME)
    basis = np.exp(-2j * np.pi * np.outer(k, t) / audio.FRAME)
    for f in range(count):
        frame = np.zeros(audio.FRAME)
        part = y[f * audio.HOP : f * audio.HOP + audio.FRAME]
        frame[: len(part)] = part
        hann = np.array([0.5 - 0.5 * math.cos(2 * math.pi * i / audio.FRAME) for i in range(audio.FRAME)])
        power = np.abs(basis @ (frame * hann)) ** 2
        row = []
        for b in range(audio.BANDS):
            a, c, e = edges[b : b + 3]
            total = 0.0
            for i, p in enumerate(power):
                hz = i * audio.TARGET / audio.FRAME
                total += p * max(0.0, min((hz - a) / (c - a), (e - hz) / (e - c)))
            row.append(math.log(total + 1e-6))
        bands.append(row)
        energy.append(math.log10(sum(frame**2) / audio.FRAME + 1e-9))
    return np.array(bands), np.array(energy)


def plain_segments(energy):
    low, high = energy.mean(), energy.mean() + 0.5 * energy.std()
    out, begin = [], None
    for i, e in enumerate([*energy, -math.inf]):
        if e >= low and begin is None:
            begin = i
        elif e < low and begin is not None:
            if max(energy[begin:i]) >= high:
                out.append((begin, i))
            begin = None
    return out


def texts():
    r = random.Random(3)
    return ["", "short", "the same words again " * 40, "".join(r.choices("abc \nÜ漢", k=1700)), "\n" * 300 + "~" * 500 + " " * 900]


@pytest.mark.parametrize("k", range(5))
def test_each_step(k):
    data, _ = audio.payload(texts()[k])
    x = (np.frombuffer(data, dtype=np.uint8).astype(np.float32) - 128) / 128
    y = audio.resample(x)
    assert y == pytest.approx(plain_resample(x.tolist()), abs=2e-5)
    mel, energy = audio.log_mel(y)
    want, loud = plain_mel(y.astype(float))
    assert mel == pytest.approx(want, abs=2e-2) and energy == pytest.approx(loud, abs=1e-3)
    assert audio.segments(energy) == plain_segments(energy.astype(float))


def test_the_query_as_the_plain_version(spark):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in audio.media_columns(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, text in rows:
        data, _ = audio.payload(text)
        y = plain_resample(((np.frombuffer(data, dtype=np.uint8).astype(float) - 128) / 128).tolist())
        mel, energy = plain_mel(y)
        frames, spans, loud, bands = got[doc]["feature"].split("|")
        want = plain_segments(energy)
        seconds = sum(((b - 1) * audio.HOP + audio.FRAME - a * audio.HOP) / audio.TARGET for a, b in want)
        assert int(frames) == len(mel) and abs(int(spans) - len(want)) <= 1 and (int(spans) != len(want) or float(loud) == pytest.approx(seconds, abs=0.05))
        assert [float(b) for b in bands.split(",")] == pytest.approx(mel.mean(axis=0), abs=0.03)
