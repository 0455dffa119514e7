from __future__ import annotations

import numpy as np
import pytest

from vocalis.functions import kernels as k
from vocalis.schemas import FEATURES, feature_set
from vocalis.sources import audio

SINE = 0.5 * np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)


def test_names_and_sets():
    assert len(FEATURES) == len(set(FEATURES)) == 92
    assert [len(feature_set(n)) for n in ("MFCC", "LFCC", "MFCC+Spectral", "Combined")] == [40, 40, 52, 92]


def test_feature_shapes_and_closed_forms():
    mag = k.centred_spectrogram(SINE)
    assert k.mfcc(mag).shape == (20, 101) and k.lfcc(mag).shape == (20, 101) and k.spectral(mag).shape == (4, 101)
    t = k.time_features(SINE)
    assert t.shape == (2, 101)
    assert abs(t[0, 50] - 0.125) < 1e-6 and abs(t[1, 50] - 2 * 440 / 16000) < 0.003
    v = k.feature_vector(SINE)
    assert v.shape == (92,) and np.isfinite(v).all()
    assert abs(v[40] - 440) < 60


def test_spectrogram_columns_are_ffts():
    x = np.random.default_rng(0).normal(size=8000)
    s = k.spectrogram(x)
    w = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(400) / 400)
    assert np.allclose(s[:, 7], np.abs(np.fft.rfft(x[7 * 160 : 7 * 160 + 400] * w, 512)))
    assert k.spectrogram(np.zeros(64000)).shape == (257, 398) and k.spectrogram(np.ones(100)).shape == (257, 0)
    assert abs(int(k.spectrogram(np.sin(2 * np.pi * 2000 * np.arange(16000) / 16000)).mean(1).argmax()) - 64) <= 1
    with pytest.raises(ValueError):
        k.spectrogram(x, 400, 160, 256)


def test_lengths_and_trim():
    a = np.arange(10, dtype=np.float32)
    assert (k.fix_length(a, 25) == 0).sum() == 3
    assert (k.fix_length(np.ones(10), 25, "zeros") == 0).sum() == 15
    assert (k.fix_length(np.arange(100), 40) == np.arange(40)).all()
    got = k.fix_length(np.arange(100), 40, crop="random", rng=np.random.default_rng(1))
    assert (np.diff(got) == 1).all() and got[0] <= 60
    for bad in (lambda: k.fix_length(a, 0), lambda: k.fix_length(np.empty(0), 4), lambda: k.fix_length(a, 25, "x"), lambda: k.fix_length(a, 5, crop="x")):
        with pytest.raises(ValueError):
            bad()
    x = np.concatenate([np.zeros(4000), np.random.default_rng(2).normal(size=8000), np.zeros(4000)])
    assert 6400 <= len(k.trim(x)) < 16000 and len(k.trim(np.zeros(1000))) == 1000
    assert k.silence_ratio(np.zeros(100)) == 1.0
    assert np.allclose(k.preprocess(np.array([1.0, 2, 3, 4]), 4), [1, 1.03, 1.06, 1.09])


def test_resample_keeps_the_tone():
    y = k.resample(np.sin(2 * np.pi * 1000 * np.arange(44100) / 44100), 44100, 16000)
    assert abs(len(y) - 16000) <= 1
    f = np.abs(np.fft.rfft(y * np.hanning(len(y))))
    assert abs(f.argmax() * 16000 / len(y) - 1000) <= 2


def test_wav_round_trip_and_errors():
    x, rate = audio.decode(audio.encode_wav(SINE, 16000))
    assert rate == 16000 and np.abs(x[0] - SINE).max() < 1e-4
    with pytest.raises(RuntimeError, match=r"corrupt\.flac"):
        audio.decode(b"not audio at all", "corrupt.flac")


def test_flac_verbatim_stream():
    bits, total = [], 16

    def put(value: int, n: int) -> None:
        bits.extend((value >> (n - 1 - i)) & 1 for i in range(n))

    samples = [0, 1, -1, 32767, -32768, 100, -100, 7, 9, 11, 13, 15, -3, -5, 2, 4]
    for v, n in ((0b11111111111110, 14), (0, 2), (6, 4), (0, 4), (0, 4), (4, 3), (0, 1), (0, 8), (total - 1, 8), (0, 8), (0, 1), (1, 6), (0, 1)):
        put(v, n)
    for s in samples:
        put(s & 0xFFFF, 16)
    put(0, 16)
    frame = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
    info = bytes(10) + ((16000 << 44) | (0 << 41) | (15 << 36) | total).to_bytes(8, "big") + bytes(16)
    x, rate = audio.decode(b"fLaC" + bytes([0x80]) + (34).to_bytes(3, "big") + info + frame)
    assert rate == 16000 and (x[0] * 32768).round().astype(int).tolist() == samples


def _predicted_frame(x: np.ndarray, order: int, k: int, parts: int, weights: tuple[int, ...] = (), shift: int = 0) -> bytes:
    """One mono 16-bit frame with a polynomial predictor of this order, or a linear one with these weights."""
    bits: list[int] = []

    def put(value: int, n: int) -> None:
        bits.extend((value >> (n - 1 - i)) & 1 for i in range(n))

    for v, n in ((0b11111111111110, 14), (0, 2), (7, 4), (0, 4), (0, 4), (4, 3), (0, 1), (0, 8), (len(x) - 1, 16), (0, 8), (0, 1), (31 + len(weights) if weights else 8 + order, 6), (0, 1)):
        put(v, n)
    for v in x[:order].tolist():
        put(v & 0xFFFF, 16)
    if weights:
        put(12 - 1, 4)
        put(shift, 5)
        for w in weights:
            put(w & 0xFFF, 12)
        rest = [int(x[i]) - (sum(w * int(x[i - 1 - j]) for j, w in enumerate(weights)) >> shift) for i in range(order, len(x))]
    else:
        rest = np.diff(x.astype(np.int64), order).tolist()
    put(0, 2)
    put(parts, 4)
    at = 0
    for i in range(1 << parts):
        n = (len(x) >> parts) - (order if i == 0 else 0)
        put(k, 4)
        for r in rest[at : at + n]:
            v = 2 * r if r >= 0 else -2 * r - 1
            bits.extend([0] * (v >> k) + [1])
            put(v & ((1 << k) - 1), k)
        at += n
    bits.extend([0] * (-len(bits) % 8))
    put(0, 16)
    return bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))


@pytest.mark.parametrize(("order", "weights", "shift"), [(0, (), 0), (1, (), 0), (2, (), 0), (3, (), 0), (4, (), 0), (1, (900,), 10), (3, (1800, -1100, 250), 10)])
def test_flac_predictors(order, weights, shift):
    x = (np.cumsum(np.random.default_rng(order).normal(size=4096)) * 60 + 3000 * np.sin(np.arange(4096) / 9)).round().astype(int)
    frame = _predicted_frame(x, order, 7, 2, weights, shift)
    info = (4096).to_bytes(2, "big") * 2 + bytes(6) + ((16000 << 44) | (15 << 36) | 2 * len(x)).to_bytes(8, "big") + bytes(16)
    got, _ = audio.decode(b"fLaC" + bytes([0x80]) + (34).to_bytes(3, "big") + info + frame + frame)
    assert (got[0] * 32768).round().astype(int).tolist() == [*x.tolist(), *x.tolist()]


def test_flac_round_trip_and_time():
    import time

    x = np.random.default_rng(1).normal(size=64000) * 0.1
    began = time.process_time()
    got, rate = audio.decode(audio.encode_flac(x, 16000))
    assert rate == 16000 and got.shape == (1, 64000) and np.abs(got[0] - x).max() < 1e-4
    assert audio.decode(audio.encode_flac(np.empty(0), 8000))[0].shape == (1, 0)
    frame = _predicted_frame((x[:4096] * 30000).round().astype(int), 2, 12, 0)
    info = (4096).to_bytes(2, "big") * 2 + bytes(3) + len(frame).to_bytes(3, "big") + ((16000 << 44) | (15 << 36) | 16 * 4096).to_bytes(8, "big") + bytes(16)
    assert audio.decode(b"fLaC" + bytes([0x80]) + (34).to_bytes(3, "big") + info + 16 * frame)[0].shape == (1, 65536)
    assert time.process_time() - began < 2
