"""Numpy kernels for full-length signals; pure functions, tested without Spark."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

RATE, FFT, WIN, HOP = 16000, 512, 400, 160


def resample(x: np.ndarray, source: int, target: int, half: int = 32) -> np.ndarray:
    """Windowed-sinc interpolation with the cutoff at the lower Nyquist frequency."""
    if source == target or not len(x):
        return x.astype(np.float32)
    n = int(np.ceil(len(x) * target / source))
    at = np.arange(n) * source / target
    cut = min(1.0, target / source)
    reach = int(np.ceil(half / cut))
    taps = np.arange(-reach, reach + 1)
    out = np.empty(n, np.float32)
    for a in range(0, n, 4096):
        p = at[a : a + 4096]
        base = np.floor(p).astype(int)
        idx = base[:, None] + taps
        d = p[:, None] - idx
        w = cut * np.sinc(cut * d) * (0.5 + 0.5 * np.cos(np.pi * np.clip(d / (reach + 1), -1, 1)))
        out[a : a + 4096] = (np.where((idx >= 0) & (idx < len(x)), x[np.clip(idx, 0, len(x) - 1)], 0) * w).sum(1)
    return out


def trim_bounds(x: np.ndarray, top_db: float = 30.0, frame: int = 2048, hop: int = 512) -> tuple[int, int]:
    """First and end sample whose centred frames lie within top_db of the loudest; all of an all-silent signal."""
    padded = np.pad(x.astype(np.float64), frame // 2)
    power = np.concatenate([[0], np.cumsum(padded**2)])
    starts = np.arange(1 + len(x) // hop) * hop
    rms = np.sqrt(np.maximum(power[starts + frame] - power[starts], 0) / frame)
    level = 20 * np.log10(np.maximum(rms, 1e-5) / max(rms.max(), 1e-5))
    loud = np.flatnonzero(level > -top_db)
    return (int(loud[0]) * hop, min(len(x), (int(loud[-1]) + 1) * hop)) if len(loud) else (0, 0)


def trim(x: np.ndarray, top_db: float = 30.0) -> np.ndarray:
    if not len(x):
        return x
    a, b = trim_bounds(x, top_db)
    return x[a:b] if b > a else x


def silence_ratio(x: np.ndarray, top_db: float = 30.0) -> float:
    if not len(x) or np.abs(x).max() < 1e-6:
        return 1.0
    a, b = trim_bounds(x, top_db)
    return 1.0 - (b - a) / len(x)


def fix_length(x: np.ndarray, length: int, pad: str = "repeat", crop: str = "head", rng: np.random.Generator | None = None) -> np.ndarray:
    if length <= 0 or x.ndim != 1 or not len(x):
        raise ValueError("fix_length needs a positive length and a non-empty one-dimensional signal")
    if len(x) < length:
        if pad == "repeat":
            return np.resize(x, length)
        if pad == "zeros":
            return np.pad(x, (0, length - len(x)))
        raise ValueError(f"unknown pad mode {pad!r}")
    if len(x) > length:
        if crop not in ("head", "random"):
            raise ValueError(f"unknown crop mode {crop!r}")
        start = int((rng or np.random.default_rng()).integers(0, len(x) - length + 1)) if crop == "random" else 0
        return x[start : start + length]
    return x


def preprocess(x: np.ndarray, length: int = 64000, coefficient: float = 0.97, top_db: float | None = None, peak: bool = False, rng: np.random.Generator | None = None) -> np.ndarray:
    """Optional trim and peak normalisation, pre-emphasis, fixed length; cropped at random only with rng."""
    if x.ndim != 1 or not len(x):
        raise ValueError("an empty or multi-channel signal")
    if top_db is not None:
        x = trim(x, top_db)
    top = np.abs(x).max()
    if peak and top >= 1e-9:
        x = x / top
    x = np.concatenate([x[:1], x[1:] - coefficient * x[:-1]]).astype(np.float32)
    return fix_length(x, length, crop="random" if rng is not None else "head", rng=rng)


def spectrogram(x: np.ndarray, frame: int = WIN, hop: int = HOP, fft: int = FFT) -> np.ndarray:
    """Uncentred Hamming frames: (1 + fft/2, frames)."""
    if fft < frame:
        raise ValueError(f"fft size {fft} is below the frame's {frame}")
    if len(x) < frame:
        return np.empty((1 + fft // 2, 0))
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(frame) / frame)
    view = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop]
    return np.abs(np.fft.rfft(view * window, fft)).T


def centred_spectrogram(x: np.ndarray, win: int = WIN, hop: int = HOP, fft: int = FFT) -> np.ndarray:
    """Centred Hann frames, the window padded to the FFT size on both sides."""
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(win) / win)
    left = (fft - win) // 2
    window = np.pad(hann, (left, fft - win - left))
    view = np.lib.stride_tricks.sliding_window_view(np.pad(x, fft // 2), fft)[::hop]
    return np.abs(np.fft.rfft(view * window, fft)).T


@lru_cache(maxsize=8)
def dct_matrix(rows: int, size: int) -> np.ndarray:
    """Orthonormal DCT-II."""
    m = np.cos(np.pi * np.arange(rows)[:, None] * (2 * np.arange(size) + 1) / (2 * size)) * np.sqrt(2 / size)
    m[0] /= np.sqrt(2)
    return m


def _triangles(freqs: np.ndarray, edges: np.ndarray) -> np.ndarray:
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((freqs - lo) / (mid - lo), (hi - freqs) / (hi - mid)))


@lru_cache(maxsize=8)
def linear_bank(rate: int = RATE, fft: int = FFT, filters: int = 40) -> np.ndarray:
    return _triangles(np.linspace(0, rate / 2, 1 + fft // 2), np.linspace(0, rate / 2, filters + 2))


@lru_cache(maxsize=8)
def mel_bank(rate: int = RATE, fft: int = FFT, filters: int = 128) -> np.ndarray:
    """Slaney's scale and area normalisation."""
    top = 15 + 27 * np.log(rate / 2 / 1000) / np.log(6.4)
    mels = np.linspace(0, top, filters + 2)
    edges = np.where(mels < 15, mels * 200 / 3, 1000 * np.exp((mels - 15) * np.log(6.4) / 27))
    return _triangles(np.linspace(0, rate / 2, 1 + fft // 2), edges) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mfcc(mag: np.ndarray, rate: int = RATE, count: int = 20, top_db: float = 80.0) -> np.ndarray:
    db = 10 * np.log10(np.maximum(mel_bank(rate, 2 * (len(mag) - 1)) @ mag**2, 1e-10))
    return dct_matrix(count, len(db)) @ np.maximum(db, db.max() - top_db)


def lfcc(mag: np.ndarray, rate: int = RATE, count: int = 20) -> np.ndarray:
    bank = linear_bank(rate, 2 * (len(mag) - 1))
    return dct_matrix(count, len(bank)) @ np.log(np.maximum(bank @ mag**2, 1e-10))


def spectral(mag: np.ndarray, rate: int = RATE, share: float = 0.85) -> np.ndarray:
    """Centroid, bandwidth, roll-off and flux of each frame."""
    f = np.linspace(0, rate / 2, len(mag))[:, None]
    s = mag.sum(0)
    p = np.divide(mag, s, out=np.zeros_like(mag), where=s > 0)
    c = (f * p).sum(0)
    b = np.sqrt((p * (f - c) ** 2).sum(0))
    roll = f[np.argmax(np.cumsum(mag, 0) >= share * s, 0), 0]
    flux = np.zeros(mag.shape[1])
    q = mag / (s + 1e-10)
    flux[1:] = np.sqrt((np.diff(q, axis=1) ** 2).sum(0))
    return np.stack([c, b, roll, flux])


def time_features(x: np.ndarray, hop: int = HOP, win: int = WIN) -> np.ndarray:
    """Mean square and zero-crossing rate of centred frames."""
    view = np.lib.stride_tricks.sliding_window_view
    energy = (view(np.pad(x, win // 2), win)[::hop].astype(np.float64) ** 2).mean(1)
    edge = np.pad(x, win // 2, mode="edge")
    negative = np.where(np.abs(edge) <= 1e-10, False, edge < 0)
    change = view(negative, win)[::hop]
    zcr = (change[:, 1:] != change[:, :-1]).sum(1) / win
    return np.stack([energy, zcr])


def frame_features(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    """(46, frames), from one transform."""
    mag = centred_spectrogram(x)
    parts = [mfcc(mag, rate), lfcc(mag, rate), spectral(mag, rate), time_features(x)]
    n = min(p.shape[1] for p in parts)
    return np.vstack([p[:, :n] for p in parts])


def feature_vector(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    """92 values: means, then population deviations."""
    f = frame_features(np.asarray(x, np.float64), rate)
    return np.concatenate([f.mean(1), f.std(1)])
