"""A seeded generator of demonstration speech: harmonic voices, the synthetic ones over-regular and low-passed."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 16000

# Fixed values of the signal model.
FIRST_PITCH, PITCH_STEP = 105.0, 18.0
FORMANTS, BANDWIDTHS = (700.0, 1220.0, 2600.0), (90.0, 110.0, 170.0)
FORMANT_STEP, MIDDLE_SPEAKER = 0.05, 3.5
TILT_KNEE = 100.0
DECLINATION, SWEEP, SWEEP_HZ, JITTER, SHIMMER = 0.08, 0.04, 0.7, 0.012, 0.08
NOISE = {False: 0.035, True: 0.010}
SYLLABLE_HZ, MARGIN, FADE, PEAK = (3.0, 5.0), (0.10, 0.35), 0.02, (0.25, 0.65)


def speaker_profile(index: int) -> dict:
    """The voice of a speaker number: pitch and formants rise with it."""
    scale = 1 + FORMANT_STEP * (index - MIDDLE_SPEAKER)
    return {"f0": FIRST_PITCH + PITCH_STEP * index, "formants": tuple(f * scale for f in FORMANTS), "bandwidths": BANDWIDTHS}


def formant_envelope(f: np.ndarray, formants: tuple[float, ...], bandwidths: tuple[float, ...]) -> np.ndarray:
    """Resonance curves, half as wide as the bandwidths, under a falling tilt; at most 1."""
    e = sum(1 / (1 + (2 * (f - c) / b) ** 2) for c, b in zip(formants, bandwidths, strict=True)) / (1 + np.maximum(f, 1.0) / TILT_KNEE)
    return e / e.max() if len(e) and e.max() > 0 else e


def syllables(n: int, rng: np.random.Generator, rate: int = RATE) -> np.ndarray:
    """Raised cosines at a syllable rate, between silent margins with short fades."""
    t = np.arange(n) / rate
    speed, phase = rng.uniform(*SYLLABLE_HZ), rng.uniform(0, 2 * np.pi)
    level = 0.55 + 0.45 * np.cos(2 * np.pi * speed * t + phase)
    head, tail = rng.uniform(*MARGIN), rng.uniform(*MARGIN)
    gate = ((t >= head) & (t <= n / rate - tail)).astype(np.float64)
    fade = 0.5 - 0.5 * np.cos(np.linspace(0, np.pi, max(1, int(FADE * rate))))
    if fade.sum() > 0 and n:
        # The middle n of the full convolution, also where the fade is the longer one.
        full = np.convolve(gate, fade / fade.sum())
        gate = full[(len(fade) - 1) // 2 :][:n]
    return level * gate


def low_passed(x: np.ndarray, cutoff: float, rate: int, order: int = 8) -> np.ndarray:
    """A Butterworth low-pass run forward and backward: its squared magnitude and no phase, applied to the spectrum."""
    n = 2 * len(x)
    f = np.fft.rfftfreq(n, 1 / rate)
    gain = 1 / (1 + (np.tan(np.pi * np.minimum(f, 0.4999 * rate) / rate) / np.tan(np.pi * cutoff / rate)) ** (2 * order))
    return np.fft.irfft(np.fft.rfft(x, n) * gain, n)[: len(x)]


def synthesize(spoof: bool, profile: dict, seconds: float, rng: np.random.Generator, lowpass: float = 7000.0, rate: int = RATE) -> np.ndarray:
    """One utterance. Real voices have jitter, shimmer, free phases and breath; spoof ones have none of these and lack the highest band."""
    n = int(round(seconds * rate))
    if not n:
        return np.empty(0, np.float32)
    t = np.arange(n) / rate
    pitch = profile["f0"] * (1 - DECLINATION * t / seconds) * (1 + SWEEP * np.sin(2 * np.pi * SWEEP_HZ * t))
    if not spoof:
        walk = np.cumsum(rng.normal(size=n))
        pitch = pitch * (1 + JITTER * walk / (np.abs(walk).max() + 1e-9))
    phase = 2 * np.pi * np.cumsum(pitch) / rate
    k = np.arange(1, int(rate / 2 // profile["f0"]) + 1)
    k = k[k * profile["f0"] < rate / 2]
    level = formant_envelope(k * profile["f0"], profile["formants"], profile["bandwidths"])
    start = np.zeros(len(k)) if spoof else rng.uniform(0, 2 * np.pi, len(k))
    if not spoof:
        level = level * (1 + rng.normal(0, SHIMMER, len(k)))
    x = np.zeros(n)
    for i, a, s in zip(k, level, start, strict=True):
        x += a * np.sin(i * phase + s)
    x = (x + NOISE[spoof] * rng.normal(size=n)) * syllables(n, rng, rate)
    if spoof:
        x = low_passed(x, lowpass, rate)
    peak = np.abs(x).max()
    return (x * (rng.uniform(*PEAK) / peak) if peak > 0 else x).astype(np.float32)


def spoof_places(per_speaker: int, fraction: float = 0.5) -> list[int]:
    """The utterances of a speaker that are spoof, spread evenly over them."""
    n = int(round(per_speaker * fraction))
    return sorted(set(np.round(np.linspace(0, per_speaker - 1, n)).astype(int).tolist())) if n > 0 else []


def demo_corpus(spark: SparkSession, speakers: int = 8, per_speaker: int = 15, seconds: float = 2.0, seed: int = 1337, jitter: float = 0.5, spoof_fraction: float = 0.5, attacks: tuple[str, ...] = ("A01", "A02"), lowpass: float = 7000.0, rate: int = RATE) -> DataFrame:
    """(utt_id, speaker, attack, label, sample_rate, samples); a row depends on the seed and its number alone."""
    places = {u: i for i, u in enumerate(spoof_places(per_speaker, spoof_fraction))}

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for i in p["id"].tolist():
                s, u = divmod(i, per_speaker)
                rng = np.random.default_rng([seed, i])
                length = float(np.clip(rng.normal(seconds, jitter / 2), seconds - jitter, seconds + jitter))
                fake = u in places
                attack = attacks[(s * len(places) + places[u]) % len(attacks)] if fake else "bonafide"
                x = synthesize(fake, speaker_profile(s), length, rng, lowpass, rate)
                out.append((f"LA_T_{i + 1:07d}", f"LA_{s:04d}", attack, "spoof" if fake else "bonafide", rate, x))
            yield pd.DataFrame(out, columns=["utt_id", "speaker", "attack", "label", "sample_rate", "samples"])

    return spark.range(speakers * per_speaker).mapInPandas(rows, "utt_id string, speaker string, attack string, label string, sample_rate int, samples array<float>")


def protocol_lines(corpus: DataFrame) -> DataFrame:
    """(value): a listing of the corpus with five columns a line."""
    attack = F.when(F.col("label") == "spoof", F.col("attack")).otherwise("-")
    return corpus.select(F.concat_ws(" ", "speaker", "utt_id", F.lit("-"), attack, "label").alias("value"))


def write_demo(corpus: DataFrame, root: str) -> DataFrame:
    """Writes <root>/flac/<utt_id>.flac from the executors, each file first under another name, and <root>/protocol.txt; (path, n_bytes) of the files.

    root must be a folder that all executors and the driver see, by path or by a URI that Arrow can open.
    """
    from pyarrow import fs

    from vocalis.sources.audio import encode_flac

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))
        files.create_dir(f"{base}/flac", recursive=True)
        for b in batches:
            paths, sizes = [], []
            for utt, rate, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data, path = encode_flac(x.values.to_numpy(), rate), f"{base}/flac/{utt}.flac"
                with files.open_output_stream(path + ".part") as out:
                    out.write(data)
                files.move(path + ".part", path)
                paths.append(path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "n_bytes"])

    done = corpus.select("utt_id", "sample_rate", "samples").mapInArrow(put, "path string, n_bytes long").collect()
    files, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))
    with files.open_output_stream(f"{base}/protocol.txt") as out:
        for r in protocol_lines(corpus.select("speaker", "utt_id", "attack", "label").orderBy("utt_id")).toLocalIterator():
            out.write(f"{r.value}\n".encode())
    return corpus.sparkSession.createDataFrame([(r.path, r.n_bytes) for r in done], "path string, n_bytes long")
