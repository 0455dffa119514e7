"""Signal functions as Catalyst expressions over array columns: for short signals, inside code generation."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, even where body uses it for each element of an array."""
    return F.get(F.transform(F.array(value), body), 0)


def pre_emphasis(x: Column, coefficient: float = 0.97) -> Column:
    """y[0] = x[0], y[n] = x[n] - coefficient * x[n-1]."""
    return F.transform(x, lambda v, i: F.when(i == 0, v).otherwise(v - coefficient * F.get(x, i - 1)))


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def peak_normalize(x: Column, target: float = 1.0, eps: float = 1e-9) -> Column:
    """Scaled to the target peak; a signal below eps stays."""
    return bound(peak(x), lambda top: F.when(top < eps, x).otherwise(F.transform(x, lambda v: v * target / top)))


def fix_length(x: Column, length: int, pad: str = "repeat", start: Column | int = 0) -> Column:
    """Exactly `length` samples: tiled or zero-padded if shorter, cropped from `start` if longer. Empty gives null."""
    if length <= 0 or pad not in ("repeat", "zeros"):
        raise ValueError(f"length {length}, pad {pad!r}")
    n = F.size(x)
    longer = F.slice(x, F.lit(start) + 1, length)
    if pad == "repeat":
        shorter = F.slice(F.flatten(F.array_repeat(x, F.ceil(F.lit(length) / n).cast("int"))), 1, length)
    else:
        shorter = F.concat(x, F.array_repeat(F.lit(0.0), F.lit(length) - n))
    return F.when(n == 0, None).when(n >= length, longer).otherwise(shorter)


def num_frames(n: Column, frame: int, hop: int) -> Column:
    return F.when(n < frame, 0).otherwise(1 + F.floor((n - frame) / hop)).cast("long")


def ms_to_samples(ms: Column, rate: int) -> Column:
    """Halves go to the even number."""
    return F.bround(ms * rate / 1000).cast("long")


def next_power_of_two(n: Column) -> Column:
    return F.when(n <= 1, 1).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n)))).cast("long")


def hamming(length: int) -> list[float]:
    """Periodic Hamming window."""
    return [0.54 - 0.46 * math.cos(2 * math.pi * i / length) for i in range(length)]


def frames(x: Column, frame: int, hop: int) -> Column:
    """Uncentred frames; none if the signal is shorter than one."""
    n = num_frames(F.size(x), frame, hop)
    return F.when(n == 0, F.array().cast("array<array<double>>")).otherwise(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: F.slice(x, k * hop + 1, frame)))


def windowed(x: Column, window: list[float]) -> Column:
    return F.zip_with(x, F.array(*map(F.lit, window)), lambda a, b: a * b)


def mean_square(x: Column) -> Column:
    return total(F.transform(x, lambda v: v * v)) / F.size(x)


def rms_dbfs(x: Column) -> Column:
    rms = F.sqrt(mean_square(x))
    return F.when(rms > 1e-12, 20 * F.log10(rms)).otherwise(F.lit(-120.0))


def zero_crossings(x: Column, threshold: float = 1e-10) -> Column:
    """Sign changes between neighbours; values within the threshold count as positive."""
    def step(a: Column, v: Column) -> Column:
        negative = ~(F.abs(v) <= threshold) & (v < 0)
        return F.struct((a["n"] + F.when(a["last"] != negative, 1).otherwise(0)).alias("n"), negative.alias("last"))

    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("boolean").alias("last"))
    return F.aggregate(x, start, step, lambda a: a["n"])


def magnitudes(x: Column, n: int) -> Column:
    """|DFT| at bins 0..n/2, by definition: for short signals only; long ones go through the numpy kernels."""
    cos = [[math.cos(2 * math.pi * k * t / n) for t in range(n)] for k in range(n // 2 + 1)]
    sin = [[math.sin(2 * math.pi * k * t / n) for t in range(n)] for k in range(n // 2 + 1)]

    def part(row: list[float]) -> Column:
        return total(F.zip_with(x, F.array(*map(F.lit, row)), lambda a, b: a * b))

    return F.array(*(F.sqrt(F.pow(part(c), 2) + F.pow(part(s), 2)) for c, s in zip(cos, sin, strict=True)))


def centroid(m: Column, step: float) -> Column:
    """Mean frequency weighted by magnitude; 0 for silence."""
    return F.coalesce(F.try_divide(total(F.transform(m, lambda v, k: v * k * step)), total(m)), F.lit(0.0))


def bandwidth(m: Column, c: Column, step: float) -> Column:
    return F.sqrt(F.coalesce(F.try_divide(total(F.transform(m, lambda v, k: v * F.pow(k * step - c, 2))), total(m)), F.lit(0.0)))


def rolloff_bin(m: Column, share: float = 0.85) -> Column:
    """First bin whose running sum reaches the share of the total."""
    def walk(target: Column) -> Column:
        def step(a: Column, v: Column) -> Column:
            so_far = a["sum"] + v
            return F.struct(so_far.alias("sum"), (a["bin"] + F.when(so_far >= target, 0).otherwise(1)).alias("bin"))

        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("bin"))
        # Magnitudes are not negative, so once the sum is there it stays.
        return F.aggregate(m, start, step, lambda a: F.when(a["bin"] < F.size(m), a["bin"]).otherwise(-1))

    return bound(share * total(m), walk)
