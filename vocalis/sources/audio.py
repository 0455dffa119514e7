"""Audio bytes to samples: PCM WAV by the standard library, FLAC by a small decoder."""

from __future__ import annotations

import hashlib
import io
import wave
from functools import lru_cache
from operator import mul

import numpy as np


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """(channels, samples) float32 and the rate."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = np.frombuffer(w.readframes(w.getnframes()), np.uint8).reshape(-1, width)
    if width == 1:
        x = raw[:, 0].astype(np.float32) / 128 - 1
    else:
        wide = np.zeros((len(raw), 4), np.uint8)
        wide[:, 4 - width :] = raw
        x = wide.view("<i4")[:, 0].astype(np.float64) / 2**31
    return np.ascontiguousarray(x.reshape(-1, channels).T, np.float32), rate


class EndOfStream(ValueError):
    pass


class _Bits:
    """A stream's bits as numpy sees them: any field is a slice, and the next set bit of each place is looked up."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.at, self.size = 0, len(self.bits)
        ones = np.flatnonzero(self.bits)
        places = np.searchsorted(ones, np.arange(self.size))
        self.next = np.append(ones, self.size)[places].tolist()

    def take(self, n: int) -> int:
        end = self.at + n
        if end > self.size:
            raise EndOfStream("the FLAC stream ends early")
        x = int.from_bytes(np.packbits(np.append(np.zeros(-n % 8, np.uint8), self.bits[self.at : end])).tobytes(), "big") if n else 0
        self.at = end
        return x

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        n = (self.next[self.at] if self.at < self.size else self.size) - self.at
        self.take(n + 1)
        return n

    def fields(self, starts: np.ndarray, n: int) -> np.ndarray:
        """The n-bit numbers that begin at these places."""
        out = np.zeros(len(starts), np.int64)
        for i in range(n):
            out = (out << 1) | self.bits[starts + i]
        return out

    def signed_run(self, count: int, n: int) -> np.ndarray:
        """count signed numbers of n bits one after another."""
        if self.at + count * n > self.size:
            raise EndOfStream("the FLAC stream ends early")
        x = self.fields(self.at + n * np.arange(count), n)
        self.at += count * n
        return x - ((x >> (n - 1)) << n) if n else x

    def rice_run(self, count: int, k: int) -> np.ndarray:
        """count Rice codes of parameter k one after another."""
        ones, at, following, size = [], self.at, self.next, self.size
        for _ in range(count):
            if at >= size:
                break
            one = following[at]
            ones.append(one)
            at = one + 1 + k
        if at > size or len(ones) < count:
            raise EndOfStream("the FLAC stream ends early")
        one = np.array(ones, np.int64)
        begins = np.append(self.at, one[:-1] + 1 + k)[:count]
        self.at = at
        v = ((one - begins) << k) | self.fields(one + 1, k)
        return (v >> 1) ^ -(v & 1)


def _residual(b: _Bits, size: int, order: int) -> np.ndarray:
    wide = 5 if b.take(2) else 4
    parts = b.take(4)
    out = []
    for i in range(1 << parts):
        n = (size >> parts) - (order if i == 0 else 0)
        k = b.take(wide)
        out.append(b.signed_run(n, b.take(5)) if k == (1 << wide) - 1 else b.rice_run(n, k))
    return np.concatenate(out)


def _subframe(b: _Bits, size: int, depth: int) -> np.ndarray:
    b.take(1)
    kind = b.take(6)
    wasted = b.unary() + 1 if b.take(1) else 0
    depth -= wasted
    if kind == 0:
        out = np.full(size, b.signed(depth), np.int64)
    elif kind == 1:
        out = b.signed_run(size, depth)
    elif 8 <= kind <= 12:
        # A polynomial predictor of order n: sums of sums, n deep, from the first differences of the warm-up.
        order = kind - 8
        first = b.signed_run(order, depth)
        out = _residual(b, size, order)
        for n in range(order, 0, -1):
            head = np.diff(first, n - 1) if n > 1 else first
            out = np.cumsum(np.append(head[-1], out))[1:]
        out = np.append(first, out)
    elif kind >= 32:
        order = kind - 31
        done = b.signed_run(order, depth).tolist()
        precision = b.take(4) + 1
        shift = b.signed(5)
        weights = b.signed_run(order, precision).tolist()[::-1]
        for r in _residual(b, size, order).tolist():
            done.append(r + (sum(map(mul, weights, done[-order:])) >> shift))
        out = np.array(done, np.int64)
    else:
        raise ValueError(f"reserved FLAC subframe type {kind}")
    return out << wasted


def _frame(b: _Bits, depth: int) -> list[np.ndarray]:
    """One frame's samples by channel."""
    if b.take(14) != 0b11111111111110:
        raise ValueError("no FLAC frame where one is due")
    b.take(2)
    size_code, rate_code, layout, depth_code = b.take(4), b.take(4), b.take(4), b.take(3)
    b.take(1)
    lead = b.take(8)
    more = 0
    while lead & 0x80 and lead >> (7 - more - 1) & 1:
        more += 1
    b.take(8 * more)
    size = 192 if size_code == 1 else 576 << (size_code - 2) if 2 <= size_code <= 5 else b.take(8) + 1 if size_code == 6 else b.take(16) + 1 if size_code == 7 else 256 << (size_code - 8)
    if rate_code >= 12:
        b.take(8 if rate_code == 12 else 16)
    b.take(8)
    d = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}.get(depth_code, depth)
    n = layout + 1 if layout < 8 else 2
    subs = [_subframe(b, size, d + (layout == 8 and c == 1 or layout == 9 and c == 0 or layout == 10 and c == 1)) for c in range(n)]
    b.take(-b.at % 8)
    b.take(16)
    if layout >= 8:
        x, y = subs
        if layout == 8:
            y = x - y
        elif layout == 9:
            x = x + y
        else:
            mid = (x << 1) | (y & 1)
            x, y = (mid + y) >> 1, (mid - y) >> 1
        return [x, y]
    return subs


def decode_flac(data: bytes) -> tuple[np.ndarray, int]:
    """(channels, samples) float32 and the rate."""
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info = 4, False, None
    while not last:
        if at + 4 > len(data):
            raise EndOfStream("the FLAC stream ends early")
        last, kind, n = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            info = int.from_bytes(data[at + 14 : at + 22], "big")
            largest, longest = int.from_bytes(data[at + 6 : at + 8], "big"), int.from_bytes(data[at + 11 : at + 14], "big")
        at += 4 + n
    if info is None:
        raise ValueError("no FLAC stream information")
    rate, channels, depth, total = info >> 44, (info >> 41 & 7) + 1, (info >> 36 & 31) + 1, info & (1 << 36) - 1
    out: list[list[np.ndarray]] = [[] for _ in range(channels)]
    # No frame should be longer than the stream says, or than its samples unpacked; one that is gets more.
    reach, had = longest or 64 + (depth + 8) // 8 * channels * (largest or 65535), 0
    while at < len(data) and (not total or had < total):
        b = _Bits(data[at : at + reach])
        try:
            frame = _frame(b, depth)
        except EndOfStream:
            if at + reach >= len(data):
                raise
            reach *= 2
            continue
        for c, x in zip(out, frame, strict=True):
            c.append(x)
        had += len(frame[0])
        at += b.at // 8
    whole = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
    return (np.array(whole, np.float64) / (1 << (depth - 1))).astype(np.float32), rate


def decode(data: bytes, path: str = "") -> tuple[np.ndarray, int]:
    """(channels, samples) and rate; any failure names the file."""
    try:
        return decode_flac(data) if data[:4] == b"fLaC" else decode_wav(data)
    except Exception as e:
        raise RuntimeError(f"cannot decode {path}: {e}") from e


def encode_wav(x: np.ndarray, rate: int) -> bytes:
    """16-bit PCM of a mono signal."""
    sink = io.BytesIO()
    with wave.open(sink, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 32767 / 32768) * 32768).round().astype("<i2").tobytes())
    return sink.getvalue()


@lru_cache
def _crc_table(bits: int, polynomial: int) -> tuple[int, ...]:
    out = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1) ^ (polynomial if x >> (bits - 1) else 0)
            x &= (1 << bits) - 1
        out.append(x)
    return tuple(out)


def _crc(data: bytes, bits: int, polynomial: int) -> int:
    table, out = _crc_table(bits, polynomial), 0
    for byte in data:
        out = (out << 8 & (1 << bits) - 1) ^ table[out >> (bits - 8) ^ byte]
    return out


def encode_flac(x: np.ndarray, rate: int, block: int = 4096) -> bytes:
    """16-bit FLAC of a mono signal, without prediction: each block verbatim."""
    pcm = (np.clip(x, -1, 32767 / 32768) * 32768).round().astype(">i2")
    stream = (block << 112 | block << 96) + (rate << 44 | 15 << 36 | len(pcm))
    out = [b"fLaC\x80", (34).to_bytes(3, "big"), stream.to_bytes(18, "big"), hashlib.md5(pcm.astype("<i2").tobytes()).digest()]
    for n, a in enumerate(range(0, len(pcm), block)):
        part = pcm[a : a + block]
        number = chr(n).encode("utf-8", "surrogatepass")
        head = b"\xff\xf8\x70\x08" + number + (len(part) - 1).to_bytes(2, "big")
        head += bytes([_crc(head, 8, 0x07)])
        frame = head + b"\x02" + part.tobytes()
        out.append(frame + _crc(frame, 16, 0x8005).to_bytes(2, "big"))
    return b"".join(out)


def load(data: bytes, path: str = "", rate: int = 16000) -> np.ndarray:
    """Mono samples at the wanted rate."""
    from vocalis.functions.kernels import resample

    x, source = decode(data, path)
    return resample(x.mean(0), source, rate)
