"""Substring deduplication on words by recompression.

Rounds of run naming and pair naming turn a document's words into ever longer symbols. Names are hashes of
what they stand for, so equal word sequences get equal names in all documents with no coordination but the
hash, and the side a symbol takes when pairs are formed is a bit of its name. A symbol also carries the
range of words that fixed it: the same words anywhere give the same symbol there. So a window that holds
the whole range of a symbol that occurs once is itself unique. All symbols of the last level are compared
globally; only windows that no unique symbol rules out are compared by their own hashes.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalis.llm import exchange
from vocalis.llm.exchange import mix
from vocalis.llm.shared import cache_of

WINDOW = 35
ROUNDS = 4
_FAR = 1 << 40
_CACHE_ENTRIES = 200_000

ADDED = T.StructType().add("n_words", "long").add("n_removed", "long").add("kept_text", "string")


class _Names(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= _CACHE_ENTRIES:
            self.clear()
        self[word] = h
        return h


_NAMES = _Names()


def word_names(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(_NAMES.__getitem__, words), np.uint64, len(words))


@lru_cache(maxsize=8)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64; n is rounded up by the caller."""
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def forget() -> None:
    """Empties what this worker keeps of words and powers."""
    _NAMES.clear()
    powers.cache_clear()


# Odd 64-bit multipliers of the two window hashes, and what sets the check's bytes apart.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
CHECK_SALT = 0x5DEECE66D
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_names(words: list[bytes], part: int = 1 << 16) -> np.ndarray:
    """Another 64-bit hash of each word: its bytes, mixed, weighted by their places in it, and summed."""
    table, weights, out = mix(_BYTES ^ np.uint64(CHECK_SALT)), powers(BASES[1], 4096)[0], []
    for a in range(0, len(words), part):
        own = words[a : a + part]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        place = np.arange(int(ends[-1])) - np.repeat(starts, sizes)
        np.minimum(place, len(weights) - 1, out=place)
        data = np.frombuffer(b"".join(own), np.uint8)
        out.append(mix(np.add.reduceat(table[data] * weights[place], starts) + sizes.astype(np.uint64)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


class Prefixes:
    """Hashes of any substrings of some bytes, from one running sum."""

    def __init__(self, data: np.ndarray, base: int, salt: int = 0):
        n = len(data)
        self.up, down = powers(base, 1 << max(1, n.bit_length()))
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(_BYTES ^ np.uint64(salt))[data] * down[:n], dtype=np.uint64, out=self.sum[1:])

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sum[start + length] - self.sum[start]) * self.up[start])


def rolling(names: np.ndarray, window: int, base: int) -> np.ndarray:
    """A 64-bit hash of each `window` consecutive names."""
    n = len(names)
    if n < window:
        return np.empty(0, np.uint64)
    up, down = powers(base, 1 << n.bit_length())
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(names * down[:n], dtype=np.uint64, out=s[1:])
    return mix((s[window:] - s[:-window]) * up[: n - window + 1])


def recompress(names: np.ndarray, starts: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the last level: name, and the first word and end of the range that fixed each.

    starts: number of each document's first word. Nothing crosses documents; a symbol that depends on
    where its document begins or ends has a range that no window holds.
    """
    n = len(names)
    first = np.zeros(n, bool)
    first[starts[starts < n]] = True
    low, high = np.arange(n), np.arange(1, n + 1)
    for r in range(rounds):
        if not len(names):
            break
        # Runs: depend on the symbols beside them.
        new = first.copy()
        new[1:] |= names[1:] != names[:-1]
        new[0] = True
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(names))
        opens = first[at]
        closes = np.append(first[end[:-1]], True)
        size = (end - at).astype(np.uint64)
        before = np.where(opens, -_FAR, low[at - 1])
        after = np.where(closes, _FAR, high[np.minimum(end, len(names) - 1)])
        low, high = np.minimum(low[at], before), np.maximum(high[end - 1], after)
        names = np.where(size > 1, mix(names[at] + size * np.uint64(0xA24BAED4963EE407)), names[at])
        first = opens
        # Pairs: a left symbol and a right one after it. Alone, a left one depends on the next, a right one on the last.
        right = (mix(names ^ np.uint64(0x632BE59BD9B4E019 * (r + 1) & (1 << 64) - 1)) & np.uint64(1)).astype(bool)
        n = len(names)
        pair = np.zeros(n, bool)
        pair[:-1] = ~right[:-1] & right[1:] & ~first[1:]
        second = np.zeros(n, bool)
        second[1:] = pair[:-1]
        prev_low = np.where(first, -_FAR, np.append(0, low[:-1]))
        last = np.append(first[1:], True)
        next_high = np.where(last, _FAR, np.append(high[1:], 0))
        alone = ~pair & ~second
        low2 = np.where(alone & right, np.minimum(low, prev_low), low)
        high2 = np.where(alone & ~right, np.maximum(high, next_high), high)
        i = np.flatnonzero(pair)
        names = names.copy()
        high2[i] = high[i + 1]
        names[i] = mix(names[i] * np.uint64(0x9FB21C651E98DF25) + mix(names[i + 1]))
        keep = ~second
        names, low, high, first = names[keep], low2[keep], high2[keep], first[keep]
    return names, low, high


class _Block:
    """A block's words and what follows from them."""

    def __init__(self, table: pa.Table, window: int):
        cache_of("names", forget)
        self.words = [(x.as_py() or "").encode().split() for x in table.column("_text")]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        n = int(sizes.sum())
        self.names = np.empty(n, np.uint64)
        for w, a, b in zip(self.words, self.starts.tolist(), self.ends.tolist(), strict=True):
            self.names[a:b] = word_names(w)
        self.window, self.n = window, n

    def symbols(self, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names of usable symbols, which occur twice here; each symbol's number, range start and end."""
        names, low, high = recompress(self.names, self.starts, rounds)
        usable = (high - low <= self.window) & (low >= 0)
        keys, of, count = np.unique(mix(names[usable]), return_inverse=True, return_counts=True)
        return keys, count > 1, of, low[usable], high[usable]

    def candidates(self, unique: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """First words of the windows that hold no unique symbol's range."""
        n, w = self.n, self.window
        ok = np.zeros(n, bool)
        for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            ok[a : max(a, b - w + 1)] = True
        out = np.zeros(n + 1, np.int64)
        np.add.at(out, np.maximum(high[unique] - w, 0), 1)
        np.add.at(out, low[unique] + 1, -1)
        return np.flatnonzero(ok & (np.cumsum(out[:n]) <= 0))

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows' hashes, check hashes, which occur twice here, and each window's number.

        The first hash is of the words' names, the check of the words' bytes: a collision of names passes only the first.
        """
        if not len(at):
            return np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, bool), at
        one = rolling(self.names, self.window, BASES[0])[at]
        # Only words inside these windows need their bytes' hash.
        inside = self.removed(at)
        line = [w for words in self.words for w in words]
        other = np.zeros(self.n, np.uint64)
        other[inside] = byte_names([line[i] for i in np.flatnonzero(inside).tolist()])
        two = rolling(other, self.window, BASES[1])[at]
        first, of, count, _ = exchange.distinct(one, two)
        return one[first], (two[first] >> np.uint64(32)).astype(np.uint32), count > 1, of

    def removed(self, at: np.ndarray) -> np.ndarray:
        cover = np.zeros(self.n + 1, np.int64)
        cover[at] += 1
        np.add.at(cover, at + self.window, -1)
        return np.cumsum(cover[:-1]) > 0


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS, whole_as_is: bool = False) -> DataFrame:
    """docs without text_col, with n_words long, n_removed long and kept_text string (kept words joined by one space).

    Words are runs of anything but ASCII white space. A word goes if a window of `window` consecutive words
    that covers it also starts anywhere else, in the same document too. Null and empty texts have no words;
    a text shorter than a window keeps all; repeated rows remove each other; columns of docs that bear one
    of the three names are replaced; no rows give no rows. With whole_as_is,
    a text that loses nothing is returned as it was. Windows are equal if 64 bits of a hash of the words' own
    hashes and 32 bits (128 in all inside a block) of another of their bytes are.
    """
    own = [c for c in docs.columns if c not in (*ADDED.names, "_text", text_col)]
    rows = docs.select(*own, F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*(rows.schema[c] for c in own), *ADDED.fields])
    # Written once: blocks keep their rows and names in every pass. Names are places, so that equal blocks count twice.
    kept = exchange.stored(rows, "blocks")
    bits = exchange.bucket_bits(kept)

    def first(table: pa.Table) -> exchange.Question:
        return _Block(table, window).symbols(rounds)[0], None

    def narrowed(table: pa.Table, answers: pa.Table) -> tuple[_Block, np.ndarray]:
        block = _Block(table, window)
        keys, twice, of, low, high = block.symbols(rounds)
        unique = ~(twice | exchange.told(answers, 1, keys, bits))
        return block, block.candidates(unique[of], low, high)

    def second(name: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        block, at = narrowed(table, answers)
        keys, check, _, _ = block.windows(at)
        return pa.Table.from_batches([exchange.asked(name, (keys, check), bits)])

    def last(_: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        block, at = narrowed(table, answers)
        keys, _, twice, of = block.windows(at)
        gone = block.removed(at[(twice | exchange.told(answers, 2, keys, bits))[of]])
        texts, counts = [], []
        for words, a, b in zip(block.words, block.starts.tolist(), block.ends.tolist(), strict=True):
            mine = gone[a:b]
            counts.append(int(mine.sum()))
            texts.append(b" ".join(words if not counts[-1] else [w for w, g in zip(words, mine.tolist(), strict=True) if not g]).decode())
        if whole_as_is:
            texts = [t if n else x.as_py() for t, n, x in zip(texts, counts, table.column("_text"), strict=True)]
        more = [pa.array([len(w) for w in block.words], pa.int64()), pa.array(counts, pa.int64()), pa.array(texts, pa.string())]
        return pa.table([*(table.column(c) for c in own), *more], names=[*own, *ADDED.names])

    symbols = exchange.answer(exchange.ask(kept, first, bits), 1)
    windows = exchange.answer(exchange.with_answers(kept, symbols, second, exchange.ASKS), 2)
    return exchange.with_answers(kept, symbols.unionByName(windows), last, schema)


def repeats_digest(done: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """What the operator returns, by a table of all windows; for tests."""
    words = [(t or "").encode().split() for t in texts]
    seen: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out
