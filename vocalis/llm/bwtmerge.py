"""Substring deduplication on bytes by merging the suffix intervals of shards.

Documents in order of their ids are cut into shards. An interval holds all suffixes that begin with the same
bytes; merging the shards' suffix orders only needs to know which intervals span several suffixes, so the
interleave is refined in rounds over ever longer common prefixes, and an interval that holds one suffix is
settled and leaves: (1) 32 bytes, at sampled suffixes alone; (2) at those left, all bytes that the windows
before the next sampled suffix cover: an equal stretch earlier settles these windows at once, and where an
interval's stretches are all equal its first one is settled too; (3) the 100 bytes of every window still
open. Suffixes are never sorted globally: an interval is named by the hash of its prefix, and shards send each
distinct name once, with their place in the order, to learn whether an earlier shard has it.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalis.llm import exchange
from vocalis.llm.exchange import mix
from vocalis.llm.recompress import BASES, CHECK_SALT, Prefixes, powers
from vocalis.llm.shared import cache_of

WINDOW = 100
#: Bytes of the first round's prefixes, of the context that makes a suffix a sampled one, and one in how many is.
PREFIX, CONTEXT, SAMPLE = 32, 8, 16
SHARD_BYTES = 1 << 20

ADDED = T.StructType().add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")

class _Shard:
    def __init__(self, table: pa.Table, window: int):
        cache_of("powers", powers.cache_clear)
        self.texts = [(x.as_py() or "").encode() for x in table.column("_text")]
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        sizes = np.array([len(x) for x in self.texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.window = window
        self.one = Prefixes(self.data, BASES[0])

    @cached_property
    def two(self) -> Prefixes:
        return Prefixes(self.data, BASES[1], CHECK_SALT)

    def _starts(self, length: int) -> np.ndarray:
        """Which bytes begin a string of that length in their document."""
        n = len(self.data)
        step = np.zeros(n + 1, np.int64)
        fits = self.ends - length + 1 > self.starts
        np.add.at(step, self.starts[fits], 1)
        np.add.at(step, (self.ends - length + 1)[fits], -1)
        return np.cumsum(step[:n]) > 0

    def sampled(self) -> np.ndarray:
        """Suffixes that their first bytes choose, wherever they occur."""
        at = np.flatnonzero(self._starts(PREFIX))
        if not len(at):
            return at
        context = self.one.at(at, CONTEXT)
        return at[context % np.uint64(SAMPLE) == 0]

    @staticmethod
    def named(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names, first place of each, number of each place's name, count of each."""
        return np.unique(names, return_index=True, return_inverse=True, return_counts=True)

    def open_windows(self, unique_at: np.ndarray) -> np.ndarray:
        """Which bytes begin a window that holds no single suffix's prefix."""
        n = len(self.data)
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, np.maximum(unique_at + PREFIX - self.window, 0), 1)
        np.add.at(step, unique_at + 1, -1)
        return self._starts(self.window) & (np.cumsum(step[:n]) <= 0)

    def reaches(self, sampled: np.ndarray, is_open: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each sampled suffix with open windows before it: the suffix, first start of these windows, whether all are open.

        A window belongs to the next sampled suffix behind its start if it holds that one's prefix; the same
        window elsewhere belongs to an equal suffix.
        """
        if not len(sampled):
            return sampled, sampled, np.empty(0, bool)
        doc = np.searchsorted(self.ends, sampled, "right")
        first = np.maximum(self.starts[doc], sampled - (self.window - PREFIX))
        first[1:] = np.maximum(first[1:], np.where(doc[1:] == doc[:-1], sampled[:-1], 0))
        total = np.append(0, np.cumsum(is_open))
        n = total[sampled] - total[first]
        some = n > 0
        return sampled[some], first[some], (n == sampled - first)[some]

    def pairs(self, suffix: np.ndarray, first: np.ndarray, whole: np.ndarray, name: int) -> tuple[np.ndarray, np.ndarray]:
        """The prefix's name, and that of all bytes the suffix's windows cover; of windows not all open, one like no other."""
        size = np.where(whole, suffix - first + self.window - 1, 0)
        covered = self.two.at(first, size) + mix(size.astype(np.uint64))
        single = mix(mix(suffix.astype(np.uint64) + np.uint64(1)) + np.uint64(name))
        return self.one.at(suffix, PREFIX), np.where(whole, covered, single)

    def check(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return self.two.at(at, length)


def remove_later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without text_col, with n_bytes, n_removed, n_spans (all long) and kept binary.

    A byte goes if a string of `window` bytes that covers it also starts earlier: in a document of smaller
    id, or in the same one before. n_spans counts maximal removed runs; kept is what remains, which may cut
    a character. Matches never cross documents; null and empty texts have no bytes; documents of null id
    come first, and rows of one id follow each other in order of their texts, so of repeated rows the first
    stays; columns of docs that bear one of the four names are replaced; no rows give no rows. window is at
    least 64. Strings are equal if 64 bits of one hash and 32 (64 inside
    a shard) of another are; both are of the bytes.
    """
    if window < 2 * PREFIX:
        raise ValueError(f"window is {window}, {2 * PREFIX} is the least")
    own = [c for c in docs.columns if c not in (*ADDED.names, "_text", text_col)]
    rows = docs.select(*own, F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*(rows.schema[c] for c in own), *ADDED.fields])
    in_order = rows.repartitionByRange(F.col(id_col).asc_nulls_first()).sortWithinPartitions(F.col(id_col).asc_nulls_first(), "_text")
    shards = exchange.stored(in_order, "shards", SHARD_BYTES)
    bits = exchange.bucket_bits(shards)

    def first(table: pa.Table) -> exchange.Question:
        s = _Shard(table, window)
        return s.named(s.one.at(s.sampled(), PREFIX))[0], None

    def round_one(table: pa.Table, answers: pa.Table) -> tuple[_Shard, np.ndarray, np.ndarray]:
        s = _Shard(table, window)
        sampled = s.sampled()
        keys, _, of, count = s.named(s.one.at(sampled, PREFIX))
        shared = (count > 1) | exchange.told(answers, 1, keys, bits)
        return s, sampled, s.open_windows(sampled[~shared[of]])

    def round_two(name: int, table: pa.Table, answers: pa.Table):
        s, sampled, is_open = round_one(table, answers)
        suffix, first, whole = s.reaches(sampled, is_open)
        keys, values = s.pairs(suffix, first, whole, name)
        order = np.lexsort((suffix, values, keys))
        k, v = keys[order], values[order]
        new = np.append(True, (k[1:] != k[:-1]) | (v[1:] != v[:-1])) if len(k) else np.empty(0, bool)
        return s, is_open, suffix, first, order, new, (k[new], v[new])

    def second(name: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        return pa.Table.from_batches([exchange.asked(name, round_two(name, table, answers)[-1], bits)])

    def round_three(name: int, table: pa.Table, answers: pa.Table) -> tuple[_Shard, np.ndarray, np.ndarray]:
        s, is_open, suffix, first, order, new, (keys, _) = round_two(name, table, answers)
        got = exchange.told(answers, 2, keys, bits, each=2)[np.cumsum(new) - 1] if len(keys) else np.empty((0, 2), bool)
        # In document order, an equal stretch before this one in the shard counts as well as one in an earlier shard.
        again, other = np.empty(len(order), bool), np.empty(len(order), bool)
        again[order], other[order] = got[:, 0] | ~new, got[:, 1]
        step = np.zeros((2, len(s.data) + 1), np.int64)
        np.add.at(step[0], first[again], 1)
        np.add.at(step[0], suffix[again], -1)
        # All windows of an interval are alike, and this is the first: nothing earlier has them.
        alike = ~again & ~other
        np.add.at(step[1], first[alike], 1)
        np.add.at(step[1], suffix[alike], -1)
        settled, sole = np.cumsum(step[:, :-1], 1) > 0
        return s, settled, np.flatnonzero(is_open & ~settled & ~sole)

    def third(name: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        s, _, left = round_three(name, table, answers)
        keys, check = s.one.at(left, window), s.check(left, window)
        at = exchange.distinct(keys, check)[0]
        return pa.Table.from_batches([exchange.asked(name, (keys[at], (check[at] >> np.uint64(32)).astype(np.uint32)), bits)])

    def last(name: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        s, settled, left = round_three(name, table, answers)
        keys = s.one.at(left, window)
        at, of, _, earliest = exchange.distinct(keys, s.check(left, window))
        again = exchange.told(answers, 3, keys[at], bits)[of] | ~earliest
        step = np.zeros(len(s.data) + 1, np.int64)
        starts = np.append(np.flatnonzero(settled), left[again])
        np.add.at(step, starts, 1)
        np.add.at(step, starts + window, -1)
        gone = np.cumsum(step[:-1]) > 0
        out = []
        for text, a, b in zip(s.texts, s.starts.tolist(), s.ends.tolist(), strict=True):
            mine = gone[a:b]
            n = int(mine.sum())
            spans = int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()) if n else 0
            out.append((b - a, n, spans, s.data[a:b][~mine].tobytes() if n else text))
        columns = list(zip(*out, strict=True)) or [()] * 4
        more = [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())]
        return pa.table([*(table.column(c) for c in own), *more], names=[*own, *ADDED.names])

    one = exchange.answer(exchange.ask(shards, first, bits), 1)
    two = one.unionByName(exchange.answer_pairs(exchange.with_answers(shards, one, second, exchange.ASKS), 2))
    three = two.unionByName(exchange.answer(exchange.with_answers(shards, two, third, exchange.ASKS), 3, earlier=True))
    return exchange.with_answers(shards, three, last, schema)


def copies_digest(done: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """What the operator returns for documents in order of their ids, by a set of all strings; for tests."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            k = b[i : i + window]
            if k in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(k)
        runs = bytes(gone).split(b"\0")
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(1 for r in runs if r), hashlib.sha256(kept).hexdigest()))
    return out
