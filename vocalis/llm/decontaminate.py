"""Benchmark decontamination with one Aho-Corasick automaton over word windows.

Benchmark words become single characters, so the automaton has a node per word and a document is
scanned once as a string of one character per word; the index of a match is its word's number, which
maps to byte offsets of the original text because normalising never changes a byte's place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalis.llm.shared import cache_of, written

WINDOW = 10
#: Benchmark bytes that one broadcast automaton may hold; a larger benchmark is scanned for in parts.
MAX_PATTERN_BYTES = 4 << 20
_KEEP = re.compile(rb"[0-9a-z\x80-\xff]")
_NORMAL = bytes(c if _KEEP.match(bytes([c])) else 32 for c in bytes(range(256)).lower())
_WORD = re.compile(rb"[^ ]+")

ADDED = T.StructType().add("n_words", "long").add("n_hit", "long").add("items", T.ArrayType(T.StringType())).add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long")))


def normal(text: str | None) -> bytes:
    """UTF-8 bytes in place: A-Z lowered, every ASCII byte but letters and digits a space."""
    return (text or "").encode().translate(_NORMAL)


def slices(line: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A normalised text in slices of about `size` bytes that end between words."""
    at = 0
    while at < len(line):
        end = line.find(b" ", at + size)
        end = len(line) if end < 0 else end
        yield line[at:end] if at or end < len(line) else line
        at = end


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> str:
        return "\0"


Runs = list[list[int]]


def merged(runs: Runs) -> Runs:
    """Runs [first, end) in any order as maximal ones, those that touch joined."""
    out: Runs = []
    for a, b in sorted(runs):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


class Matcher:
    """The automaton of some benchmark items, given as normalised texts."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary, patterns = _Vocabulary(), {}
        for item, text in items:
            words = text.split()
            for w in words:
                if w not in self.vocabulary:
                    n = len(self.vocabulary) + 1
                    self.vocabulary[w] = chr(n + 0x800 if n >= 0xD800 else n)
            line = "".join(map(self.vocabulary.__getitem__, words))
            for i in range(max(1, len(line) - window + 1) if line else 0):
                patterns.setdefault(line[i : i + window], set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for p, own in patterns.items():
            self.automaton.add_word(p, (len(p), own))
        self.size = len(patterns)
        if patterns:
            self.automaton.make_automaton()

    def find(self, line: bytes) -> tuple[int, Runs, set[str]]:
        """Words of a normalised text, maximal runs of hit words as [first, end), and the items found."""
        runs: Runs = []
        items: set[str] = set()
        n_words, scan = 0, None
        for part in slices(line):
            words = part.split()
            n_words += len(words)
            if not self.size or not words:
                continue
            symbols = "".join(map(self.vocabulary.__getitem__, words))
            if scan is None:
                scan = self.automaton.iter(symbols)
            else:
                scan.set(symbols)  # goes on where the slice before ended
            for end, (n, own) in scan:
                items |= own
                start = end - n + 1
                while runs and runs[-1][1] >= start:  # patterns of several lengths may end out of order of start
                    start = min(start, runs.pop()[0])
                runs.append([start, end + 1])
        return n_words, runs, items


def _spans(line: bytes, runs: Runs) -> list[dict[str, int]]:
    """Byte offsets of runs of words."""
    out: list[dict[str, int]] = []
    todo = iter(runs)
    run = next(todo, None)
    for i, m in enumerate(_WORD.finditer(line)):
        if run is None:
            break
        if i == run[0]:
            out.append({"start": m.start()})
        if i == run[1] - 1:
            out[-1]["end"] = m.end()
            run = next(todo, None)
    return out


#: The matcher a worker used last, by the digest of its items.
_MATCHERS: dict[tuple[str, int], Matcher] = {}
_RUNS = T.ArrayType(T.ArrayType(T.LongType()))
_FOUND = T.StructType().add("n_words", "long").add("items", T.ArrayType(T.StringType())).add("runs", _RUNS)


def _matcher(shared, digest: str, window: int) -> Matcher:
    cache_of("matchers", _MATCHERS.clear)
    if (digest, window) not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[digest, window] = Matcher(shared.value, window)
    return _MATCHERS[digest, window]


def _scan(batches: Iterator[pa.RecordBatch], shared, digest: str, window: int, own: list[str], text_col: str, before: bool, last: bool, clean_only: bool) -> Iterator[pa.RecordBatch]:
    matcher = _matcher(shared, digest, window)
    for batch in batches:
        earlier = batch.column("_found").to_pylist() if before else None
        n_words, n_hit, names, spans, all_runs, rows = [], [], [], [], [], []
        for k, text in enumerate(batch.column(text_col)):
            line = normal(text.as_py())
            n, runs, items = matcher.find(line)
            if before and earlier[k]["runs"]:
                items |= set(earlier[k]["items"])
                runs = merged(runs + earlier[k]["runs"])
            if last and clean_only and runs:
                continue
            rows.append(k)
            n_words.append(n)
            n_hit.append(sum(b - a for a, b in runs))
            names.append(sorted(items))
            all_runs.append(runs)
            if last:
                spans.append(_spans(line, runs) if runs else [])
        kept = batch.select([c for c in batch.schema.names if c != "_found" and (not last or c in own)])
        kept = kept if len(rows) == batch.num_rows else kept.take(pa.array(rows, pa.int64()))
        listed = pa.array(names, pa.list_(pa.string()))
        if last:
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            more = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), listed, pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *more], [*kept.schema.names, *ADDED.names])
        else:
            found = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), listed, pa.array(all_runs, pa.list_(pa.list_(pa.int64())))], _FOUND.names)
            yield pa.RecordBatch.from_arrays([*kept.columns, found], [*kept.schema.names, "_found"])


def _cut(batches: Iterator[pa.RecordBatch], window: int, size: int) -> Iterator[pa.RecordBatch]:
    """Benchmark items as normalised pieces of about `size` bytes that share window - 1 words, so that no window is lost."""
    for batch in batches:
        items, lines = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words: list[bytes] = []
            whole = True  # no piece yet: fewer words than a window are one
            for part in slices(normal(text.as_py()), size):
                words += part.split()
                if len(words) >= window:
                    items.append(item)
                    lines.append(b" ".join(words))
                    words, whole = words[len(words) - window + 1 :], False
            if whole and words:
                items.append(item)
                lines.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(lines, pa.binary())], ["item", "line"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_pattern_bytes: int = MAX_PATTERN_BYTES, keep_text: bool = False, clean_only: bool = False) -> DataFrame:
    """docs (without text_col unless keep_text) with n_words long, n_hit long, items array<string>, spans array<struct<start,end>>.

    A window is `window` consecutive words of an item, or all words of a shorter one. A document word
    inside any occurrence of a window is hit; spans are its maximal runs as byte offsets of the UTF-8
    text; items are the ids with an occurring window, sorted as strings. Null or wordless texts on
    either side hit nothing; a null item id is the string "null"; repeated items count once; long texts
    are scanned in slices, the automaton's state going on; columns of docs that bear one of the four names
    are replaced; no documents give no rows, no items no hits. clean_only returns the rows without a hit
    alone. One automaton holds a benchmark of up to max_pattern_bytes. A larger one, its items cut where
    one alone is larger, is scanned for in parts of about that size one after another, what is found so
    far written to the shared folder between them, so that neither the driver nor a worker holds more
    than a part.
    """
    spark = docs.sparkSession
    size = max(max_pattern_bytes // 4, 16 * window)
    texts = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    pieces = texts.mapInArrow(lambda b: _cut(b, window, size), "item string, line binary").distinct()
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-2 * total // max_pattern_bytes) if total > max_pattern_bytes else 1
    own = [c for c in docs.columns if c not in (*ADDED.names, "_text", "_found") and (keep_text or c != text_col)]
    source = text_col if text_col in own and dict(docs.dtypes)[text_col] == "string" else "_text"
    out = docs.select(*own) if source in own else docs.select(*own, F.col(text_col).cast("string").alias("_text"))
    between = T.StructType([*out.schema.fields, T.StructField("_found", _FOUND)])
    schema = T.StructType([*(out.schema[c] for c in own), *ADDED.fields])
    for k in range(parts):
        mine = pieces if parts == 1 else pieces.where(F.pmod(F.xxhash64("item", "line"), F.lit(parts)) == k)
        items = sorted((r[0], bytes(r[1])) for r in mine.toLocalIterator())
        digest = hashlib.sha256(repr(items).encode()).hexdigest()
        shared, last = spark.sparkContext.broadcast(items), k == parts - 1
        out = out.mapInArrow(lambda b, s=shared, d=digest, m=k > 0, z=last: _scan(b, s, d, window, own, source, m, z, clean_only), schema if last else between)
        out = out if last else written(out, "found")
    return out


def contamination_digest(found: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    ids = F.col("items")
    return found.select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
