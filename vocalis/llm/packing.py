"""Vector bin packing of examples into fixed-length training sequences.

Bins have three limits at once: tokens, segments and loss-bearing tokens. Every input partition is
packed by itself in windows of bounded size, so packing needs no shuffle and no task holds more than
one window of token ids; what one partition leaves under-full is filled by cutting.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.llm.tokens import default_tokenizer, encoder

CAPACITY = 4096
MAX_SEGMENTS = 256
#: Items and tokens of one packing window.
WINDOW_ITEMS, WINDOW_TOKENS = 2048, 1 << 22
#: Bins with no more free tokens than this are closed at the end of a window; others go to the next.
CLOSE_GAP = 64
#: Share of any limit from which a bin of whole examples is closed at the end of a window.
CLOSE_SHARE = 0.98
END_OF_DOCUMENT = 2

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def dot_product_bins(sizes: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Fill one bin after another with the item of the largest dot product of demand and free room.

    sizes: items by dimensions, each item within the limits. Ties go to the earlier item. Returns the
    item numbers of each bin; every item is in exactly one.
    """
    demand = sizes / limits
    left = np.arange(len(sizes))
    bins = []
    while len(left):
        room, own = np.ones(len(limits)), []
        mine = demand[left]
        alive = np.ones(len(left), bool)
        while True:
            fits = alive & (mine <= room + 1e-12).all(1)
            if not fits.any():
                break
            k = int(np.argmax(np.where(fits, mine @ room, -1.0)))
            own.append(int(left[k]))
            alive[k] = False
            room = room - mine[k]
        bins.append(own)
        left = left[alive]
    return bins


class Packer:
    """Packs one partition's documents; emits (key, start, length, sequence, offset)."""

    def __init__(self, first_sequence: int, capacity: int, max_segments: int, max_loss: int):
        self.capacity, self.max_segments = capacity, max_segments
        self.max_piece = min(capacity, max_loss)
        self.limits = np.array([capacity, max_segments, max_loss], float)
        self.sequence = first_sequence
        self.items: list[tuple[int, int, int]] = []
        self.out: list[tuple[int, int, int, int, int]] = []

    def emit(self, pieces: list[tuple[int, int, int]]) -> None:
        at = 0
        for key, start, length in pieces:
            self.out.append((key, start, length, self.sequence, at))
            at += length
        self.sequence += 1

    def add(self, key: int, tokens: int) -> None:
        start = 0
        while tokens - start > self.max_piece:
            self.emit([(key, start, self.max_piece)])
            start += self.max_piece
        if tokens - start == self.max_piece == self.capacity:
            self.emit([(key, start, tokens - start)])
        else:
            self.items.append((key, start, tokens - start))

    def bins(self) -> list[list[tuple[int, int, int]]]:
        # Within a window, larger items come first so that ties are settled alike for any input order of equal sizes.
        items = sorted(self.items, key=lambda x: (-x[2], x[0], x[1]))
        n = np.array([[x[2], 1, x[2]] for x in items], float).reshape(-1, 3)
        return [[items[i] for i in own] for own in dot_product_bins(n, self.limits)]

    def window(self) -> None:
        keep = []
        for own in self.bins():
            if self.capacity - sum(x[2] for x in own) <= CLOSE_GAP:
                self.emit(own)
            else:
                keep += own
        # A window that closes too few bins would grow without bound; then its fullest bins close as they are.
        self.items = keep
        if len(keep) > WINDOW_ITEMS // 2:
            self.finish()

    def finish(self) -> None:
        """Close every bin: cut pieces of the emptiest bins into the gaps of the fullest, and the rest at powers of two."""
        bins = sorted(self.bins(), key=lambda own: sum(x[2] for x in own))
        pool = []
        while bins:
            own = bins.pop()
            gap = self.max_piece - sum(x[2] for x in own)
            while gap > 0 and len(own) < self.max_segments and (pool or bins):
                if not pool:
                    pool = bins.pop(0)
                key, start, length = pool.pop()
                take = min(gap, length)
                own.append((key, start, take))
                gap -= take
                if take < length:
                    pool.append((key, start + take, length - take))
            if gap <= 0 or len(own) >= self.max_segments:
                self.emit(own)
            else:
                pool = own
                break
        while pool:
            total, own = sum(x[2] for x in pool), []
            need = 1 << (min(total, self.max_piece).bit_length() - 1)
            while need:
                key, start, length = pool.pop()
                take = min(need, length)
                own.append((key, start, take))
                need -= take
                if take < length:
                    pool.append((key, start + take, length - take))
                if len(own) == self.max_segments:
                    break
            self.emit(own)
        self.items = []


def _packed(batches: Iterator[pa.RecordBatch], path: str, limits: tuple[int, int, int], keep_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    task = TaskContext.get()
    packer = Packer((task.partitionId() if task else 0) << 33, *limits)
    eod = np.array([END_OF_DOCUMENT], "<u4").tobytes()
    held: dict[int, tuple[object, bytes]] = {}
    n = tokens = key = 0

    def rows() -> pa.RecordBatch:
        got, packer.out = packer.out, []
        ids = [memoryview(held[k][1])[4 * s : 4 * (s + m)] for k, s, m, _, _ in got]
        cols = [[held[x[0]][0] for x in got], [x[1] for x in got], [x[2] for x in got], [zlib.crc32(x) for x in ids], [len(held[x[0]][1]) // 4 for x in got], [x[3] for x in got], [x[4] for x in got]]
        arrays = [pa.array(c, pa.int64()) for c in cols]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if keep_ids:
            arrays.append(pa.array([np.frombuffer(x, "<u4").astype("i4") for x in ids], pa.list_(pa.int32())))
            names.append("ids")
        open_keys = {x[0] for x in packer.items}
        for k in [k for k in held if k not in open_keys]:
            del held[k]
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = enc.ids(text.as_py()) + eod
            held[key] = (doc, ids)
            packer.add(key, len(ids) // 4)
            key, n, tokens = key + 1, n + 1, tokens + len(ids) // 4
            if n >= WINDOW_ITEMS or tokens >= WINDOW_TOKENS:
                packer.window()
                n = tokens = 0
                yield rows()
    packer.finish()
    if packer.out:
        yield rows()


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most `capacity` tokens.

    A document is its token ids and then the end id 2; every one of these tokens bears loss. Each id
    is in exactly one piece, pieces of a sequence follow each other from offset 0 without a gap, and no
    sequence holds over max_segments pieces or max_loss (default: capacity) loss-bearing tokens. A
    sequence shorter than capacity is padded to it, but for lengths that are a power of two. Null and
    empty texts are documents of the end id alone; a null doc_id stays null; repeated rows are packed
    once each; other columns, whatever their names, are not read; no rows give no rows.
    keep_ids adds `ids array<int>`.
    """
    path = tokenizer or default_tokenizer()
    limits = (capacity, max_segments, max_loss or capacity)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(lambda batches: _packed(batches, path, limits, keep_ids), PIECES + ", ids array<int>" * keep_ids)


def _examples(batches: Iterator[pa.RecordBatch], limits: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 33
    cap = np.array(limits, float)
    ids: list[object] = []
    need = np.empty((0, 3))

    def close(last: bool) -> pa.RecordBatch:
        """Bins that are full in some measure, or all; the others' examples stay for the next window."""
        nonlocal ids, need, number
        bins = dot_product_bins(need, cap)
        filled = [float((need[own].sum(0) / cap).max()) for own in bins]
        # Few open bins are kept, so that a window's work is bounded.
        if last or sum(len(own) for own, f in zip(bins, filled, strict=True) if f < CLOSE_SHARE) > WINDOW_ITEMS // 2:
            filled = [1.0] * len(bins)
        out, keep = [], []
        for own, f in zip(bins, filled, strict=True):
            if f >= CLOSE_SHARE:
                out += [(ids[i], number) for i in own]
                number += 1
            else:
                keep += own
        keep.sort()
        ids, need = [ids[i] for i in keep], need[keep]
        return rows(out)

    def rows(out: list[tuple[object, int | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64())], ["example_id", "bin_id"])

    for batch in batches:
        mine = np.array([[max(0, x or 0) for x in batch.column(i).to_pylist()] for i in (1, 2, 3)], float).T.reshape(-1, 3)
        fits = (mine <= cap).all(1)
        names = batch.column(0).to_pylist()
        if not fits.all():
            yield rows([(names[i], None) for i in np.flatnonzero(~fits)])
        for a in range(0, len(mine), WINDOW_ITEMS):
            take = np.flatnonzero(fits[a : a + WINDOW_ITEMS]) + a
            ids += [names[i] for i in take]
            need = np.concatenate([need, mine[take]])
            if len(ids) >= WINDOW_ITEMS:
                yield close(False)
    if ids:
        yield close(True)


def pack_examples(examples: DataFrame, id_col: str, tokens_col: str, segments_col: str, loss_col: str, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int = CAPACITY) -> DataFrame:
    """Whole instruction examples to bins: example_id long, bin_id long.

    The same heuristic without cutting, by windows of a partition: bins that no measure fills to CLOSE_SHARE go
    on into the next window. Null and negative sizes count as 0; an example over a limit gets a null bin_id;
    repeated rows are placed once each; other columns are not read; no rows give no rows.
    """
    rows = examples.select(F.col(id_col).cast("long"), *(F.col(c).cast("long") for c in (tokens_col, segments_col, loss_col)))
    return rows.mapInArrow(lambda b: _examples(b, (capacity, max_segments, max_loss)), "example_id long, bin_id long")
