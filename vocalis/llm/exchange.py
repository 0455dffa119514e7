"""Blocks of documents that ask all other blocks about hashes, and get one bit for each.

A block is some documents as one compressed Arrow table. Its questions are the distinct 64-bit hashes it
holds, sorted and dealt by their leading bits to buckets; a bucket sees every block's sorted hashes and
answers with a bitmap in the same order. What moves is 8 to 12 bytes a distinct hash and block, and one bit
back: a hash that a third of all documents hold is one entry a block, so no bucket outgrows the others.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vocalis.llm.shared import bucketed, input_bytes

BLOCK_BYTES = 2 << 20
#: Bytes of compressed blocks for each bucket: at most, so that it fits in a task, and at least, so that rows between blocks and buckets stay few.
BUCKET_INPUT, LEAST_INPUT, BUCKETS_A_PARTITION = 32 << 20, 1 << 20, 2

#: Input from which blocks and buckets grow, with its square root and up to so many times: rows between them are blocks times buckets.
GROWS_FROM, MOST_GROWTH = 1 << 40, 4

BLOCKS = "block long, data binary"
ASKS = "bucket int, block long, keys binary, extra binary"
ANSWERS = "block long, kind int, bucket int, bits binary"


def encode(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def decode(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _blocks(batches: Iterator[pa.RecordBatch], size: int, ordered: bool) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    held: list[pa.RecordBatch] = []
    total = 0

    def row() -> pa.RecordBatch:
        nonlocal number, held, total
        data = encode(pa.Table.from_batches(held))
        number += 1
        name = number if ordered else int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)
        held, total = [], 0
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([data], pa.binary())], ["block", "data"])

    for batch in batches:
        per = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for i in range(0, batch.num_rows, per):
            part = batch.slice(i, per)
            held.append(part)
            total += part.nbytes
            if total >= size:
                yield row()
    if held:
        yield row()


def blocks(docs: DataFrame, size: int = BLOCK_BYTES, ordered: bool = False) -> DataFrame:
    """Rows of docs, as they lie in the partitions, in blocks of about `size` bytes.

    A block's name is the hash of its rows, or with `ordered` its place in docs, whose partitions and
    rows must then be in a lasting order.
    """
    return docs.mapInArrow(lambda b: _blocks(b, size, ordered), BLOCKS)


def growth(input_size: int) -> float:
    """How many times as large blocks and buckets are as for a small input; 1 where the size is not known."""
    return min(MOST_GROWTH, max(1.0, math.sqrt(input_size / GROWS_FROM))) if input_size < 1 << 60 else 1.0


def stored(docs: DataFrame, name: str, size: int = BLOCK_BYTES) -> DataFrame:
    """blocks() of docs in a lasting order, written by block: in every later pass blocks stay where they are and answers come to them."""
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return bucketed(blocks(docs, int(size * growth(known)), ordered=True), name, "block")


def bucket_bits(kept: DataFrame) -> int:
    """Leading bits that name a bucket, from the size of the written blocks and the number of shuffle partitions."""
    parts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(kept)
    n = max(int(size / (BUCKET_INPUT * growth(size))), min(BUCKETS_A_PARTITION * parts, size // LEAST_INPUT), 1)
    return min(24, max(1, (n - 1).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(keys: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of hashes with a second hash: one place of each distinct pair in order, the pair of each place, places of each pair, and whether each is the earliest."""
    if not len(keys):
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, bool)
    order = np.lexsort((check, keys))
    new = np.append(True, (keys[order][1:] != keys[order][:-1]) | (check[order][1:] != check[order][:-1]))
    of = np.empty(len(keys), np.int64)
    of[order] = np.cumsum(new) - 1
    # lexsort is stable: the first of a pair in order is its first place.
    first = order[new]
    earliest = np.zeros(len(keys), bool)
    earliest[first] = True
    return first, of, np.bincount(of), earliest


Question = tuple[np.ndarray, np.ndarray | None]


def ask(frame: DataFrame, fn: Callable[[pa.Table], Question], bits: int, narrow: bool = False) -> DataFrame:
    """The questions of each block: fn gives distinct sorted uint64 hashes and, in their order, 4-byte check hashes or None.

    narrow sends only the 32 bits after those that name the bucket; equal answers for colliding hashes must do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                yield asked(block, fn(decode(data.as_py())), bits, narrow)

    return frame.mapInArrow(run, ASKS)


def asked(block: int, question: Question, bits: int, narrow: bool = False) -> pa.RecordBatch:
    keys, extra = question
    which, first = np.unique(keys >> np.uint64(64 - bits), return_index=True)
    ends = np.append(first[1:], len(keys)) if len(keys) else first
    cut = [(int(a), int(b)) for a, b in zip(first, ends, strict=True)]
    if narrow:
        keys = (keys << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
    return pa.RecordBatch.from_arrays(
        [pa.array(which.astype("i4")), pa.array([block] * len(cut), pa.int64()), pa.array([keys[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([b"" if extra is None else extra[a:b].tobytes() for a, b in cut], pa.binary())],
        ["bucket", "block", "keys", "extra"],
    )


def answer(asks: DataFrame, kind: int, earlier: bool = False, narrow: bool = False) -> DataFrame:
    """For each asked hash one bit: another block asked for it, or with `earlier` a block of a smaller name did."""

    def run(table: pa.Table) -> pa.Table:
        owners = table.column("block").to_pylist()
        parts = [np.frombuffer(x.as_py(), np.uint32 if narrow else np.uint64) for x in table.column("keys")]
        checks = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("extra")]
        sizes = [len(x) for x in parts]
        keys = np.concatenate(parts)
        names = np.unique(np.array(owners, np.int64))
        of = np.repeat(np.searchsorted(names, owners), sizes)
        has = sum(map(len, checks)) == len(keys)
        if has:
            check = np.concatenate(checks)
            order = np.lexsort((of, check, keys)) if earlier else np.lexsort((check, keys))
            new = np.append(True, (keys[order][1:] != keys[order][:-1]) | (check[order][1:] != check[order][:-1]))
        else:
            order = np.lexsort((of, keys)) if earlier else np.argsort(keys, kind="stable")
            new = np.append(True, keys[order][1:] != keys[order][:-1])
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        low = np.minimum.reduceat(of[order], starts)
        if earlier:
            yes = low[group] < of[order]
        else:
            high = np.maximum.reduceat(of[order], starts)
            yes = (low != high)[group]
        bit = np.empty(len(keys), bool)
        bit[order] = yes
        at = np.cumsum([0, *sizes])
        bits = [np.packbits(bit[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        n = len(bits)
        return pa.table([pa.array(owners, pa.int64()), pa.array([kind] * n, pa.int32()), table.column("bucket").cast(pa.int32()), pa.array(bits, pa.binary())], names=["block", "kind", "bucket", "bits"])

    return asks.groupBy("bucket").applyInArrow(run, ANSWERS)


#: Bits of a class of answer_counts, and the classes of an octave of counts.
CLASS_BITS, CLASSES_AN_OCTAVE = 4, 2


def answer_counts(asks: DataFrame, kind: int, narrow: bool = False) -> DataFrame:
    """For each asked hash the class of the sum of its counts over all blocks: 0 for one, then more for more, up to the largest class.

    The counts are the `extra` of the question, a byte each.
    """

    def run(table: pa.Table) -> pa.Table:
        owners = table.column("block").to_pylist()
        parts = [np.frombuffer(x.as_py(), np.uint32 if narrow else np.uint64) for x in table.column("keys")]
        keys = np.concatenate(parts)
        counts = np.frombuffer(b"".join(table.column("extra").to_pylist()), np.uint8)
        order = np.argsort(keys, kind="stable")
        new = np.append(True, keys[order][1:] != keys[order][:-1])
        total = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new))
        found = np.minimum(np.rint(CLASSES_AN_OCTAVE * np.log2(np.maximum(total, 1))), (1 << CLASS_BITS) - 1).astype(np.uint8)
        each = np.empty(len(keys), np.uint8)
        each[order] = found[np.cumsum(new) - 1]
        at = np.cumsum([0, *map(len, parts)])
        bits = [np.packbits(np.unpackbits(each[a:b, None], axis=1)[:, -CLASS_BITS:].ravel()).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        n = len(bits)
        return pa.table([pa.array(owners, pa.int64()), pa.array([kind] * n, pa.int32()), table.column("bucket").cast(pa.int32()), pa.array(bits, pa.binary())], names=["block", "kind", "bucket", "bits"])

    return asks.groupBy("bucket").applyInArrow(run, ANSWERS)


def classes_told(answers: pa.Table, kind: int, keys: np.ndarray, bits: int) -> np.ndarray:
    """The classes of answer_counts for a block's sorted hashes."""
    return told(answers, kind, keys, bits, each=CLASS_BITS) @ (1 << np.arange(CLASS_BITS)[::-1])


def answer_pairs(asks: DataFrame, kind: int) -> DataFrame:
    """For each asked (key, value), sorted so in its block, two bits: a block of a smaller name has it; the key has other values anywhere.

    The values are the `extra` of the question, 8 bytes each; pairs are distinct in a block, keys need not be.
    """

    def run(table: pa.Table) -> pa.Table:
        owners = table.column("block").to_pylist()
        parts = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")]
        sizes = [len(x) for x in parts]
        keys, values = np.concatenate(parts), np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("extra")])
        names = np.unique(np.array(owners, np.int64))
        of = np.repeat(np.searchsorted(names, owners), sizes)
        order = np.lexsort((of, values, keys))
        k, v = keys[order], values[order]
        new_key = np.append(True, k[1:] != k[:-1])
        new = new_key | np.append(True, v[1:] != v[:-1])
        low = of[order][np.flatnonzero(new)]
        earlier = low[np.cumsum(new) - 1] < of[order]
        other = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key))[np.cumsum(new_key) - 1] > 1
        bit = np.empty((len(keys), 2), bool)
        bit[order, 0], bit[order, 1] = earlier, other
        at = np.cumsum([0, *sizes])
        bits = [np.packbits(bit[a:b].ravel()).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        n = len(bits)
        return pa.table([pa.array(owners, pa.int64()), pa.array([kind] * n, pa.int32()), table.column("bucket").cast(pa.int32()), pa.array(bits, pa.binary())], names=["block", "kind", "bucket", "bits"])

    return asks.groupBy("bucket").applyInArrow(run, ANSWERS)


def told(answers: pa.Table, kind: int, keys: np.ndarray, bits: int, each: int = 1) -> np.ndarray:
    """The bits for a block's sorted hashes, `each` in a row of the result if more than one."""
    out = np.zeros(each * len(keys), bool)
    cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
    at = np.concatenate([[0], cuts, [len(keys)]]).astype(int)
    for k, bucket, data in zip(answers.column("kind").to_pylist(), answers.column("bucket").to_pylist(), answers.column("bits"), strict=True):
        if k == kind:
            a, b = each * at[bucket], each * at[bucket + 1]
            out[a:b] = np.unpackbits(np.frombuffer(data.as_py(), np.uint8), count=b - a).astype(bool)
    return out if each == 1 else out.reshape(-1, each)


def with_answers(frame: DataFrame, answers: DataFrame, fn: Callable[[int, pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """fn(block, rows, answers) for each block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [fn(block, decode(data.as_py()), right) for block, data in zip(left.column("block").to_pylist(), left.column("data"), strict=True)]
        return pa.concat_tables(out)

    return frame.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
