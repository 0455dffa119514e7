"""Embedding near-duplicates by iterative quantisation.

Vectors are centred, projected on principal axes and turned by learned rotations so that the signs of their
coordinates are balanced codes; several Hamming tables index substrings of these codes. Codes alone meet in the
buckets: the pairs that share one in any table and whose whole codes are within a radius are candidates, and only
vectors that have one are sent, to be reranked by the cosine of the original vectors in double precision. Vectors
that are equal are one node. Vectors of each length have codes and buckets of their own. The number of tables is
raised until the learned codes, measured on sample vectors and partners turned to the threshold itself, miss one
such pair in a thousand by bucket or radius; where that takes too many tables, codes get shorter, down to one bucket of all. A table
is looked up at a vector's own bucket alone: by calculation for random planes, two codes of ten bits agree one time
in three at the threshold, and eleven tables miss 1 % of the pairs where one table with its ten neighbours, for as
many copies of each vector, misses 27 %.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.llm.shared import components, drop, written

COSINE = 0.95
#: Vectors that the rotation is learned from, and their bytes, which the driver holds.
SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
ITERATIONS = 30
#: Expected nodes in a bucket, chance that all tables miss a pair at the threshold, members of one block of a bucket.
BUCKET, MISS, BLOCK = 32, 0.001, 2048
#: Pairs of each kind that the misses are measured on, and tables beyond which codes get shorter instead.
PAIRS, TABLES = 10_000, 128
#: Nodes of one length up to which they are one bucket, as no code of four bits would be filled.
FEW = BUCKET << 4


def _at_threshold(unit: np.ndarray, cosine: float, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and partners at the given cosine: turned in any direction, and towards other vectors of the sample."""
    own = np.resize(np.arange(len(unit)), PAIRS)
    left, noise = unit[own], rng.normal(size=(PAIRS, unit.shape[1]))
    out = []
    for way in (noise, unit[rng.permutation(own)] - left + 1e-9 * noise):
        way = way - (way * left).sum(1, keepdims=True) * left
        right = cosine * left + math.sqrt(1 - cosine * cosine) * way / np.maximum(np.linalg.norm(way, axis=1, keepdims=True), 1e-300)
        out.append((left, right / np.linalg.norm(right, axis=1, keepdims=True)))
    return out


class Codes:
    """Learned codes: `tables` substrings of `bits` bits each; without bits, one bucket holds all vectors."""

    def __init__(self, sample: np.ndarray, nodes: int, cosine: float, seed: int = 7):
        agree = 1 - math.acos(cosine) / math.pi
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.mean = unit.mean(0)
        centred = unit - self.mean
        _, _, axes = np.linalg.svd(centred.T @ centred)
        self._axes, self._projected, self._turns, self._rng = axes, centred @ axes.T, [], np.random.default_rng(seed)
        pairs = _at_threshold(unit, cosine, np.random.default_rng(seed + 1))
        for self.bits in range(min(24, max(4, math.ceil(math.log2(max(1, nodes / BUCKET))))), 3, -1):
            # As many as raw angles ask for; centred vectors lie at wider ones.
            self.tables = math.ceil(math.log(MISS) / math.log(1 - agree**self.bits))
            while self.tables <= TABLES and self.tables < 2**self.bits:
                self._lay()
                missed = self._measure(pairs)
                if missed <= MISS:
                    break
                self.tables = math.ceil(self.tables * min(2, max(1.1, math.log(MISS) / math.log(min(missed, 0.999)))))
            else:
                continue
            break
        else:
            self.bits, self.tables, self.radius = 0, 1, 0
            self._lay()
        del self._axes, self._projected, self._turns, self._rng

    def _lay(self) -> None:
        dim, n = len(self.mean), self.tables * self.bits
        while len(self._turns) * dim < n:
            turn = np.linalg.qr(self._rng.normal(size=(dim, dim)))[0]
            for _ in range(ITERATIONS):
                u, _, v = np.linalg.svd(np.sign(self._projected @ turn).T @ self._projected)
                turn = (u @ v).T
            self._turns.append(self._axes.T @ turn)
        planes = np.concatenate(self._turns, 1)[:, :n] if n else np.zeros((dim, 0))
        # Neighbouring columns of one rotation belong to different tables, so that each table draws on several.
        self.planes = planes.reshape(dim, self.bits, self.tables).transpose(0, 2, 1).reshape(dim, -1)
        self.offset = self.mean @ self.planes

    def _measure(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> float:
        """Sets the radius, and gives the share of the pairs of the worse kind that no table has in one bucket or that lie beyond it."""
        apart, met = [], []
        for left, right in pairs:
            d, m = [], []
            for i in range(0, len(left), 1000):
                a, b = self.signs(left[i : i + 1000]), self.signs(right[i : i + 1000])
                d.append((a != b).sum(1))
                m.append((self.buckets(a) == self.buckets(b)).any(1))
            apart.append(np.concatenate(d))
            met.append(np.concatenate(m))
        self.radius = int(max(math.ceil(np.quantile(d, 1 - MISS / 4)) for d in apart))
        return max(float(1 - (m & (d <= self.radius)).mean()) for m, d in zip(met, apart, strict=True))

    def signs(self, unit: np.ndarray) -> np.ndarray:
        """Vectors by bits of the whole code."""
        return unit @ self.planes > self.offset

    def buckets(self, signs: np.ndarray) -> np.ndarray:
        """Vectors by tables: the bucket of each."""
        return signs.reshape(len(signs), self.tables, self.bits) @ (1 << np.arange(self.bits))

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        return self.buckets(self.signs(unit))


def _unit(blobs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    # First by the largest component, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal vectors of a partition as one; vectors that link with nothing have no node."""
    held: dict[bytes | None, list] = {}

    def rows() -> pa.RecordBatch:
        got = list(held.items())
        held.clear()
        blobs = [k for k, _ in got]
        nodes = [None if k is None else hashlib.blake2b(k, digest_size=16).digest() for k in blobs]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(blobs, pa.binary()), pa.array([v for _, v in got], pa.list_(pa.int64()))], ["node", "vec", "ids"])

    n = 0
    for batch in batches:
        for vec_id, vec in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = vec.as_py()
            key = None
            if x and all(v is not None for v in x):
                a = np.array(x, np.float64) + 0.0  # -0.0 is 0.0
                if np.isfinite(a).all() and a.any():
                    key = a.tobytes()
            held.setdefault(key, []).append(vec_id)
            n += 1
        if n >= 20_000:
            n = 0
            yield rows()
    if held:
        yield rows()


def _near(table: pa.Table, radius: dict[int, int]) -> pa.Table:
    """The rows of a bucket's block or pair of blocks that have another one's code within the radius."""
    codes = table.column("code").to_pylist()
    width = len(codes[0])
    rows = table.drop_columns(["code"])
    if not width:
        return rows
    whole = np.zeros((len(codes), -(-width // 8) * 8), np.uint8)
    whole[:, :width] = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, width)
    words = whole.view(np.uint64)
    side, most = np.array(table.column("side").to_pylist()), radius[table.column("size")[0].as_py()]
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = not len(second)
    others = first if within else second
    near = np.zeros(len(codes), bool)
    step = max(1, (1 << 20) // max(1, len(others) * words.shape[1]))
    for a in range(0, len(first), step):
        mine = first[a : a + step]
        apart = np.bitwise_count(words[mine, None] ^ words[others]).sum(2, dtype=np.int32)
        if within:
            apart[np.arange(len(mine)), np.arange(a, a + len(mine))] = most + 1
        close = apart <= most
        near[mine] |= close.any(1)
        near[others] |= close.any(0)
    return rows.filter(pa.array(near))


def _links(table: pa.Table, codes: dict[int, Codes], cosine: float) -> pa.Table:
    """Of a bucket's block or pair of blocks: copies linked with each node, and a linked node that leads on to its component here."""
    t, side = table.column("t")[0].as_py(), np.array(table.column("side").to_pylist())
    nodes, copies = table.column("node").to_pylist(), np.array(table.column("copies").to_pylist(), np.int64)
    unit = _unit(table.column("vec").to_pylist())
    known = codes.get(8 * unit.shape[1])
    signs = known.signs(unit) if known else np.zeros((len(unit), 0), bool)
    own = known.buckets(signs) if known else np.zeros((len(unit), 1), np.int64)
    radius = known.radius if known else 0
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = not len(second)
    count = np.zeros(len(nodes), np.int64)
    low = np.arange(len(nodes))
    edges: list[tuple[int, int]] = []

    def top(i: int) -> int:
        while low[i] != i:
            low[i] = low[low[i]]
            i = low[i]
        return i

    for a in range(0, len(first), 256):
        mine = first[a : a + 256]
        others = first if within else second
        i, j = np.nonzero(unit[mine] @ unit[others].T >= cosine)
        i, j = mine[i], others[j]
        if within:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        new = ~(own[i, :t] == own[j, :t]).any(1)  # else counted in an earlier table
        new &= (signs[i] != signs[j]).sum(1) <= radius
        i, j = i[new], j[new]
        np.add.at(count, i, copies[j])
        np.add.at(count, j, copies[i])
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = top(x), top(y)
            if p != q:
                low[max(p, q)] = min(p, q)
                edges.append((x, y))
    has = np.flatnonzero(count)
    out = [(nodes[i], int(count[i]), None) for i in has.tolist()] + [(nodes[i], 0, nodes[j]) for i, j in edges]
    return pa.table([pa.array([x[k] for x in out], t) for k, t in ((0, pa.binary()), (1, pa.int64()), (2, pa.binary()))], names=["a", "links", "b"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """(vec_id long, n_links long, component_id long, kept boolean) of every row.

    Two vectors link when the tables find them and their cosine is at least `cosine`. n_links counts the other
    rows linked directly, copies included; component_id is the smallest vec_id that links reach, kept marks
    that one. Null, empty and zero vectors, and ones with null or non-finite components link with nothing;
    vectors of different lengths do not link with each other. Null ids are larger than any; repeated rows link
    with each other; other columns are not read; no rows give no rows. The rotations of each length are learned
    from at most `sample` vectors of SAMPLE_BYTES together; every vector is indexed.
    """
    rows = vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>").alias("vec"))
    base = written(rows.mapInArrow(_nodes, "node binary, vec binary, ids array<long>"), "vectors")
    known = base.where("node IS NOT NULL").groupBy("node").agg(F.first("vec").alias("vec"), F.sum(F.size("ids")).alias("copies"))
    nodes = written(known.withColumn("size", F.length("vec")), "nodes")
    spark = vectors.sparkSession
    codes = {}
    for row in nodes.groupBy("size").count().where(F.col("count") > FEW).orderBy("size").collect():
        learn = nodes.where(F.col("size") == row["size"]).orderBy("node").limit(min(sample, SAMPLE_BYTES // row["size"] + 1)).select("vec").collect()
        codes[row["size"]] = Codes(_unit([bytes(r["vec"]) for r in learn]), row["count"], cosine)
    shared = spark.sparkContext.broadcast(codes)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array(batch.column("size").to_pylist(), np.int32)
            for size in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == size))
                known = shared.value.get(size)
                unit = _unit(part.column("vec").to_pylist()) if known else None
                signs = known.signs(unit) if known else np.zeros((part.num_rows, 0), bool)
                got = known.buckets(signs) if known else np.zeros((part.num_rows, 1))
                packed = [x.tobytes() for x in np.packbits(signs, 1)]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("size"), pa.array(packed, pa.binary()), pa.array(list(got.astype("i4")), pa.list_(pa.int32()))], ["node", "size", "code", "codes"])

    cells = nodes.select("node", "size", "vec").mapInArrow(coded, "node binary, size int, code binary, codes array<int>").select("node", "size", "code", F.posexplode("codes").alias("t", "bucket"))
    cells = written(cells, "cells")
    # A bucket of one node has no pair; a large one is dealt in blocks, each block to meet each other block once.
    sizes = cells.groupBy("size", "t", "bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = cells.join(sizes, ["size", "t", "bucket"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("node", "size", "code", "t", "bucket", "part", meets).select("node", "size", "code", "t", "bucket", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), (F.col("part") > F.col("other")).cast("int").alias("side"))
    by, radius = ("size", "t", "bucket", "x", "y"), {k: c.radius for k, c in codes.items()}
    near = written(placed.groupBy(*by).applyInArrow(lambda g: _near(g, radius), "node binary, size int, t int, bucket int, x int, y int, side int"), "near")
    found = near.join(nodes.drop("size"), "node").groupBy(*by).applyInArrow(lambda g: _links(g, shared.value, cosine), "a binary, links long, b binary")
    found = written(found, "links")
    drop(cells, near, nodes)
    labels = components(found.where("b IS NOT NULL").select("a", "b"))
    linked = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    each = base.where("node IS NOT NULL").groupBy("node").agg(F.min(F.array_min("ids")).alias("low"), F.sum(F.size("ids")).alias("copies"))
    each = each.join(labels, "node", "left").join(linked, "node", "left").withColumn("label", F.coalesce("component", "node"))
    # Written first, so that the join may split the members of a large component.
    least = written(each.groupBy("label").agg(F.min("low").alias("component_id")), "least")
    final = each.join(least, "label").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), "component_id")
    done = base.where("node IS NOT NULL").select("node", "ids").join(final, "node").select(F.explode("ids").alias("vec_id"), "n_links", "component_id")
    alone = base.where("node IS NULL").select(F.explode("ids").alias("vec_id")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
