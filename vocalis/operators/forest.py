"""A random forest whose trees grow in tasks and stay in a table: the driver holds no nodes but those above a task's share of rows.

Features become at most 256 bins. Rows lie in blocks, and a tree is grown in two parts: nodes of more rows than a task
takes are split by histograms over all partitions, a level a pass; what is below goes to tasks, one for each such node
of each tree, which need no further pass. Scores take the same way: rows go to the trees, sums come back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 256
#: Rows of a block; bytes of bins that one task grows below a node; nodes split in one pass over all rows.
BLOCK_ROWS, TASK_BYTES, PASS_NODES = 2048, 16 << 20, 512
_PIECE = "tree int, node int, block long, at binary, y binary, n binary, bins binary"
_SUBTREE = "tree int, node int, feature binary, cut binary, left binary, value binary"


def kept(df: DataFrame) -> DataFrame:
    """df cut from its plan: in the folder that spark.checkpoint.dir names, or with the executors where none is named."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


@dataclass
class Tree:
    """Nodes in the order they were made; a row goes to left + 1 if its bin of the feature is beyond the cut. A leaf's left is 0."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    TYPES = (np.int32, np.uint8, np.int32, np.float64)

    @staticmethod
    def of(parts: list[bytes]) -> Tree:
        return Tree(*(np.frombuffer(p, t) for p, t in zip(parts, Tree.TYPES, strict=True)))

    def parts(self) -> list[bytes]:
        return [np.asarray(x, t).tobytes() for x, t in zip((self.feature, self.cut, self.left, self.value), Tree.TYPES, strict=True)]

    def reach(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rows := rows[self.left[at[rows]] > 0]):
            k = at[rows]
            at[rows] = self.left[k] + (bins[rows, self.feature[k]] > self.cut[k])
        return at


def _splits(node: np.ndarray, value: np.ndarray, n0: np.ndarray, n1: np.ndarray, weight: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each node the least weighted Gini impurity that a cut leaves (as a score, -inf without a cut), and the cut.

    Entries are in order of node and bin, with their rows of both classes; a cut is halfway between two bins that occur.
    """
    best, cut = np.full(nodes, -np.inf), np.zeros(nodes, np.int64)
    i = np.flatnonzero((node[1:] == node[:-1]) & (value[1:] > value[:-1]))
    if len(i):
        k = node[i]
        first, last = np.searchsorted(node, k), np.searchsorted(node, k, "right")
        sums = [np.concatenate([[0], np.cumsum(n)]) for n in (n0, n1)]
        l0, l1 = ((s[i + 1] - s[first]) * w for s, w in zip(sums, weight, strict=True))
        r0, r1 = ((s[last] - s[i + 1]) * w for s, w in zip(sums, weight, strict=True))
        score = (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)
        np.maximum.at(best, k, score)
        won = np.flatnonzero(score == best[k])[::-1]
        cut[k[won]] = (value[i[won]].astype(np.int64) + value[i[won] + 1]) // 2
    return best, cut


def grow(bins: np.ndarray, y: np.ndarray, n: np.ndarray, weight: np.ndarray, tries: int, depth: int, rng: np.random.Generator) -> Tree:
    """A tree of rows that count n times, level by level to pure leaves or the depth; it does not depend on the rows' order.

    Each node tries so many features at random, and others only while none of them has a cut.
    """
    features = bins.shape[1]
    size = max(1, int(len(bins) - 1).bit_length())
    both = (np.where(y, 0, n).astype(np.int64), np.where(y, n, 0).astype(np.int64))
    rows, at, count, made = np.arange(len(bins)), np.zeros(len(bins), np.int64), 1, 1
    levels = []
    for level in range(depth + 1):
        sums = [np.bincount(at, b[rows], count) for b in both]
        w0, w1 = (s * w for s, w in zip(sums, weight, strict=True))
        feature, cut, left = np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
        levels.append((feature, cut, left, w1 / (w0 + w1)))
        pending = np.flatnonzero((w0 > 0) & (w1 > 0)) if level < depth else np.zeros(0, np.int64)
        order = rng.random((len(pending), features), np.float32).argsort(1).astype(np.int32)
        found = []
        for start in range(0, features, tries):
            if not len(pending):
                break
            name = np.full(count, -1)
            name[pending] = np.arange(len(pending))
            mine = name[at]
            here, mine = rows[mine >= 0], mine[mine >= 0]
            best, what, where = np.full(len(pending), -np.inf), np.zeros(len(pending), np.int64), np.zeros(len(pending), np.int64)
            for j in range(start, min(start + tries, features)):
                key = np.sort(((mine * BINS + bins[here, order[mine, j]]) << size) | here)
                row, key = key & ((1 << size) - 1), key >> size
                score, c = _splits(key >> 8, key & 255, both[0][row], both[1][row], weight, len(pending))
                better = score > best
                best[better], what[better], where[better] = score[better], order[better, j], c[better]
            has = best > -np.inf
            feature[pending[has]], cut[pending[has]] = what[has], where[has]
            found.append(pending[has])
            pending, order = pending[~has], order[~has]
        split = np.sort(np.concatenate([*found, np.zeros(0, np.int64)])).astype(np.int64)
        if not len(split):
            break
        left[split] = made + 2 * np.arange(len(split))
        goes = left[at] > 0
        rows, at = rows[goes], at[goes]
        at = left[at] - made + (bins[rows, feature[at]] > cut[at])
        count, made = 2 * len(split), made + 2 * len(split)
    return Tree(*(np.concatenate(x) for x in zip(*levels, strict=True)))


@dataclass
class DealtForest:
    """tops: each tree above the tasks' nodes; subtrees: the rest, a row for each leaf of a top."""

    columns: list[str]
    cuts: list[list[float]]
    tops: list[Tree]
    subtrees: DataFrame

    def save(self, path: str) -> None:
        spark = self.subtrees.sparkSession
        self.subtrees.write.mode("overwrite").parquet(f"{path}/subtrees")
        rows = [(i, json.dumps(self.columns), json.dumps(self.cuts), *map(bytearray, t.parts())) if i == 0 else (i, None, None, *map(bytearray, t.parts())) for i, t in enumerate(self.tops)]
        spark.createDataFrame(rows, "tree int, columns string, cuts string, feature binary, cut binary, left binary, value binary").write.mode("overwrite").parquet(f"{path}/tops")

    @staticmethod
    def load(spark: SparkSession, path: str) -> DealtForest:
        rows = spark.read.parquet(f"{path}/tops").orderBy("tree").collect()
        tops = [Tree.of([bytes(p) for p in r[3:]]) for r in rows]
        return DealtForest(json.loads(rows[0].columns), json.loads(rows[0].cuts), tops, spark.read.schema(_SUBTREE).parquet(f"{path}/subtrees"))


def _columns(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names], 1)


def bin_cuts(rows: DataFrame, columns: list[str]) -> list[list[float]]:
    """The upper ends of all bins but a feature's last: halfway between quantiles and the values that follow them."""
    at = [sorted(set(c)) for c in rows.stat.approxQuantile(columns, [i / BINS for i in range(1, BINS)], 1 / (4 * BINS))]

    def following(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = [np.full(len(a) + 1, np.inf) for a in at]
        for b in batches:
            for x, a, low in zip(_columns(b, columns).T, at, least, strict=True):
                np.minimum.at(low, np.searchsorted(a, x), x)
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([np.concatenate(least).tobytes()])], ["k", "least"])

    def lowest(t: pa.Table) -> pa.Table:
        return pa.table({"k": pa.array([0]), "least": pa.array([np.min([np.frombuffer(x.as_py()) for x in t["least"]], 0).tobytes()])})

    # Two levels, so that no task meets all partitions.
    partial = rows.select(columns).mapInArrow(following, "k long, least binary").withColumn("k", F.spark_partition_id().cast("long") % 64)
    got = partial.groupBy("k").applyInArrow(lowest, "k long, least binary").collect()
    least, out, k = np.min([np.frombuffer(bytes(r.least)) for r in got], 0), [], 0
    for a in at:
        # After a value comes the least of its next bins that is not empty.
        after = np.minimum.accumulate(least[k : k + len(a) + 1][::-1])[::-1][1:]
        middle = np.array(a) / 2 + after / 2
        out.append(sorted(set(np.where(np.isfinite(middle) & (middle < after), middle, a)[after > np.array(a)].tolist())))
        k += len(a) + 1
    return out


def _binned(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    return np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], 1).astype(np.uint8)


def _blocks(df: DataFrame, columns: list[str], cuts: list[list[float]], label: str | None = None) -> DataFrame:
    """Blocks of rows whose features are all there: their bins, and their labels or else the rows themselves."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        for b in batches:
            for start in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(start, BLOCK_ROWS)
                x = _columns(part, columns)
                there = ~np.isnan(x).any(1)
                part, x = part.filter(pa.array(there)), x[there]
                if not len(x):
                    continue
                if label is not None:
                    held = (part.column(label).to_numpy(zero_copy_only=False) == 1).tobytes()
                else:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as out:
                        out.write_batch(part)
                    held = sink.getvalue().to_pybytes()
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([len(x)]), pa.array([_binned(x, cuts).tobytes()]), pa.array([held])], ["block", "size", "bins", "held"])
                block += 1

    return df.mapInArrow(cut, "block long, size long, bins binary, held binary")


def _matrix(data: bytes, features: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, features)


def _drawn(seed: int, block: int, size: int, trees: int) -> np.ndarray:
    """How often each tree draws each row of a block."""
    return np.random.default_rng([seed, block]).poisson(1.0, (trees, size)).astype(np.uint8)


def _sent(pieces: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*pieces, strict=True), (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], ["tree", "node", "block", "at", "y", "n", "bins"])


def _tops(blocks: DataFrame, features: int, trees: int, tries: int, depth: int, seed: int, weight: np.ndarray, task_rows: int) -> tuple[list[Tree], list[list[int]]]:
    """Each tree as far as its nodes have more rows than a task takes, and the depths of these nodes; where a tree ends here the feature is -1.

    Histograms are summed in tasks, the driver gets one split for each node.
    """
    nodes = [{"feature": [0], "cut": [0], "left": [0], "value": [0.0], "depth": [0]} for _ in range(trees)]
    total = blocks.agg(F.sum("size")).first()[0]
    if not total:
        raise ValueError("no row has a label and all features")
    waiting = [(t, 0, 0) for t in range(trees)] if total > task_rows else []
    while waiting:
        now, waiting = waiting[:PASS_NODES], waiting[PASS_NODES:]
        asked: dict[int, list[tuple[int, int]]] = {}
        for t, k, start in now:
            asked.setdefault(t, []).append((k, start))
        grown = {t: Tree.of(Tree(*(np.array(nodes[t][n]) for n in ("feature", "cut", "left", "value"))).parts()) for t in asked}

        def tried(t: int, k: int, start: int) -> np.ndarray:
            return np.random.default_rng([seed, t, k]).permutation(features)[start : start + tries]

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {(t, k): np.zeros((2, min(tries, features - start), BINS), np.int64) for t, all_of in asked.items() for k, start in all_of}
            for b in batches:
                for block, size, bins, held in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    x, y, drawn = _matrix(bins, features), np.frombuffer(held, bool), _drawn(seed, block, size, trees)
                    for t, all_of in asked.items():
                        at = np.where(drawn[t] > 0, grown[t].reach(x), -1)
                        for k, start in all_of:
                            here = np.flatnonzero(at == k)
                            for j, f in enumerate(tried(t, k, start)):
                                for c in (0, 1):
                                    own = here[y[here] == c]
                                    sums[t, k][c, j] += np.bincount(x[own, f], drawn[t][own], BINS).astype(np.int64)
            for (t, k), s in sums.items():
                if s.any():
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([k], pa.int32()), pa.array([s.tobytes()])], ["tree", "node", "sums"])

        def chosen(key: tuple, table: pa.Table) -> pa.Table:
            t, k = key[0].as_py(), key[1].as_py()
            start = dict(asked[t])[k]
            s = sum(np.frombuffer(x.as_py(), np.int64) for x in table["sums"]).reshape(2, -1, BINS)
            best, feature, cut, low = -np.inf, -1, 0, 0
            for j, f in enumerate(tried(t, k, start)):
                value = np.flatnonzero(s[:, j].any(0))
                score, c = _splits(np.zeros(len(value), np.int64), value, s[0, j][value], s[1, j][value], weight, 1)
                if score[0] > best:
                    best, feature, cut = score[0], f, c[0]
                    low = s[:, j, : c[0] + 1].sum()
            n0, n1 = s[:, 0].sum(1)
            return pa.table({n: pa.array([v], kind) for n, v, kind in (("tree", t, pa.int32()), ("node", k, pa.int32()), ("n0", n0, pa.int64()), ("n1", n1, pa.int64()), ("feature", feature, pa.int32()), ("cut", cut, pa.int32()), ("low", low, pa.int64()))})

        got = blocks.mapInArrow(counted, "tree int, node int, sums binary").groupBy("tree", "node").applyInArrow(chosen, "tree int, node int, n0 long, n1 long, feature int, cut int, low long").collect()
        starts = {(t, k): start for t, k, start in now}
        for r in sorted(got):
            tree, start = nodes[r.tree], starts[r.tree, r.node]
            w0, w1 = r.n0 * weight[0], r.n1 * weight[1]
            tree["value"][r.node] = w1 / (w0 + w1)
            if not (r.n0 and r.n1) or tree["depth"][r.node] >= depth:
                tree["feature"][r.node] = -1
            elif r.feature < 0:
                # No feature tried has a cut: the next ones are tried; a node without any cut is a leaf.
                if start + tries < features:
                    waiting.append((r.tree, r.node, start + tries))
                else:
                    tree["feature"][r.node] = -1
            else:
                tree["feature"][r.node], tree["cut"][r.node], tree["left"][r.node] = r.feature, r.cut, len(tree["left"])
                for rows in (r.low, r.n0 + r.n1 - r.low):
                    if rows > task_rows:
                        waiting.append((r.tree, len(tree["left"]), 0))
                    for name, v in (("feature", 0), ("cut", 0), ("left", 0), ("value", tree["value"][r.node]), ("depth", tree["depth"][r.node] + 1)):
                        tree[name].append(v)
    return [Tree(*(np.array(t[n]) for n in ("feature", "cut", "left", "value"))) for t in nodes], [t["depth"] for t in nodes]


def fit(df: DataFrame, columns: list[str], label: str, weights: dict[int, float], trees: int, depth: int, seed: int) -> DealtForest:
    """Rows without a label or with a feature that is null or NaN are left out. Each tree draws rows with Poisson's counts of mean 1."""
    names, features = [f"x{i}" for i in range(len(columns))], len(columns)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _columns(b, [label, *columns])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in x[~np.isnan(x).any(1)].T], ["y", *names])

    # Not as aliases, casts and a filter of all columns: the driver's optimizer ran out of memory on them.
    named = df.select(label, *columns).mapInArrow(whole, ", ".join(f"{n} double" for n in ("y", *names)))
    weight, tries = np.array([weights[0], weights[1]]), int(np.ceil(np.sqrt(features)))
    cuts = bin_cuts(named, names)
    blocks = kept(_blocks(named, names, cuts, "y"))
    tops, depths = _tops(blocks, features, trees, tries, depth, seed, weight, max(1, TASK_BYTES // features))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, size, bins, held in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, y, drawn, pieces = _matrix(bins, features), np.frombuffer(held, bool), _drawn(seed, block, size, trees), []
                for t, top in enumerate(tops):
                    own = np.flatnonzero(drawn[t])
                    at = top.reach(x[own])
                    for k in np.unique(at[top.feature[at] >= 0]):
                        here = own[at == k]
                        pieces.append((t, int(k), block, b"", y[here].tobytes(), drawn[t][here].tobytes(), x[here].tobytes()))
                    if len(pieces) >= 16:
                        yield _sent(pieces)
                        pieces = []
                if pieces:
                    yield _sent(pieces)

    def grown(key: tuple, table: pa.Table) -> pa.Table:
        t, k = key[0].as_py(), key[1].as_py()
        y, n, x = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("y", bool), ("n", np.uint8), ("bins", np.uint8)))
        tree = grow(x.reshape(-1, features), y, n, weight, tries, depth - depths[t][k], np.random.default_rng([seed, t, k, 1]))
        return pa.table({"tree": pa.array([t], pa.int32()), "node": pa.array([k], pa.int32())} | {c: pa.array([p]) for c, p in zip(("feature", "cut", "left", "value"), tree.parts(), strict=True)})

    pieces = blocks.mapInArrow(deal, _PIECE).repartition(_parts(tops), "tree", "node")
    return DealtForest(list(columns), cuts, tops, kept(pieces.groupBy("tree", "node").applyInArrow(grown, _SUBTREE)))


def _parts(tops: list[Tree]) -> int:
    """Tasks for the nodes below tops: about one each."""
    return min(2000, max(1, sum(int(((t.left == 0) & (t.feature >= 0)).sum()) for t in tops)))


def score(forest: DealtForest, df: DataFrame) -> DataFrame:
    """df with score, the mean of the trees' probabilities of class 1, and pred; rows with a feature that is null or NaN are left out."""
    df = df.drop("score", "pred")
    columns, cuts, tops, features, names = forest.columns, forest.cuts, forest.tops, len(forest.columns), df.columns
    blocks = kept(_blocks(df, columns, cuts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, bins in zip(b.column("block").to_pylist(), b.column("bins").to_pylist(), strict=True):
                x, pieces = _matrix(bins, features), []
                for t, top in enumerate(tops):
                    at = top.reach(x)
                    ends = top.feature[at] < 0
                    if ends.any():
                        pieces.append((t, -1, block, np.flatnonzero(ends).astype(np.int32).tobytes(), b"", top.value[at[ends]].tobytes(), b""))
                    for k in np.unique(at[~ends]):
                        here = np.flatnonzero(at == k)
                        pieces.append((t, int(k), block, here.astype(np.int32).tobytes(), b"", b"", x[here].tobytes()))
                    if len(pieces) >= 16:
                        yield _sent(pieces)
                        pieces = []
                if pieces:
                    yield _sent(pieces)

    def reached(pieces: pa.Table, subtree: pa.Table) -> pa.Table:
        # What has ended in the top brings its value; a tree that drew no row at all has no subtree, and even odds.
        value = [n or np.full(len(at) // 4, 0.5).tobytes() for n, at in zip(pieces["n"].to_pylist(), pieces["at"].to_pylist(), strict=True)]
        if subtree.num_rows:
            tree = Tree.of([subtree[c][0].as_py() for c in ("feature", "cut", "left", "value")])
            value = [tree.value[tree.reach(_matrix(x, features))].tobytes() for x in pieces["bins"].to_pylist()]
        return pa.table({"block": pieces["block"], "tree": pieces["tree"], "at": pieces["at"], "value": pa.array(value, pa.binary())})

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        # By tree, so that the last bits do not depend on the order of arrival.
        parts = [(t, np.frombuffer(at, np.int32), np.frombuffer(v)) for t, at, v in zip(*(table[c].to_pylist() for c in ("tree", "at", "value")), strict=True)]
        out = np.zeros(1 + max(at.max() for _, at, _ in parts))
        for _, at, v in sorted(parts, key=lambda p: p[0]):
            out[at] += v
        return pa.table({"block": pa.array([key[0].as_py()]), "scores": pa.array([(out / len(tops)).tobytes()])})

    pieces = blocks.select("block", "bins").mapInArrow(deal, _PIECE).repartition(_parts(tops), "tree", "node")
    subtrees = forest.subtrees.repartition(_parts(tops), "tree", "node")
    sums = pieces.groupBy("tree", "node").cogroup(subtrees.groupBy("tree", "node")).applyInArrow(reached, "block long, tree int, at binary, value binary")
    sums = sums.groupBy("block").applyInArrow(summed, "block long, scores binary")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for held, scores in zip(b.column("held").to_pylist(), b.column("scores").to_pylist(), strict=True):
                rows, s = pa.ipc.open_stream(held).read_all(), np.frombuffer(scores)
                got = pa.table({n: rows[n] for n in names} | {"score": pa.array(s), "pred": pa.array((s > 0.5).astype(np.int32))})
                yield from got.to_batches()

    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("pred", T.IntegerType())])
    return blocks.select("block", "held").join(sums, "block").mapInArrow(whole, schema)
