"""Exact n-gram Jaccard self-join by a token-group matrix.

Documents with equal shingle sets are one node. Rare shingles come first in the global order of shingles, in
classes of how many nodes have them, so a node is settled as soon as those that no other node has fill its
prefix; what is left are nodes made of repeated text, which meet in the rarest of it. These are partitioned into groups by their prefixes. Inside a group, links are verified with
the group's pivot, then among the members that fail. What is joined by then and fills a block is a group of its
own; the rest stay with their first group. Across groups, a matrix of prefix shingles by groups
tells which groups a node may reach at all; of each such block of a group, first counts of shingle classes and
then the union of shingles bound the overlap, and only a block that can qualify is opened and verified. Components
need no link that joins what is joined already, so neither stage compares all pairs of a large group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalis.llm import exchange
from vocalis.llm.exchange import mix
from vocalis.llm.recompress import BASES, forget, rolling, word_names
from vocalis.llm.shared import bucketed, cache_of, components, drop, release, written

WORDS, PERCENT = 4, 85
#: Members of one block of a group, and queries of a block that one task answers.
GROUP_BLOCK, ASK_BLOCK = 256, 512

#: A row of the input: its id, and what tells it from others of the same id if asked for.
ROW = "struct<none: boolean, id: long, key: long>"
NODES = f"node binary, n long, rows array<{ROW}>, prefix array<long>, shingles binary, classes binary"
#: Classes of shingles whose counts bound overlaps before any set is sent.
CLASSES = 128


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of a text with fewer words, one hash of them all."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    names = word_names(w)
    if len(w) < words:
        return rolling(mix(names + np.uint64(len(w))), len(w), BASES[1])
    return np.unique(rolling(names, words, BASES[0]))


def class_counts(s: np.ndarray) -> np.ndarray:
    return np.bincount((s & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES).astype("<u4")


def needed(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The least overlap with any linked set that a set of n shingles must have."""
    return -(-n * percent // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (len(a), len(b)) if len(a) < len(b) else (len(b), len(a))
    if 100 * small < percent * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


class _Block:
    """A block's distinct sets, with the rows that have each."""

    def __init__(self, table: pa.Table, words: int):
        cache_of("names", forget)
        self.sets: dict[bytes, np.ndarray] = {}
        self.rows: dict[bytes | None, list] = {}
        for row, x in zip(table.column("_row").to_pylist(), table.column("_text"), strict=True):
            s = shingles(x.as_py(), words)
            node = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
            if node is not None:
                self.sets.setdefault(node, s)
            self.rows.setdefault(node, []).append(row)

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles, and in how many sets here each is, up to 255."""
        if not self.sets:
            return np.empty(0, np.uint64), np.empty(0, np.uint8)
        keys, count = np.unique(np.concatenate(list(self.sets.values())), return_counts=True)
        return keys, np.minimum(count, 255).astype(np.uint8)


def _sets(blobs: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint64) for x in blobs]


class _Joined:
    """Union-find over a block's members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


class _Overlaps:
    """Sets by shingle, to count what each has in common with another."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        token, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(token, kind="stable")
        self.token, self.of = token[order], of[order]

    def linked(self, s: np.ndarray, percent: int) -> np.ndarray:
        """Which sets link with s."""
        a, b = np.searchsorted(self.token, s, "left"), np.searchsorted(self.token, s, "right")
        size = b - a
        if int((size > 0).sum()) < needed(len(s), percent):
            # Not even the union of all sets has enough of s.
            return np.empty(0, np.int64)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
        common = np.bincount(self.of[at], minlength=len(self.sizes))
        return np.flatnonzero(100 * common >= percent * (self.sizes + len(s) - common))


def _inside(table: pa.Table, percent: int) -> pa.Table:
    """Links that span a group block's components: with the pivot, then among those without a link to it."""
    nodes, sets = table.column("node").to_pylist(), _sets(table.column("shingles"))
    order = sorted(range(len(nodes)), key=lambda i: (not table.column("is_pivot")[i].as_py(), nodes[i]))
    nodes, sets = [nodes[i] for i in order], [sets[i] for i in order]
    joined, out, rest = _Joined(len(nodes)), [], []
    for i in range(1, len(nodes)):
        if linked(sets[0], sets[i], percent):
            joined.join(0, i)
            out.append((nodes[0], nodes[i]))
        else:
            rest.append(i)
    if rest:
        overlaps = _Overlaps(sets)
        for i in rest:
            for j in overlaps.linked(sets[i], percent).tolist():
                if j != i and joined.join(i, j):
                    out.append((nodes[i], nodes[j]))
    return pa.Table.from_pylist([{"a": a, "b": b} for a, b in out], LINKS)


def _bounded(members: pa.Table, queries: pa.Table, percent: int) -> pa.Table:
    """The queries that may link with a member of another label: class by class, no overlap exceeds the smaller count."""
    keep: list[int] = []
    if members.num_rows and queries.num_rows:
        have = np.frombuffer(b"".join(members.column("classes").to_pylist()), "<u4").reshape(-1, CLASSES).astype(np.int64)
        labels = np.array(members.column("label").to_pylist(), object)
        size, top = have.sum(1), have.max(0)
        for i, (x, label) in enumerate(zip(queries.column("classes"), queries.column("label").to_pylist(), strict=True)):
            q = np.frombuffer(x.as_py(), "<u4").astype(np.int64)
            n = int(q.sum())
            # First by the whole block, then by its members.
            if int(np.minimum(q, top).sum()) >= needed(n, percent):
                bound = np.minimum(np.minimum(have, q).sum(1), np.minimum(size, n))
                if ((100 * bound >= percent * (size + n - bound)) & (labels != label)).any():
                    keep.append(i)
    return queries.select(["node", "label", "cell", "part"]).take(pa.array(keep, pa.int64()))


def _across(members: pa.Table, queries: pa.Table, percent: int) -> pa.Table:
    """Links that join the labels of a block's members and of the queries as all links between them do."""
    if not members.num_rows or not queries.num_rows:
        return LINKS.empty_table()
    names, labels, overlaps = members.column("node").to_pylist(), members.column("label").to_pylist(), _Overlaps(_sets(members.column("shingles")))
    asking = queries.column("label").to_pylist()
    place = {x: i for i, x in enumerate(dict.fromkeys(labels + asking))}
    joined, out = _Joined(len(place)), []
    for q, label, mine in zip(queries.column("node").to_pylist(), asking, _sets(queries.column("shingles")), strict=True):
        for j in overlaps.linked(mine, percent).tolist():
            if joined.join(place[label], place[labels[j]]):
                out.append((q, names[j]))
    return pa.Table.from_pylist([{"a": a, "b": b} for a, b in out], LINKS)


def _in_blocks(members: DataFrame, group: str) -> DataFrame:
    """members with the number of blocks of their group and the block each is in."""
    sizes = members.groupBy(group).agg(F.ceil(F.count("*") / GROUP_BLOCK).cast("int").alias("blocks"))
    return members.join(sizes, group).withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _dealt(queries: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The queries of each block in chunks, the members of asked blocks once for each chunk, and the table of chunks to drop."""
    loads = written(queries.groupBy("cell", "part").agg(F.ceil(F.count("*") / ASK_BLOCK).cast("int").alias("chunks")), "loads")
    chunk = F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks")).cast("int")
    chunks = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    return queries.join(loads, ["cell", "part"]).withColumn("chunk", chunk).drop("chunks"), members.join(loads, ["cell", "part"]).withColumn("chunk", chunks).drop("chunks"), loads


def _apart(df: DataFrame) -> DataFrame:
    """The same columns as new ones, to stand beside others of the same source."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def find_links(left: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) whose components are those of all links between the nodes (node, n, prefix, shingles)."""
    tokens = left.select("node", F.explode("prefix").alias("token"))
    pivots = tokens.groupBy("token").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot <> last")
    # A group: nodes whose prefixes lead to the same smallest node. A token's nodes may be many: they are met by its one pivot.
    shared = written(tokens.join(pivots.select("token", "pivot"), "token"), "shared")
    group = shared.groupBy("node").agg(F.min("pivot").alias("grp"))
    members = written(_in_blocks(left.select("node", "n").join(group, "node"), "grp"), "members")
    heads = members.select("grp", "blocks").distinct().select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.col("grp").alias("node"), F.lit(True).alias("is_pivot"))
    placed = members.where("node <> grp").select("grp", "part", "node", F.lit(False).alias("is_pivot")).unionByName(heads)
    first = written(placed.join(left.select("node", "shingles"), "node").groupBy("grp", "part").applyInArrow(lambda t: _inside(t, percent), "a binary, b binary"), "links")
    # Groups of several blocks are dealt anew, so that what their blocks hold apart meets.
    anew = members.where("blocks > 1").select("grp", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int").alias("part"), "node", F.lit(False).alias("is_pivot"))
    mixed = anew.join(left.select("node", "shingles"), "node").groupBy("grp", "part").applyInArrow(lambda t: _inside(t, percent), "a binary, b binary")
    first = written(first.unionByName(mixed), "links")
    labels = components(first)
    # Groups from here on, as cells: a label that fills a block, or what is left of a group.
    named = members.select("node", "n", "grp", (F.col("blocks") == 1).alias("complete")).join(labels, "node", "left").select("node", "n", "grp", "complete", F.coalesce("component", "node").alias("label"))
    large = labels.groupBy(F.col("component").alias("label")).count().where(F.col("count") >= GROUP_BLOCK).select("label", F.col("label").alias("own"))
    labelled = written(_in_blocks(named.join(large, "label", "left").select("node", "n", "grp", "complete", "label", F.coalesce("own", "grp").alias("cell")), "cell"), "labelled")
    # Across: tokens whose nodes have several labels; the smaller cell asks the larger one's blocks, a cell also its own.
    matrix = shared.select("token", "node").join(labelled, "node")
    cells = matrix.groupBy("token", "cell").agg(F.max("blocks").alias("blocks"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("grp").alias("g0"), F.max("grp").alias("g1"), F.min("complete").alias("complete"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    several = cells.groupBy("token").agg(F.min("l0").alias("x"), F.max("l1").alias("y")).where("x <> y").select("token")
    cells = written(cells.join(several, "token"), "cells")
    a, b = cells.alias("a"), cells.alias("b")
    smaller = F.struct("a.blocks", "a.cell") <= F.struct("b.blocks", "b.cell")
    near = (F.col("a.high") * 100 >= F.col("b.low") * percent) & (F.col("b.high") * 100 >= F.col("a.low") * percent)
    # Members of a group of one block have been compared already, those of one label are joined.
    met = F.col("a.complete") & (F.col("a.g0") == F.col("a.g1")) & (F.col("b.g0") == F.col("b.g1")) & (F.col("a.g0") == F.col("b.g0"))
    joined = (F.col("a.l0") == F.col("a.l1")) & (F.col("b.l0") == F.col("b.l1")) & (F.col("a.l0") == F.col("b.l0"))
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & smaller & near & ~met & ~joined).select("a.token", F.col("a.cell").alias("cell"), F.col("b.cell").alias("other"), F.col("b.blocks").alias("others"), "b.low", "b.high")
    asks = matrix.select("token", "node", "label", "cell", "n", F.col("part").alias("mine")).join(pairs, ["token", "cell"]).where((F.col("n") * 100 >= F.col("low") * percent) & (F.col("high") * 100 >= F.col("n") * percent))
    asks = asks.select("node", "label", "other", "others", F.when(F.col("cell") == F.col("other"), F.col("mine")).otherwise(0).alias("first")).distinct()
    asks = written(asks.select("node", "label", F.col("other").alias("cell"), F.explode(F.sequence("first", F.col("others") - 1)).alias("part")), "asks")
    queries, asked, loads = _dealt(asks, labelled.select("cell", "part", "node", "label"))
    classes = left.select("node", "classes")
    by = ("cell", "part", "chunk")
    qualify = asked.join(classes, "node").groupBy(*by).cogroup(_apart(queries.join(classes, "node")).groupBy(*by)).applyInArrow(lambda x, y: _bounded(x, y, percent), "node binary, label binary, cell binary, part int")
    qualify = written(qualify, "qualify")
    queries, opened, loads_opened = _dealt(qualify, labelled.select("cell", "part", "node", "label"))
    sets = left.select("node", "shingles")
    second = opened.join(sets, "node").groupBy(*by).cogroup(_apart(queries.join(sets, "node")).groupBy(*by)).applyInArrow(lambda x, y: _across(x, y, percent), "a binary, b binary")
    second = written(second, "links")
    drop(shared, members, labelled, cells, asks, loads, qualify, loads_opened)
    return first.unionByName(second)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, key: Column | None = None) -> DataFrame:
    """(doc_id long, n_shingles long, component_id long) of every row.

    Two documents link when 100 * intersection >= percent * union of their sets of distinct `words`-word
    shingles (A-Z lowered; words part at ASCII white space; fewer words are one shingle). component_id is
    the smallest doc_id that links reach. A text without words, or null, has no shingles, links with
    nothing and is its own component. A null doc_id is larger than any: its component is null only where no
    other id is reached. Repeated rows link with each other; other columns are not read; no rows give no rows.
    With key, an expression over a row of docs, `key long` and `kept boolean` are added: kept marks the rows of
    the smallest id of a component, and of several texts with that id those of the smallest key.
    """
    own = F.col(id_col).cast("long")
    row = F.struct(own.isNull().alias("none"), own.alias("id"), (F.lit(None) if key is None else key).cast("long").alias("key"))
    rows = docs.select(row.alias("_row"), F.col(text_col).cast("string").alias("_text"))
    kept = exchange.stored(rows, "blocks")
    bits = exchange.bucket_bits(kept)

    def left(_: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(table, words)
        keys, _ = block.tokens()
        rarity = exchange.classes_told(answers, 1, keys, bits)
        out = [{"node": None, "n": 0, "rows": block.rows[None]}] if None in block.rows else []
        for node, mine in block.sets.items():
            rare = rarity[np.searchsorted(keys, mine)]
            n, alone = len(mine), int((rare == 0).sum())
            room = n - needed(n, percent) + 1 - alone
            row = {"node": node, "n": n, "rows": block.rows[node]}
            if room > 0:
                first = mine[np.argsort(rare, kind="stable")[alone : alone + room]]
                row |= {"prefix": first.view(np.int64), "shingles": mine.tobytes(), "classes": class_counts(mine).tobytes()}
            out.append(row)
        rows = pa.list_(pa.struct([("none", pa.bool_()), ("id", pa.int64()), ("key", pa.int64())]))
        return pa.Table.from_pylist(out, pa.schema([("node", pa.binary()), ("n", pa.int64()), ("rows", rows), ("prefix", pa.list_(pa.int64())), ("shingles", pa.binary()), ("classes", pa.binary())]))

    answers = exchange.answer_counts(exchange.ask(kept, lambda t: _Block(t, words).tokens(), bits, narrow=True), 1, narrow=True)
    nodes = written(exchange.with_answers(kept, answers, left, NODES), "nodes")
    todo = nodes.where("prefix IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("shingles").alias("shingles"), F.first("classes").alias("classes"))
    # Their sets are large and needed in several joins: they move to the buckets of their nodes once.
    todo = bucketed(todo, "left", "node")
    drop(kept)
    release(docs.sparkSession)
    labels = components(find_links(todo, percent))
    drop(todo)
    # The least row of a node: ids before none, then the smallest.
    least = nodes.where("node IS NOT NULL").groupBy("node").agg(F.min(F.array_min("rows")).alias("low")).join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    # Written first, so that the join may split the members of a large component.
    lowest = written(least.groupBy("label").agg(F.min("low").alias("low")), "lowest")
    final = least.select("node", "label").join(lowest, "label").select("node", "low")
    linked_rows = nodes.where("node IS NOT NULL").select("node", "n", "rows").join(final, "node").select(F.explode("rows").alias("row"), F.col("n").alias("n_shingles"), "low")
    alone = nodes.where("node IS NULL").select(F.explode("rows").alias("row")).select("row", F.lit(0).cast("long").alias("n_shingles"), F.col("row").alias("low"))
    out = linked_rows.unionByName(alone).select(F.col("row.id").alias("doc_id"), "n_shingles", F.col("low.id").alias("component_id"), F.col("row.key").alias("key"), F.col("row").eqNullSafe(F.col("low")).alias("kept"))
    return out.drop("key", "kept") if key is None else out


def brute_force(rows: list[tuple[int | None, str | None]], words: int = WORDS, percent: int = PERCENT) -> list[tuple]:
    """What the operator returns, by comparing all pairs of word tuples; for tests."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    joined = _Joined(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                joined.join(i, j)
    low: dict[int, int | None] = {}
    for i, (doc, _) in enumerate(rows):
        t = joined.top(i)
        low[t] = doc if low.get(t) is None else low[t] if doc is None else min(doc, low[t])
    return [(doc, len(sets[i]), low[joined.top(i)]) for i, (doc, _) in enumerate(rows)]
