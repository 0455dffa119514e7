"""Toxicity by the nearest labelled examples: exact cosine of TF-IDF, weighted by what words tell of the label, over a block-max inverted index.

A bounded sample of labelled rows becomes examples; everything else covers all documents: document
frequencies are counted over the whole table, and each whole text is scored. The vector space is that of
the examples' words. The inverted index lies in blocks of similar examples, with the largest weight of each
word in each block; a query bounds each block by these alone, opens the few of the largest bounds, and then
only those blocks whose bound still reaches its k-th nearest so far, so the k are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalis.llm.decontaminate import normal, slices
from vocalis.llm.shared import cache_of

#: The sample's bounds: examples of both labels together, and the UTF-8 bytes of a text that may be one.
MAX_EXAMPLES, MAX_EXAMPLE_BYTES = 2048, 16384
NEIGHBOURS = 31
#: Examples of a block, and blocks opened first for each that the k nearest would fill.
BLOCK, FIRST = 16, 2
#: Words in a larger share of the examples are columns of each block's matrix; the others have postings.
COMMON = 0.03
#: Queries that open blocks together.
BATCH = 64
#: Added to distances before votes are weighted by their inverse.
NEAREST = 0.05

EVIDENCE = T.ArrayType(T.StructType().add("doc_id", "long").add("toxic", "integer").add("cosine", "double"))
ADDED = T.StructType().add("score", "double").add("predicted", "integer").add("evidence", EVIDENCE)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def word_counts(text: str | None) -> Counter:
    out: Counter = Counter()
    for part in slices(normal(text)):
        out.update(part.split())
    return out


def sample_examples(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_bytes: int = MAX_EXAMPLE_BYTES) -> tuple[list[tuple[int, int, str]], float]:
    """(doc_id, toxic, text) of at most max_examples rows, and the share of label 1 among all rows to learn from.

    Half of the places go to each label, in order of a hash of the id; what one label leaves the other gets.
    Held-out rows, null ids or labels and texts over max_bytes are never examples; of several labels or
    texts for an id the largest label and the smallest text count.
    """
    learn = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r[0]: r[1] for r in learn.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    # Twice the places, as some texts are missing or too long.
    picked = [learn.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * max_examples) for t in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    texts = docs.where(F.octet_length("text") <= max_bytes).select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    of = [texts.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples) for t in (0, 1)]
    rows = sorted((r["doc_id"], r["toxic"], r["text"]) for r in of[0].unionByName(of[1]).collect())
    both: dict[int, list] = {0: [], 1: []}
    for r in rows:
        both[r[1]].append(r)
    half = max_examples // 2
    few = min(both.values(), key=len)
    take = {t: half if len(few) >= half else (len(v) if v is few else max_examples - len(few)) for t, v in both.items()}
    return sorted(both[0][: take[0]] + both[1][: take[1]]), (counts.get(1, 0) / total if total else 0.0)


def document_frequencies(docs: DataFrame, words: list[bytes]) -> np.ndarray:
    """In how many of all documents each word occurs."""
    number = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_of("toxicity", lambda: None)
        known, out = number.value, Counter()
        for batch in batches:
            for x in batch.column(0):
                own: set[bytes] = set()
                for part in slices(normal(x.as_py())):
                    own |= known.keys() & set(part.split())
                out.update(own)
        yield pa.RecordBatch.from_arrays([pa.array([known[w] for w in out], pa.int32()), pa.array(list(out.values()), pa.int64())], ["word", "n"])

    got = docs.select(F.col("text").cast("string")).mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(words), np.int64)
    df[got.column("word").to_numpy()] = got.column("n").to_numpy()
    return df


def similar_blocks(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """The n examples in an order in which each BLOCK of them is alike: halved again and again along the main axis of their vectors."""
    rng = np.random.default_rng(17)
    out, todo = [], [(np.arange(n), rows, cols, vals)]
    while todo:
        own, r, c, v = todo.pop()
        if len(own) <= BLOCK:
            out.append(own)
            continue
        _, r = np.unique(r, return_inverse=True)
        width = int(r.max()) + 1 if len(r) else 0
        mean = np.bincount(r, v, width) / len(own)
        at = np.full(n, -1)
        at[own] = np.arange(len(own))
        c = at[c]
        axis = rng.normal(size=len(own))
        for _ in range(8):
            # One step of the power iteration on the centred vectors.
            word = np.bincount(r, v * axis[c], width) - mean * axis.sum()
            axis = np.bincount(c, v * word[r], len(own)) - mean @ word
            axis /= np.linalg.norm(axis) or 1.0
        order = np.argsort(axis, kind="stable")
        half = max(1, len(own) // 2 // BLOCK) * BLOCK
        low = np.zeros(len(own), bool)
        low[order[:half]] = True
        for side, some in ((order[half:], ~low), (order[:half], low)):
            mine = some[c]
            todo.append((own[side], r[mine], own[c[mine]], v[mine]))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def relevance(examples: list[tuple[int, int, dict[bytes, int]]]) -> dict[bytes, float]:
    """1 and the chi-square of each word's occurrence against the label, so that words that tell the labels apart outweigh the many that do not."""
    with_word: tuple[Counter, Counter] = (Counter(), Counter())
    sizes = [0, 0]
    for _, label, tf in examples:
        with_word[label].update(tf.keys())
        sizes[label] += 1
    out = {}
    for w in with_word[0].keys() | with_word[1].keys():
        a, b = with_word[1][w], with_word[0][w]
        spread = (a + b) * (sum(sizes) - a - b) * sizes[0] * sizes[1]
        out[w] = 1.0 + (sum(sizes) * (a * sizes[0] - b * sizes[1]) ** 2 / spread if spread else 0.0)
    return out


class Index:
    """Examples as unit vectors of weighted words: postings by word and block, and the largest weight of each of these.

    factors: by which the IDF of a word is multiplied, if not 1.
    """

    def __init__(self, examples: list[tuple[int, int, dict[bytes, int]]], df: dict[bytes, int], n_docs: int, factors: dict[bytes, float] | None = None):
        self.words = {w: i for i, w in enumerate(sorted(df))}
        factors = factors or {}
        idf = {w: float(np.log((1 + n_docs) / (1 + n)) + 1) * factors.get(w, 1.0) for w, n in df.items()}
        self.word_idf = np.array([idf[w] for w in self.words], np.float64)
        rows, cols, vals = [], [], []
        for i, (_, _, tf) in enumerate(examples):
            weights = {w: (1 + np.log(c)) * idf[w] for w, c in tf.items()}
            norm = np.sqrt(sum(v * v for v in weights.values())) or 1.0
            rows += [self.words[w] for w in weights]
            cols += [i] * len(weights)
            vals += [v / norm for v in weights.values()]
        rows, cols, vals = np.array(rows, np.int64), np.array(cols, np.int64), np.array(vals, np.float64)
        order = similar_blocks(rows, cols, vals, len(examples), len(self.words))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids = np.array([examples[i][0] for i in order], np.int64)
        self.labels = np.array([examples[i][1] for i in order], np.int64)
        cols = place[cols]
        self.n_blocks = -(-len(examples) // BLOCK)
        common = np.flatnonzero(np.bincount(rows, minlength=len(self.words)) > COMMON * max(len(examples), BLOCK))
        self.common_of = np.full(len(self.words), -1, np.int64)
        self.common_of[common] = np.arange(len(common))
        wide = self.common_of[rows]
        self.matrix = np.zeros((self.n_blocks, len(common), BLOCK))
        here = wide >= 0
        self.matrix[cols[here] // BLOCK, wide[here], cols[here] % BLOCK] = vals[here]
        self.matrix_top = self.matrix.max(2, initial=0).T.copy()
        rows, cols, vals = rows[~here], cols[~here], vals[~here]
        by = np.lexsort((cols, rows))
        rows, self.example, self.weight = rows[by], cols[by].astype(np.int32), vals[by]
        # A slot is one word in one block.
        block = self.example // BLOCK
        first = np.append(True, (rows[1:] != rows[:-1]) | (block[1:] != block[:-1])) if len(rows) else np.empty(0, bool)
        at = np.flatnonzero(first)
        self.slot_start = np.append(at, len(rows)).astype(np.int64)
        self.slot_block = block[at].astype(np.int32)
        self.slot_top = np.maximum.reduceat(self.weight, at) if len(at) else np.empty(0)
        self.slots = np.searchsorted(rows[at], np.arange(len(self.words) + 1))
        #: Blocks that queries opened, and blocks there were for them.
        self.opened, self.offered = 0, 0

    @staticmethod
    def _spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All numbers of the ranges in turn, and which range each is of."""
        size = end - start
        of = np.repeat(np.arange(len(size)), size)
        return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + start[of], of

    def _sum(self, slot: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of all examples from these slots."""
        at, of = self._spans(self.slot_start[slot], self.slot_start[slot + 1])
        return np.bincount(self.example[at], self.weight[at] * weight[of], self.n_blocks * BLOCK)

    def nearest(self, queries: list[dict[bytes, int]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the examples of the k largest positive cosines (ties: the earlier in the index) and these cosines.

        without: an example that each query leaves out.
        """
        n, n_queries = self.n_blocks * BLOCK, len(queries)
        wide, norm = np.zeros((n_queries, self.matrix.shape[1])), np.ones(n_queries)
        bound, slots = np.zeros((n_queries, self.n_blocks)), []
        for i, tf in enumerate(queries):
            mine = [(x, c) for x, c in zip(map(self.words.get, tf), tf.values(), strict=True) if x is not None]
            if not mine:
                slots.append(None)
                continue
            word, count = np.array(mine, np.int64).T
            weight = (1 + np.log(count)) * self.word_idf[word]
            norm[i] = np.sqrt(weight @ weight)
            at = self.common_of[word]
            here = at >= 0
            wide[i, at[here]] = weight[here]
            word, weight = word[~here], weight[~here]
            slot, of = self._spans(self.slots[word], self.slots[word + 1])
            slots.append((slot, weight[of], self.slot_block[slot]))
            bound[i] = np.bincount(slots[i][2], self.slot_top[slot] * slots[i][1], self.n_blocks)
        if not n or not n_queries:
            return [(np.empty(0, np.int64), np.empty(0))] * n_queries
        bound += wide @ self.matrix_top
        scores = np.zeros((n_queries, n))

        def open_blocks(which: np.ndarray) -> None:
            for b in np.flatnonzero(which.any(0)).tolist():
                asking = np.flatnonzero(which[:, b])
                scores[asking, b * BLOCK : (b + 1) * BLOCK] += wide[asking] @ self.matrix[b]
            for i, mine in enumerate(slots):
                if mine and len(mine[0]):
                    now = np.flatnonzero(which[i][mine[2]])
                    scores[i] += self._sum(mine[0][now], mine[1][now])
            if without:
                scores[np.arange(n_queries), without] = 0

        few = min(self.n_blocks, FIRST * -(-(k + 1) // BLOCK))
        opened = np.zeros((n_queries, self.n_blocks), bool)
        np.put_along_axis(opened, np.argpartition(-bound, few - 1, 1)[:, :few], True, 1)
        open_blocks(opened)
        least = np.partition(scores, n - k, 1)[:, n - k] if k < n else np.zeros(n_queries)
        # Rounding may put a bound a hair below a score it bounds.
        more = ~opened & (bound > 0) & (bound * (1 + 1e-9) >= least[:, None])
        open_blocks(more)
        self.offered += n_queries * self.n_blocks
        self.opened += int(opened.sum() + more.sum())
        out = []
        # Sums of equal texts may differ in their last bits from batch to batch; their order must not.
        cosines = np.minimum(np.round(scores / norm[:, None], 12), 1.0)
        for own in cosines:
            best = np.flatnonzero(own > 0)
            if len(best) > k:
                best = np.flatnonzero(own >= np.partition(own, n - k)[n - k])
                best = best[own[best] > 0]
            best = best[np.lexsort((best, -own[best]))][:k]
            out.append((best, own[best]))
        return out

    def vote(self, best: np.ndarray, cosines: np.ndarray) -> float | None:
        """Share of label 1 among the neighbours, each weighted by the inverse of its distance."""
        if not len(best):
            return None
        w = 1 / (1 - cosines + NEAREST)
        return float((w * self.labels[best]).sum() / w.sum())


def fit_calibration(votes: np.ndarray, labels: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic curve from votes to probabilities; labels are weighted back to the share they have among all rows."""
    if not len(votes) or labels.min() == labels.max():
        return 0.0, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    share = labels.mean()
    weight = np.where(labels == 1, prior / share, (1 - prior) / (1 - share))
    x = np.stack([votes, np.ones(len(votes))], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (labels - p)) - 1e-3 * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


class Model:
    def __init__(self, index: Index, prior: float, counts: list[dict[bytes, int]], k: int):
        self.index, self.prior, self.k = index, prior, k
        votes, labels = [], []
        for a in range(0, len(counts), BATCH):
            part = range(a, min(a + BATCH, len(counts)))
            for i, found in zip(part, index.nearest([counts[i] for i in part], k, list(part)), strict=True):
                v = index.vote(*found)
                if v is not None:
                    votes.append(v)
                    labels.append(int(index.labels[i]))
        self.a, self.b = fit_calibration(np.array(votes), np.array(labels), prior)

    def score(self, texts: list[str | None]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """The score of each text, and its neighbours with their cosines."""
        for best, cosines in self.index.nearest([word_counts(x) for x in texts], self.k):
            v = self.index.vote(best, cosines)
            yield (self.prior if v is None else float(1 / (1 + np.exp(-np.clip(self.a * v + self.b, -30, 30)))), best, cosines)


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_bytes: int = MAX_EXAMPLE_BYTES, k: int = NEIGHBOURS) -> Model:
    examples, prior = sample_examples(docs, labels, max_examples, max_bytes)
    counts = {e[0]: word_counts(e[2]) for e in examples}
    words = sorted(set().union(*counts.values())) if counts else []
    df = document_frequencies(docs, words)
    counted = [(i, t, counts[i]) for i, t, _ in examples]
    index = Index(counted, dict(zip(words, df.tolist(), strict=True)), docs.count(), relevance(counted))
    return Model(index, prior, [counts[i] for i in index.ids.tolist()], k)


def _scored(batches: Iterator[pa.RecordBatch], shared, cut: float, own: list[str], text_col: str, evidence: bool, clean_only: bool) -> Iterator[pa.RecordBatch]:
    cache_of("toxicity", lambda: None)
    model = shared.value
    ids, labels = model.index.ids, model.index.labels
    for batch in batches:
        scores, rows, near, cosines = [], [], [], []
        texts = batch.column(text_col)
        for a in range(0, len(texts), BATCH):
            for i, (one, best, cosine) in enumerate(model.score(texts.slice(a, BATCH).to_pylist()), a):
                if clean_only and one >= cut:
                    continue
                rows.append(i)
                scores.append(one)
                if evidence:
                    near.append(best)
                    cosines.append(cosine)
        kept = batch.select(own)
        kept = kept if len(rows) == batch.num_rows else kept.take(pa.array(rows, pa.int64()))
        more = [pa.array(scores, pa.float64()), pa.array([int(s >= cut) for s in scores], pa.int32())]
        if evidence:
            flat = np.concatenate(near) if near else np.empty(0, np.int64)
            items = pa.StructArray.from_arrays([pa.array(ids[flat]), pa.array(labels[flat].astype("i4")), pa.array(np.concatenate(cosines) if cosines else np.empty(0))], EVIDENCE.elementType.names)
            more.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, near)]), pa.int32()), items))
        yield pa.RecordBatch.from_arrays([*kept.columns, *more], [*own, *ADDED.names[: len(more)]])


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", cut: float = 0.5, keep_text: bool = False, evidence: bool = True, clean_only: bool = False) -> DataFrame:
    """docs (without text_col unless keep_text) with score double, predicted int (score >= cut) and, if asked for, evidence array<struct<doc_id,toxic,cosine>>, nearest first.

    A null or empty text, or one that shares no word with an example, gets the share of label 1 among all
    rows to learn from and no evidence; without any example all do. A text that is itself an example has
    that example among its neighbours, as a copy of it has; only the calibration leaves it out. Repeated
    rows are scored alike; long texts are counted in slices; clean_only returns the rows with a score
    below cut alone; columns of docs that bear one of the three names are replaced; no rows give no rows.
    """
    own = [c for c in docs.columns if c not in (*ADDED.names, "_text") and (keep_text or c != text_col)]
    source = text_col if text_col in own and dict(docs.dtypes)[text_col] == "string" else "_text"
    rows = docs.select(*own) if source in own else docs.select(*own, F.col(text_col).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(rows.schema[c] for c in own), *ADDED.fields[: 3 if evidence else 2]])
    return rows.mapInArrow(lambda b: _scored(b, shared, cut, own, source, evidence, clean_only), schema)
