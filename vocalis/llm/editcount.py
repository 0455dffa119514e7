"""Token counts that follow edits: a segment tree over pre-tokens, re-encoding only what an edit touches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalis.llm.shared import cache_of

#: Pre-tokens in a leaf when a tree is built, and how many times as many make it too large.
LEAF, LARGE = 64, 8
CACHE_ENTRIES = 400_000
CACHE_CHARS = 48


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Counter(dict):
    """Token counts of pre-tokens for a byte-level BPE tokenizer, in a bounded cache."""

    def __init__(self, path: str):
        super().__init__()
        import public_tokenizers
        from tokenizers import Tokenizer

        from vocalis.llm.tokens import byte_symbols

        self.model = Tokenizer.from_file(path).model
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.symbols = byte_symbols()

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.symbols)))
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = n
        return n


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    cache_of("counters", _COUNTERS.clear)
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


Leaf = tuple[list[str], list[int]]


class TokenTree:
    """A document's text as leaves of pre-tokens, with the token count of each, below a tree of (characters, tokens) sums.

    The tree is a binary heap over a power-of-two number of leaf slots: an edit rebuilds the leaves it
    touches and then the sums on their paths to the root, nothing else. When edits have made a leaf too
    large, its pre-tokens and all others are dealt to leaves anew, none encoded again.
    """

    def __init__(self, text: str, count: Counter, leaves: list[Leaf] | None = None):
        self.count = count
        self.encoded = 0
        if leaves is None:
            pieces = count.split.findall(text)
            leaves = self._dealt(pieces, [count[p] for p in pieces])
        self._build(leaves)

    @staticmethod
    def _dealt(pieces: list[str], counts: list[int]) -> list[Leaf]:
        return [(pieces[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(pieces), LEAF)]

    def _build(self, leaves: list[Leaf]) -> None:
        leaves = leaves or [([], [])]
        self.slots = 1 << (len(leaves) - 1).bit_length()
        empty = [[] for _ in range(self.slots - len(leaves))]
        self.leaves: list[list[str]] = [list(x) for x, _ in leaves] + empty
        self.counts: list[list[int]] = [list(n) for _, n in leaves] + [[] for _ in empty]
        self.chars = [0] * (2 * self.slots)
        self.tokens = [0] * (2 * self.slots)
        for i in range(self.slots):
            self._leaf(i)
        for i in range(self.slots - 1, 0, -1):
            self._sum(i)

    def _leaf(self, i: int) -> None:
        self.chars[self.slots + i] = sum(map(len, self.leaves[i]))
        self.tokens[self.slots + i] = sum(self.counts[i])

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def _find(self, at: int) -> tuple[int, int, int]:
        """Leaf, pre-token in it, and start of the first pre-token that ends at or after `at`."""
        i, start = 1, 0
        while i < self.slots:
            i *= 2
            if start + self.chars[i] < at:
                start += self.chars[i]
                i += 1
        leaf, k = i - self.slots, 0
        for k, p in enumerate(self.leaves[leaf]):
            if start + len(p) >= at:
                return leaf, k, start
            start += len(p)
        return leaf, len(self.leaves[leaf]), start

    def _before(self, leaf: int, k: int) -> tuple[int, int] | None:
        while k == 0:
            leaf -= 1
            if leaf < 0:
                return None
            k = len(self.leaves[leaf])
        return leaf, k - 1

    def _walk(self, leaf: int, k: int) -> Iterator[tuple[int, int, str]]:
        while leaf < len(self.leaves):
            own = self.leaves[leaf]
            while k < len(own):
                yield leaf, k, own[k]
                k += 1
            leaf, k = leaf + 1, 0

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters [start, end) by new; positions beyond the text are its end.

        The pattern looks one character ahead and never back, so cutting again begins one pre-token
        before the edit and ends where a new boundary past the edit falls on an old one.
        """
        total = self.chars[1]
        start, end = min(start, total), min(max(start, end), total)
        leaf, k, at = self._find(start)
        back = self._before(leaf, k)
        if back:
            leaf, k = back
            at -= len(self.leaves[leaf][k])
        old, pieces, ends, pos = self._walk(leaf, k), [], [], at
        fresh: list[str] = []
        want = 4
        while True:
            for _ in range(want):
                x = next(old, None)
                if x is None:
                    want = 0
                    break
                pieces.append(x)
                pos += len(x[2])
                ends.append(pos)
            if want and (not ends or ends[-1] <= end):
                continue
            line = "".join(x[2] for x in pieces)
            line = line[: start - at] + new + line[end - at :]
            shift = len(new) - (end - start)
            fresh, got, cut = [], at, None
            olds = {e + shift: i for i, e in enumerate(ends) if e > end}
            limit = at + len(line)
            for m in self.count.split.finditer(line):
                fresh.append(m[0])
                got += len(m[0])
                # The last pre-token of the part taken may go on behind it, unless the text ends there.
                if got in olds and (got < limit - 1 or not want):
                    cut = olds[got]
                    break
            if cut is not None:
                pieces = pieces[: cut + 1]
                break
            if not want:
                break
            want *= 2
        self.encoded += len(fresh)
        last = pieces[-1][0] if pieces else leaf
        after = pieces[-1][1] + 1 if pieces else len(self.leaves[leaf])
        whole = self.leaves[leaf][:k] + fresh + self.leaves[last][after:]
        counts = self.counts[leaf][:k] + [self.count[p] for p in fresh] + self.counts[last][after:]
        touched = list(range(leaf, last + 1))
        per = -(-len(whole) // len(touched)) if whole else 0
        for j, i in enumerate(touched):
            self.leaves[i], self.counts[i] = whole[j * per : (j + 1) * per], counts[j * per : (j + 1) * per]
        if per > LARGE * LEAF:
            self._build(self._dealt([p for x in self.leaves for p in x], [n for x in self.counts for n in x]))
            return
        for i in touched:
            self._leaf(i)
        nodes = {(self.slots + i) // 2 for i in touched} - {0}
        while nodes:
            for i in nodes:
                self._sum(i)
            nodes = {i // 2 for i in nodes} - {0}


def _apply(tree: TokenTree, edits: list | None) -> None:
    for e in edits or []:
        if e is not None:
            tree.edit(max(0, e["start"] or 0), max(0, e["end"] or 0), e["new"] or "")


def _edited(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count = counter(path)
    for batch in batches:
        out = []
        for doc, text, edits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            tree = TokenTree(text.as_py() or "", count)
            before = tree.n_tokens
            _apply(tree, edits)
            out.append((doc, before, tree.n_tokens, sum(map(len, tree.leaves)), tree.encoded, tree.chars[1]))
        columns = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "tokens_before", "tokens_after", "pretokens_after", "pretokens_encoded", "chars_after"])


#: A tree as it is kept: its leaves in order.
TREE = T.ArrayType(T.StructType().add("pieces", T.ArrayType(T.StringType())).add("counts", T.ArrayType(T.IntegerType())))
_EDITS = T.ArrayType(T.StructType().add("start", "long").add("end", "long").add("new", "string"))
_KEPT = pa.list_(pa.struct([("pieces", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))]))
_TREE_ROWS = T.StructType().add("doc_id", "long").add("tree", TREE).add("n_tokens", "long").add("pretokens_encoded", "long")


def _kept(rows: list[tuple[object, TokenTree]]) -> pa.RecordBatch:
    trees = [[{"pieces": x, "counts": n} for x, n in zip(t.leaves, t.counts, strict=True) if x] for _, t in rows]
    return pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array(trees, _KEPT), pa.array([t.n_tokens for _, t in rows], pa.int64()), pa.array([t.encoded for _, t in rows], pa.int64())], _TREE_ROWS.names)


def token_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, tree, n_tokens, pretokens_encoded): each document's tree, to be kept in a table and edited there.

    Null and empty texts have a tree without leaves; repeated rows stay; other columns are not read; no rows give no rows.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            yield _kept([(d, TokenTree(x.as_py() or "", count)) for d, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _TREE_ROWS)


def edit_trees(trees: DataFrame, edits_col: str = "edits", tokenizer: str | None = None) -> DataFrame:
    """token_trees' rows with edits applied to the kept trees: no text is cut or encoded beyond what the edits touch.

    pretokens_encoded counts what was encoded again. A null tree is one of an empty text; edits as in count_after_edits.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            out = []
            for doc, kept, edits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                tree = TokenTree("", count, [(x["pieces"], x["counts"]) for x in kept.as_py() or []])
                _apply(tree, edits)
                out.append((doc, tree))
            yield _kept(out)

    return trees.select("doc_id", "tree", F.col(edits_col).cast(_EDITS)).mapInArrow(run, _TREE_ROWS)


def count_after_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", tokenizer: str | None = None) -> DataFrame:
    """doc_id, tokens_before, tokens_after, pretokens_after, pretokens_encoded, chars_after, all long.

    edits_col is array<struct<start,end,new>>: applied in order, each to the text as the ones before left
    it, positions in code points, clipped to the text. pretokens_encoded counts the pre-tokens that the
    edits had encoded again. Null and empty texts have no tokens; null edits, starts, ends and new texts
    are none, 0, 0 and empty; repeated rows stay; other columns are not read; no rows give no rows.
    """
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.col(edits_col).cast(_EDITS))
    return rows.mapInArrow(lambda b: _edited(b, path), "doc_id long, tokens_before long, tokens_after long, pretokens_after long, pretokens_encoded long, chars_after long")


def standard_edits(text: str = "text") -> F.Column:
    """Three edits of any text: 16 characters deleted at a quarter, a phrase inserted at the half, 8 upper-cased at three quarters."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t).cast("long")
    q, h, r = ((n * k / 4).cast("long") for k in (1, 2, 3))

    def one(a, b, new):
        return F.struct(a.alias("start"), b.alias("end"), new.alias("new"))

    # Later edits are placed from the end, so that they hit where they would in the first text.
    return F.array(one(r, r + 8, F.upper(F.substr(t, (r + 1).cast("int"), F.lit(8)))), one(h, h, F.lit(" an inserted passage ")), one(q, q + 16, F.lit("")))
