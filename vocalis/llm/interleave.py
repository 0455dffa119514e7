"""Shard Burrows-Wheeler transforms merged by interleave refinement, in one process.

The method as it is published: the interleave of the shards' rows is refined one symbol a round by a stable
pass over the merged transform, and the round in which two neighbours part is the length of their common
prefix. `bwtmerge` uses hashes of prefixes instead, for what a pass over all rows for each of 100 symbols costs
(figures in the README); the tests hold the two against each other.
"""

from __future__ import annotations

import numpy as np

#: A document's end sorts before every byte; bytes are symbols 1 to 256.
END = 0


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as symbols, each behind it its end, and the first place of each text."""
    parts = [np.append(np.frombuffer(t, np.uint8).astype(np.uint16) + 1, np.uint16(END)) for t in texts]
    sizes = np.cumsum([0, *map(len, parts)])
    return np.concatenate(parts) if parts else np.empty(0, np.uint16), sizes[:-1]


def shard_order(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Places of a shard's suffixes in order of their first `depth` symbols, what follows a text's end not counting; ties by place."""
    n = len(data)
    at = np.arange(n)
    end = np.repeat(np.append(starts[1:], n) - 1, np.diff(np.append(starts, n)))
    keys = [np.where(at + k <= end, data[np.minimum(at + k, n - 1)], END) for k in range(min(depth, int((end - at).max(initial=0)) + 1))]
    return np.lexsort(keys[::-1]) if keys else at


def transform(data: np.ndarray, starts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The symbol before each suffix in order; before a text's first, its end."""
    before = np.append(data[-1:], data[:-1])
    before[starts] = END
    return before[order]


def interleave(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the merged rows the shard each comes from, and how many symbols it has in common with the row before, up to `depth`.

    shards: transforms whose rows are in order of at least `depth` symbols.
    """
    sizes = np.array([len(s) for s in shards])
    offset = np.cumsum(sizes) - sizes
    merged = np.concatenate(shards) if shards else np.empty(0, np.uint16)
    n = len(merged)
    source = np.repeat(np.arange(len(shards)), sizes)
    common = np.full(n, depth)
    block = np.zeros(n, np.int64)
    for length in range(1, depth + 1):
        # The next row of each shard in the interleave's order gives its symbol: a pass over the whole transform.
        row = np.empty(n, np.int64)
        for s in range(len(shards)):
            mine = source == s
            row[mine] = offset[s] + np.arange(sizes[s])
        symbol = merged[row]
        order = np.argsort(symbol, kind="stable")
        # Ends have no suffix of their own before them: they keep the shards' order, and are rows of one symbol.
        ends = int((symbol == END).sum())
        source = np.concatenate([np.sort(source[order[:ends]], kind="stable"), source[order[ends:]]])
        behind, last = block[order], symbol[order]
        new = np.append(True, (last[1:] != last[:-1]) | (behind[1:] != behind[:-1])) if n else np.empty(0, bool)
        new[1:ends] = False
        common[new & (common == depth)] = length - 1
        block = np.cumsum(new)
    if n:
        common[0] = 0
    return source, common


def later_copies(texts: list[bytes], window: int, per_shard: int) -> list[np.ndarray]:
    """For each text which bytes a string of `window` bytes that also starts earlier covers, from the merged intervals."""
    groups = [texts[i : i + per_shard] for i in range(0, len(texts), per_shard)]
    data, starts = zip(*map(symbols, groups), strict=True) if groups else ((), ())
    orders = [shard_order(d, s, window) for d, s in zip(data, starts, strict=True)]
    source, common = interleave([transform(d, s, o) for d, s, o in zip(data, starts, orders, strict=True)], window)
    base = np.cumsum([0, *map(len, data)])
    place = np.empty(len(source), np.int64)
    for i, o in enumerate(orders):
        place[source == i] = base[i] + o
    whole = np.concatenate([*data, np.empty(0, np.uint16)])
    begins = np.concatenate([*(b + s for b, s in zip(base, starts, strict=False)), [len(whole)]]).astype(np.int64)
    ends = np.repeat(begins[1:] - 1, np.diff(begins))
    fits = np.arange(len(whole)) + window <= ends
    # An interval: rows that have a window in common; all but the earliest of its places are later copies.
    name = np.cumsum(common < window) - 1
    first = np.full(int(name.max(initial=-1)) + 1, len(whole))
    np.minimum.at(first, name, place)
    later = place[(place != first[name]) & fits[place]] if len(place) else place
    step = np.zeros(len(whole) + 1, np.int64)
    np.add.at(step, later, 1)
    np.add.at(step, later + window, -1)
    gone = np.cumsum(step[:-1]) > 0
    return [gone[a : b - 1] for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
