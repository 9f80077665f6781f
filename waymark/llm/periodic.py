"""Operator 13: maximal periodic runs of words, by the tandem repeats of a suffix tree.

A run is a stretch of consecutive words with smallest period q, at least `least` words and two periods long, that
cannot be made longer. Texts are worked on in parts of about 1 MB: each word is a number that is its own in
each text, each text ends in a mark that occurs once, so that the tree of a part is one tree for each text.

The tree is kept as arrays: suffixes in order, with the length of what neighbours share; an inner node is an interval
of suffixes and a depth. Every node's leaves but those of its largest child are looked at, at most log2(n) times
a leaf (the smaller half), and a leaf i of a node of depth d tells whether i + d or i - d is a leaf of that node too, by its
rank. If so, and if the two go on with different words, a branching tandem repeat of period d ends there.
Each run has just one of these for its smallest period, at its right end: rotating it to the left as far as words
agree gives the run. Repeats of multiples of a period rotate to the same stretch and are merged.

Null and empty texts have no words and no runs. Repeated rows give equal rows. A text is never cut: one of n words takes
about 4 * n * log2(longest repeat) bytes besides, so very long ones take memory in proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import words

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
#: Leaves that are looked at together.
LEAVES = 1 << 20


@dataclass
class Suffixes:
    """Order of the suffixes of `s`, whose last number occurs once. levels[k]: equal for places whose next 2**k numbers are equal."""

    s: np.ndarray
    order: np.ndarray
    rank: np.ndarray
    levels: list[np.ndarray]

    @classmethod
    def of(cls, s: np.ndarray) -> Suffixes:
        n = len(s)
        rank, many = _ranked(s, np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int32))
        levels = [rank]
        while len(many):  # only places that share their rank can still part
            after = np.minimum(many + (1 << (len(levels) - 1)), n - 1)
            rank, many = _ranked(rank[after], many, rank[many].astype(np.int64), rank.copy())
            levels.append(rank)
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        return cls(s, order, rank, levels)

    def shared(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """How many numbers from the places a and b on agree, or with `back` before them."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            if back:
                x, y = a - out - (1 << k), b - out - (1 << k)
                ok = np.flatnonzero((x >= 0) & (y >= 0))
                out[ok[self.levels[k][x[ok]] == self.levels[k][y[ok]]]] += 1 << k
            else:
                out[self.levels[k][a + out] == self.levels[k][b + out]] += 1 << k
        return out


def _ranked(value: np.ndarray, places: np.ndarray, base: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`rank` with that of `places` told apart by `value` within equal `base` (the rank of the first of them), and the places that still share one."""
    order = np.lexsort((value, base))
    v, b = value[order], base[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (b[1:] != b[:-1])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(v)), 0))
    group = np.ones(len(v), bool)
    group[1:] = b[1:] != b[:-1]
    begin = np.maximum.accumulate(np.where(group, np.arange(len(v)), 0))
    rank[places[order]] = b + first - begin
    alone = fresh & np.append(fresh[1:], True)
    return rank, places[order[~alone]]


def _bounds(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of `at` the nearest smaller value of lcp before it and after it; lcp begins and ends with -1."""
    tables = [lcp]
    while 1 << len(tables) < len(lcp):
        t, k = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.minimum(t[:-k], t[k:]))
    value, left, right = lcp[at], at.copy(), at + 1
    for k in range(len(tables) - 1, -1, -1):
        t, n = tables[k], 1 << k
        ok = np.flatnonzero((left >= n) & (t[np.clip(left - n, 0, len(t) - 1)] >= value))
        left[ok] -= n
        ok = np.flatnonzero((right + n <= len(lcp)) & (t[np.clip(right, 0, len(t) - 1)] >= value))
        right[ok] += n
    return left - 1, right


def _small_leaves(s: Suffixes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(place, depth, from, to): leaves of all inner nodes but for those of a node's largest child, with the node's depth and its ranks."""
    lcp = np.full(len(s.s) + 1, -1, np.int64)
    near = np.flatnonzero(s.s[s.order[1:]] == s.s[s.order[:-1]])
    lcp[1:-1] = 0
    lcp[near + 1] = s.shared(s.order[near], s.order[near + 1])
    at = near + 1
    if not len(at):
        return
    left, right = _bounds(lcp, at)
    order = np.lexsort((at, right, left))
    at, left, right = at[order], left[order], right[order]
    new = np.ones(len(at), bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    node = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    # a child before each of a node's inner bounds, and one after the last of them
    begin, end = np.insert(at, first, left[first]), np.insert(at, np.append(first[1:], len(at)), right[first])
    owner = np.insert(node, first, np.arange(len(first)))
    size = end - begin
    heads = first + np.arange(len(first))
    largest = np.maximum.reduceat(size, heads)
    is_largest = size == largest[owner]
    where = np.flatnonzero(is_largest)
    skip = where[np.unique(owner[where], return_index=True)[1]]  # the first of equals
    small = np.ones(len(size), bool)
    small[skip] = False
    begin, size, owner = begin[small], size[small], owner[small]
    depth, low, high = lcp[at[first]], left[first], right[first]
    ends = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + LEAVES, "right")))
        which = np.repeat(owner[a:b], size[a:b])
        yield s.order[words.spread(begin[a:b], size[a:b])], depth[which], low[which], high[which]
        a = b


def _repeats(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of all branching tandem repeats."""
    n, found = len(s.s), []
    for i, d, low, high in _small_leaves(s):
        for first in (i, i - d):
            other = first + d if first is i else first
            ok = np.flatnonzero((other >= 0) & (other < n))
            rank = s.rank[other[ok]]
            ok = ok[(rank >= low[ok]) & (rank < high[ok])]
            start, period = first[ok], d[ok]
            parts = s.s[start + period] != s.s[start + 2 * period]
            found.append(np.stack([start[parts], period[parts]]))
    start, period = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return start, period


def runs_of(s: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the maximal runs of `s`, by start, then period; its last number occurs once."""
    tree = Suffixes.of(s)
    start, period = _repeats(tree)
    end = start + 2 * period
    start = start - tree.shared(start, start + period, back=True)
    long = end - start >= least
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])  # the smallest period of a stretch
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _numbers(w: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the words, with a mark after each text; where each text begins)."""
    n, texts = len(w.start), len(w.at) - 1
    some = w.only(np.arange(n))
    cells = pa.py_buffer(np.append(some.start, some.at[-1]).astype(np.int32).tobytes())
    coded = pa.BinaryArray.from_buffers(pa.binary(), n, [None, cells, pa.py_buffer(np.ascontiguousarray(some.data))]).dictionary_encode()
    which = coded.indices.to_numpy().astype(np.int64)
    distinct = len(coded.dictionary) + 1
    out = np.empty(n + texts, np.int64)
    begin = w.first + np.arange(texts + 1)
    ends = begin[1:] - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = w.text * distinct + which
    out[ends] = np.arange(texts) * distinct + distinct - 1
    return out, begin


def _collapsed(w: words.Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by a space."""
    which = np.flatnonzero(kept)
    size = w.end[which] - w.start[which] + 1
    ends = np.cumsum(size)
    data = np.full(ends[-1] if len(ends) else 0, 0x20, np.uint8)
    data[words.spread(ends - size, size - 1)] = w.data[words.spread(w.start[which], size - 1)]
    count = np.searchsorted(which, w.first)
    return words.joined(data, np.concatenate([[0], ends])[count])


def _found(w: words.Words, least: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(number of words, runs, text without repetitions) of each text."""
    n, texts = len(w.start), len(w.at) - 1
    start = end = period = np.zeros(0, np.int64)
    if n:
        s, begin = _numbers(w)
        start, end, period = runs_of(s, least)
        text = np.searchsorted(begin, start, "right") - 1
        start, end = start - text, end - text  # without the marks of the texts before
        cuts = np.searchsorted(text, np.arange(texts + 1))
    else:
        cuts = np.zeros(texts + 1, np.int64)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, end, -1)
    kept = np.cumsum(step)[:n] == 0
    local = start - w.first[np.repeat(np.arange(texts), np.diff(cuts))]
    fields = [pa.array(x.astype(np.int64)) for x in (local, end - start, period)]
    listed = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.StructArray.from_arrays(fields, fields=[pa.field(f.name, pa.int64(), False) for f in RUN.fields]))
    return pa.array(w.per_text.astype(np.int64)), listed, _collapsed(w, kept)


def runs(df: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """`df` without `text` and with n_words, `runs` (array of start, length, period, in words, by start and period) and `collapsed`:
    the words that are in no run after its first period, joined by a space. Older columns of these names are replaced."""
    made = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    kept = [c for c in df.columns if c not in {text, *(f.name for f in made)}]
    schema = T.StructType([df.schema[c] for c in kept] + made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in words.scan(batch.column(len(kept)), words.SPACED, lower=False):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(kept))), *_found(w, least)], names=schema.names)

    return df.select(*[df[c] for c in kept], df[text]).mapInArrow(run, schema)
