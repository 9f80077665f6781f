"""Similarity of names from 0 to 100, by published definitions, over arrays of pairs.

All scores rest on the Indel ratio, 200 * LCS(a, b) / (len(a) + len(b)). The rows of all subsequences are computed side by side, one
64-bit lane for each pair (or for each window of a pair), a character of all second strings at a time. Inputs are in normal form.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lanes that are computed together, and cells of the table of their characters.
LANES, CELLS = 1 << 18, 1 << 23
WIDTH = 64


class Strings:
    """Strings as numbers of their characters, one after the other."""

    def __init__(self, values: list[str]):
        self.values = values
        self.size = np.array([len(v) for v in values], np.int64)
        self.at = np.cumsum(self.size) - self.size
        flat = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), "<u4")
        known, self.code = np.unique(flat, return_inverse=True)
        self.letters = max(1, len(known))


def _spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places at[i], at[i] + 1, ... of size[i] each."""
    ends = np.cumsum(size)
    return np.repeat(at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _long_common(a: np.ndarray, b: np.ndarray) -> int:
    """The longest common subsequence of two strings of any length, a bit of one number for each character of the first."""
    where: dict[int, int] = {}
    for i, c in enumerate(a.tolist()):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b.tolist():
        hit = row & where.get(c, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & full).bit_count()


def common(s: Strings, pattern: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pattern (number of a string) and the characters at[i] to at[i] + size[i]."""
    out = np.zeros(len(pattern), np.int64)
    wide = s.size[pattern] > WIDTH
    for i in np.flatnonzero(wide).tolist():
        p = pattern[i]
        out[i] = _long_common(s.code[s.at[p] : s.at[p] + s.size[p]], s.code[at[i] : at[i] + size[i]])
    rest = np.flatnonzero(~wide & (size > 0) & (s.size[pattern] > 0))
    rest = rest[np.lexsort((pattern[rest], -size[rest]))]  # the longest first, so that those that go on are a part without gaps
    for a in range(0, len(rest), LANES):
        _lanes(s, rest[a : a + LANES], pattern, at, size, out)
    return out


def _lanes(s: Strings, which: np.ndarray, pattern: np.ndarray, at: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
    own, row_of = np.unique(pattern[which], return_inverse=True)
    if len(own) * s.letters > CELLS and len(which) > 1:
        for part in np.array_split(which, 2):
            _lanes(s, part, pattern, at, size, out)
        return
    length = s.size[own]
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    table = np.zeros(len(own) * s.letters, np.uint64)
    np.bitwise_or.at(table, np.repeat(np.arange(len(own)) * s.letters, length) + s.code[_spread(s.at[own], length)], np.uint64(1) << place.astype(np.uint64))
    base, text, steps = row_of * s.letters, at[which], size[which]
    full = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(WIDTH) - length.astype(np.uint64))[row_of]
    row = full.copy()
    live = np.searchsorted(-steps, -np.arange(1, steps[0] + 1), "right")  # how many have a character at each step
    for t, n in enumerate(live.tolist()):
        hit = row[:n] & table[base[:n] + s.code[text[:n] + t]]
        row[:n] = (row[:n] + hit) | (row[:n] - hit)
    out[which] = length[row_of] - np.bitwise_count(row & full)


def ratio(s: Strings, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    m, n = s.size[i], s.size[j]
    short, long = np.where(m <= n, i, j), np.where(m <= n, j, i)
    return np.where(m + n == 0, 100.0, 200.0 * common(s, short, s.at[long], s.size[long]) / np.maximum(m + n, 1))


def partial_ratio(s: Strings, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The best ratio of the shorter string against a window of the longer one, full windows and shorter ones at both ends; at equal lengths, either way."""
    swap = s.size[i] > s.size[j]
    short, long = np.where(swap, j, i), np.where(swap, i, j)
    out = np.where(s.size[long] == 0, 100.0, 0.0)
    some = np.flatnonzero(s.size[short] > 0)
    lanes = np.cumsum(s.size[long[some]] + s.size[short[some]])
    cuts = np.searchsorted(lanes, np.arange(0, (lanes[-1] if len(lanes) else 0) + LANES, LANES))
    for part in np.split(some, np.unique(cuts)[1:-1]) if len(some) else ():
        out[part] = _windows(s, short[part], long[part])
        again = part[(s.size[short[part]] == s.size[long[part]]) & (out[part] < 100)]
        if len(again):
            out[again] = np.maximum(out[again], _windows(s, long[again], short[again]))
    return out


def _windows(s: Strings, short: np.ndarray, long: np.ndarray) -> np.ndarray:
    m, n = s.size[short], s.size[long]
    count = n + m - 1  # a window from each place of the longer string, as far as it goes, and its beginnings shorter than the shorter one
    begin = np.cumsum(count) - count
    which = np.repeat(np.arange(len(m)), count)
    k = np.arange(len(which)) - begin[which]
    head = k >= n[which]
    start, width = np.where(head, 0, k), np.where(head, k - n[which] + 1, np.minimum(m[which], n[which] - k))
    made = 200.0 * common(s, short[which], s.at[long][which] + start, width) / (m[which] + width)
    return np.maximum.reduceat(made, begin)


class Pairs:
    """Pairs of strings and their scores. Each distinct string is sorted and split into words once."""

    def __init__(self, a: list[str], b: list[str]):
        number: dict[str, int] = {}
        self.i, self.j = (np.array([number.setdefault(x, len(number)) for x in side], np.int64) for side in (a, b))
        self.raw = list(number)
        words = [x.split() for x in self.raw]
        self.words = [frozenset(w) for w in words]
        self.sorted = [" ".join(sorted(w)) for w in words]
        self.distinct = [" ".join(sorted(w)) for w in self.words]
        self.strings = Strings(self.raw + self.sorted + self.distinct)
        self.m, self.n = self.strings.size[self.i], self.strings.size[self.j]

    def _of(self, work, form: int, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        shift = form * len(self.raw)
        return work(self.strings, self.i[some] + shift, self.j[some] + shift)

    def token_sort(self) -> np.ndarray:
        return self._of(ratio, 1)

    def partial(self) -> np.ndarray:
        return self._of(partial_ratio, 0)

    def scaled_partial(self, beyond: np.ndarray | None = None) -> np.ndarray:
        """The partial ratio times the share of the longer string that the shorter one covers; 0 where that cannot be beyond `beyond`."""
        long = np.maximum(self.m, self.n)
        share = np.minimum(self.m, self.n) / np.maximum(long, 1)
        some = np.flatnonzero((long > 0) & ((share * 100.0 > beyond) if beyond is not None else True))
        out = np.zeros(len(self.i))
        out[some] = self._of(partial_ratio, 0, some) * share[some]
        return out

    def strict(self) -> np.ndarray:
        """For words of an address: a part of a name never scores like the name."""
        whole = self.token_sort()
        return np.maximum(whole, self.scaled_partial(whole))

    def _sets(self) -> tuple[np.ndarray, np.ndarray]:
        """(token set ratio, the best partial ratio of the words in order, and of those that are in one string alone)."""
        set_, part = np.zeros(len(self.i)), np.zeros(len(self.i))
        shared = np.array([not self.words[i].isdisjoint(self.words[j]) for i, j in zip(self.i.tolist(), self.j.tolist(), strict=True)], bool)
        apart = np.flatnonzero(~shared)
        length = self.strings.size[2 * len(self.raw) :]
        m, n = length[self.i[apart]], length[self.j[apart]]
        moved = m + n - 2 * self._common_distinct(apart)
        set_[apart] = np.where((m == 0) | (n == 0), 0.0, 100.0 - 100.0 * moved / np.maximum(m + n, 1))
        part[apart] = np.maximum(self._of(partial_ratio, 1, apart), self._of(partial_ratio, 2, apart))
        both = np.flatnonzero(shared)
        part[both] = 100.0
        if len(both):
            sides = [(self.words[i] & self.words[j], self.words[i] - self.words[j], self.words[j] - self.words[i]) for i, j in zip(self.i[both].tolist(), self.j[both].tolist(), strict=True)]
            core = np.array([len(" ".join(x)) for x, _, _ in sides], np.int64)
            rest = Strings([" ".join(sorted(x)) for k in (1, 2) for x in (side[k] for side in sides)])
            left, right = np.arange(len(both)), np.arange(len(both)) + len(both)
            x, y = rest.size[left], rest.size[right]
            with_x, with_y = core + x + (x > 0), core + y + (y > 0)
            short, long = np.where(x <= y, left, right), np.where(x <= y, right, left)
            moved = x + y - 2 * common(rest, short, rest.at[long], rest.size[long])
            # with words left on both sides, those shared are followed by a space on both
            made = 100.0 - 100.0 * moved / (core + x + 1 + core + y + 1)
            for w in (with_x, with_y):
                made = np.maximum(made, 100.0 - 100.0 * (w - core) / (core + w))
            set_[both] = np.where((x == 0) | (y == 0), 100.0, made)
        return set_, part

    def _common_distinct(self, some: np.ndarray) -> np.ndarray:
        s, shift = self.strings, 2 * len(self.raw)
        i, j = self.i[some] + shift, self.j[some] + shift
        short, long = np.where(s.size[i] <= s.size[j], i, j), np.where(s.size[i] <= s.size[j], j, i)
        return common(s, short, s.at[long], s.size[long])

    def weighted(self) -> np.ndarray:
        best, some = self._of(ratio, 0), (self.m > 0) & (self.n > 0)
        apart = np.maximum(self.m, self.n) / np.maximum(np.minimum(self.m, self.n), 1)
        set_, part = self._sets()
        near = np.maximum(best, 0.95 * np.maximum(self.token_sort(), set_))
        scale = np.where(apart < 8, 0.9, 0.6)
        far = np.maximum(best, scale * self.partial())
        far = np.maximum(far, (0.95 * scale) * part)
        return np.where(some, np.where(apart < 1.5, near, far), 0.0)

    def lenient(self) -> np.ndarray:
        """For names that were typed on purpose."""
        return np.maximum(np.maximum(self.weighted(), self.token_sort()), self.scaled_partial())


SCORERS = {"strict": Pairs.strict, "lenient": Pairs.lenient, "token_sort": Pairs.token_sort, "partial": Pairs.partial, "scaled_partial": Pairs.scaled_partial, "weighted": Pairs.weighted}


def scores(scorer: str, a: list[str], b: list[str]) -> np.ndarray:
    """The score of each pair, each distinct one once."""
    distinct = {pair: k for k, pair in enumerate(dict.fromkeys(zip(a, b, strict=True)))}
    made = SCORERS[scorer](Pairs([x for x, _ in distinct], [y for _, y in distinct])) if distinct else np.zeros(0)
    return made[np.array([distinct[pair] for pair in zip(a, b, strict=True)], np.int64)]


def score(scorer: str, a: Column | str, b: Column | str) -> Column:
    """The score of two columns in normal form, by Arrow batches; null counts as empty."""

    @F.pandas_udf(T.DoubleType())
    def scored(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(scores(scorer, x.fillna("").tolist(), y.fillna("").tolist()))

    return scored(a, b)
