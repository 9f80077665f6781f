"""Words of many texts at once: Arrow string buffers in, numpy arrays out.

All hashes are 64-bit and depend on the bytes of a word alone, so they agree
between tasks, executors and runs. A hash is a sum of byte values times factors of
their places, where both are random numbers and no powers of one base, so that no
pattern of letters cancels out. It finds equal words; where a result is final, the
operators compare the bytes as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: Separators x20 and x09-x0D; everything else is part of a word.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Digits, ASCII letters and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit moves about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _byte_values() -> np.ndarray:
    return mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)


_factors = np.zeros(0, np.uint64)


def _factor(n: int) -> np.ndarray:
    """A random odd factor for each of the first n places of a word; those of long words are not kept."""
    global _factors
    if len(_factors) >= n:
        return _factors
    made = mix(np.arange(max(n, 1024), dtype=np.uint64) * _ODD + np.uint64(0x243F6A8885A308D3)) | np.uint64(1)
    if len(made) <= CHUNK_BYTES:
        _factors = made
    return made


def spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places at[i], at[i] + 1, ... of size[i] each, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Words:
    """Words of consecutive texts. at: where each text begins; text: index of each word's text, from 0; first: index of each text's first word."""

    data: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, np.uint64)
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) - np.repeat(ends - size, size)
        value = _byte_values()[self.data[place + np.repeat(self.start, size)]]
        if seed:
            value = mix(value + np.uint64(seed) * _ODD)
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value * _factor(int(size.max()))[place], out=total[1:])
        return mix(total[ends] - total[ends - size])

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, which): words of which no two are equal but for what separates them from the next, and for each word its place among them."""
        n = len(self.start)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cells = pa.py_buffer(np.append(self.start, self.end[-1]).astype(np.int32).tobytes())
        coded = pa.BinaryArray.from_buffers(pa.binary(), n, [None, cells, pa.py_buffer(np.ascontiguousarray(self.data))]).dictionary_encode()
        which = coded.indices.to_numpy()
        first = np.zeros(len(coded.dictionary), np.int64)
        first[which[::-1]] = np.arange(n - 1, -1, -1)
        return first, which

    def only(self, which: np.ndarray) -> Words:
        """These words, as words of one text."""
        size = self.end[which] - self.start[which]
        ends = np.cumsum(size)
        none = np.zeros(len(which), np.int64)
        return Words(self.data[spread(self.start[which], size)], np.array([0, ends[-1] if len(ends) else 0]), ends - size, ends, none, np.array([0, len(which)]))

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte values and offsets of a string column; null counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.dtype(np.int64 if large else np.int32)
    offsets = np.frombuffer(col.buffers()[1], kind, len(col) + 1, col.offset * kind.itemsize).astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def scan(col: pa.Array, inside: np.ndarray, lower: bool = True, chunk_bytes: int = CHUNK_BYTES, joints: np.ndarray | None = None) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) for runs of texts of about `chunk_bytes`; a longer text is a run of its own."""
    if not len(col):
        return
    data, offsets = buffers(col)
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + chunk_bytes, "right")) - 1)
        b = min(b, len(offsets) - 1)
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        yield a, b, split(part, at, inside, lower, joints)
        a = b


def split(part: np.ndarray, at: np.ndarray, inside: np.ndarray, lower: bool = True, joints: np.ndarray | None = None) -> Words:
    """`joints` marks bytes by 1 and by 2: a word also ends where the two meet, either way round."""
    n = len(part)
    within = inside[part]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = within[:-1], within[1:]
    before[at[:-1][at[:-1] < n]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    if joints is not None:
        kind = joints[part]
        meet = kind[1:] + kind[:-1] == 3
        before[1:] &= ~meet
        after[:-1] &= ~meet
    start = np.flatnonzero(within & ~before)
    end = np.flatnonzero(within & ~after) + 1
    first = np.searchsorted(start, at)
    text = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(LOWER[part] if lower else part, at, start, end, text, first)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words, by its first word; the last k-1 have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _ODD + h[j : j + n]
    return mix(out)


def take(w: Words, which: np.ndarray) -> pa.BinaryArray:
    """The bytes of the words with these indexes."""
    some = w.only(which)
    offsets = np.append(some.start, some.at[-1]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(some.data.tobytes())])


def same(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether the words i of a and j of b have the same bytes, pair by pair."""
    size = a.end[i] - a.start[i]
    ok = size == b.end[j] - b.start[j]
    pairs = np.flatnonzero(ok)
    size = size[pairs]
    other = a.data[spread(a.start[i[pairs]], size)] != b.data[spread(b.start[j[pairs]], size)]
    ok[pairs[np.repeat(np.arange(len(pairs)), size)[other]]] = False
    return ok


def joined(data: np.ndarray, cuts: np.ndarray) -> pa.StringArray:
    """Texts data[cuts[i]:cuts[i + 1]] without the last byte of each, which is a separator; an empty one stays empty."""
    last = np.zeros(len(data), bool)
    last[(cuts[1:] - 1)[np.diff(cuts) > 0]] = True
    cuts = cuts - np.concatenate([[0], np.cumsum(last)])[cuts]
    return pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data[~last])))
