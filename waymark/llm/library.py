"""Ids by the tokenizers library, each distinct run of non-space characters once."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import words

#: Most runs that one Python worker keeps, at about 50 bytes each. This bounds memory, not results.
KNOWN = 2_000_000
CHUNK_BYTES = 4 << 20
#: Where a mark of these meets a letter or digit of ASCII, the pre-tokenizer cuts as well, and no normal form joins them.
_JOINTS = np.zeros(256, np.uint8)
_JOINTS[list(b".,;:!?")] = 1
_JOINTS[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 2
#: Stands between runs that are encoded together; a run that holds it is encoded on its own.
_BETWEEN = "\x01"
_TOGETHER = 200


class SpacedEncoder:
    """For a tokenizer whose pre-tokenizer drops white space and parts letters and digits from marks, so that what stands between
    two ASCII spaces, or a mark and a word, is encoded on its own.

    Runs are found by 64-bit hashes and told apart by their bytes. With `plain`, strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, plain: bool = False, kind: str = "<u2"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = plain
        self.kind = np.dtype(kind)
        #: whether capitals of ASCII make no difference; special tokens know them, so texts with "<|" keep theirs
        self.lower = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("AZ") == "az"
        self.between = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        #: hashes in order, with the number of the run that has each; by that number, places and sizes of ids in `pool`, and the bytes
        self.hashes, self.run = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0
        none = np.zeros(0, np.int64)
        self.known = words.Words(np.zeros(0, np.uint8), none, none, none, none, none)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _flat(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all runs, number of ids of each)."""
        if len(self.between) != 1 or any(_BETWEEN in x for x in runs):
            ids = self._encode(runs)
            return np.concatenate(ids), np.array([len(x) for x in ids])
        groups = [f" {_BETWEEN} ".join(runs[i : i + _TOGETHER]) for i in range(0, len(runs), _TOGETHER)]
        ids = np.concatenate([np.append(x, self.between[0]).astype(self.kind) for x in self._encode(groups)])
        cuts = np.flatnonzero(ids == self.between[0])
        return ids[ids != self.between[0]], np.diff(cuts, prepend=-1) - 1

    def _learn(self, hashes: np.ndarray, runs: words.Words) -> np.ndarray:
        """Number runs whose different hashes nothing in the table has."""
        texts = [x.decode("utf-8", "replace") for x in words.take(runs, np.arange(len(hashes))).to_pylist()]
        alone = np.array([_BETWEEN in x for x in texts], bool)
        at, size = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for part in (np.flatnonzero(~alone), np.flatnonzero(alone)):
            if len(part):
                flat, size[part] = self._flat([texts[i] for i in part.tolist()])
                at[part] = self.used + np.cumsum(size[part]) - size[part]
                while self.used + len(flat) > len(self.pool):
                    self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
                self.pool[self.used : self.used + len(flat)] = flat
                self.used += len(flat)
        number = len(self.at) + np.arange(len(texts))
        order = np.argsort(hashes)
        place = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.run = np.insert(self.hashes, place, hashes[order]), np.insert(self.run, place, number[order])
        self.at, self.size = np.concatenate([self.at, at]), np.concatenate([self.size, size])
        k, n = self.known, len(self.known.data)
        self.known = words.Words(np.concatenate([k.data, runs.data]), k.at, np.concatenate([k.start, runs.start + n]), np.concatenate([k.end, runs.end + n]), k.text, k.first)
        return number

    def _numbers(self, runs: words.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each run or -1, whether its hash is another run's)."""
        out, taken = np.full(len(h), -1), np.zeros(len(h), bool)
        if len(self.hashes):
            order = np.argsort(h)  # in order, the table is searched from one end to the other
            at = np.minimum(np.searchsorted(self.hashes, h[order]), len(self.hashes) - 1)
            found = self.hashes[at] == h[order]
            hit, number = order[found], self.run[at[found]]
            ok = words.same(runs, hit, self.known, number)
            out[hit[ok]], taken[hit[~ok]] = number[ok], True
        return out, taken

    def _coded(self, w: words.Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, number of ids of each)."""
        first, inverse = w.distinct()
        runs = w.only(first)
        h = runs.hashes()
        if len(self.hashes) + len(h) > KNOWN:
            self.forget()
        number, taken = self._numbers(runs, h)
        new = np.flatnonzero((number < 0) & ~taken)
        if len(new):
            one, again = np.unique(h[new], return_index=True, return_inverse=True)[1:]
            number[new] = self._learn(h[new[one]], runs.only(new[one]))[again]
            number[new[~words.same(runs, new, runs, new[one][again])]] = -1
        size, start, pool = self.size[number], self.at[number], self.pool[: self.used]
        rest = np.flatnonzero(number < 0)
        if len(rest):
            flat = [self._flat([x.decode("utf-8", "replace")])[0] for x in words.take(runs, rest).to_pylist()]
            size[rest] = [len(x) for x in flat]
            start[rest] = len(pool) + np.cumsum(size[rest]) - size[rest]
            pool = np.concatenate([pool, *flat])
        size = size[inverse]
        return pool[words.spread(start[inverse], size)], size

    def encode_column(self, col: pa.Array, end: int) -> list[bytes]:
        """Packed ids of each text, followed by the id `end`."""
        last, out = np.array([end], self.kind).tobytes(), []
        lower = self.lower and not pc.any(pc.match_substring(col, "<|")).as_py()
        for _, _, w in words.scan(col, words.SPACED, lower=lower, chunk_bytes=CHUNK_BYTES, joints=_JOINTS):
            ids, size = self._coded(w)
            packed, cuts = ids.tobytes(), (np.concatenate([[0], np.cumsum(size)])[w.first] * self.kind.itemsize).tolist()
            out += [packed[a:b] + last for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out


_encoders: dict[tuple, SpacedEncoder] = {}


def encoder(path: str, plain: bool = False, kind: str = "<u2") -> SpacedEncoder:
    """The encoder of a worker, which keeps it from task to task."""
    key = path, plain, kind
    if key not in _encoders:
        _encoders[key] = SpacedEncoder(*key)
    return _encoders[key]


def packed_ids(df: DataFrame, tokenizer: str, end: int, text: str = "text", ids: str = "ids", plain: bool = False, kind: str = "<u2", also: tuple[T.StructField, Callable[[pa.RecordBatch], pa.Array]] | None = None) -> DataFrame:
    """`df` with the column `ids` in place of `text`: packed ids of each text and the id `end`. Null counts as empty.

    `also` is one more column and the function that makes it of a batch.
    """
    kept = [c for c in df.columns if c not in (text, ids)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(ids, T.BinaryType())] + ([also[0]] if also else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, plain, kind)
        for batch in batches:
            made = coder.encode_column(batch.column(batch.schema.get_field_index(text)), end)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(made, pa.binary())] + ([also[1](batch)] if also else []), names=schema.names)

    return df.select(*[df[c] for c in kept], df[text]).mapInArrow(run, schema)
