"""Operator 3: benchmark decontamination by winnowing.

A fingerprint is the least hash of K consecutive words within each run of W such
hashes. Two texts that share K + W - 1 = 13 words share a fingerprint inside them, so
joining the fingerprints of documents and benchmark finds every shared window; hits
are then extended to whole windows. Items of fewer than 13 words are one window each,
looked up at each place by the hash of that many words.

The benchmark is read in blocks of bounded size. The documents pass each block in
turn and are never shuffled, whatever their sources or repeats.

Hashes only find places: a window counts where all its words have the bytes of the item's.

Null and empty texts have no words, no hits and no items. Repeated items all count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .scratch import save

WINDOW = 13
K = 6
#: Bytes of benchmark text that one block may hold; the index of a block takes about three times as much.
BLOCK_BYTES = 8 << 20


class Index:
    """Windows of one block of the benchmark, with the items that hold them."""

    def __init__(self, texts: list[tuple[str, str | None]]):
        self.items = [i for i, _ in texts]
        found: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = {}
        prints, parts, before, bytes_before = [np.zeros(0, np.uint64)], [], 0, 0
        col = pa.array([t or "" for _, t in texts], pa.string())
        for a, _, w in words.scan(col, words.ALNUM):
            h = w.hashes()
            for i, (f, n) in enumerate(zip(w.first[:-1].tolist(), w.per_text.tolist(), strict=True)):
                own = h[f : f + n]
                if n >= WINDOW:
                    prints.append(words.runs(own, K)[chosen(words.runs(own, K), WINDOW - K + 1)])
                if n:
                    windows, first = np.unique(words.runs(own, min(n, WINDOW)), return_index=True)
                    found.setdefault(min(n, WINDOW), []).append((windows, (first + f + before).astype(np.int32), a + i))
            parts.append((w.data, w.start + bytes_before, w.end + bytes_before))
            before, bytes_before = before + len(w.start), bytes_before + len(w.data)
        data, start, end = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint8), *[np.zeros(0, np.int64)] * 2)
        none = np.zeros(0, np.int64)
        #: the words of all items, in turn
        self.words = words.Words(data, none, start, end, none, none)
        self.prints = np.unique(np.concatenate(prints))
        #: by length: window hashes in order, the item of each and its first word (a window of several items is there several times)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, held in found.items():
            hashes = np.concatenate([x for x, _, _ in held])
            owner = np.concatenate([np.full(len(x), i, np.int32) for x, _, i in held])
            order = np.argsort(hashes, kind="stable")
            self.windows[n] = hashes[order], owner[order], np.concatenate([f for _, f, _ in held])[order]


def chosen(grams: np.ndarray, w: int) -> np.ndarray:
    """Places whose hash is the least of some run of w (all of them at a tie)."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = grams[:n].copy()
    for j in range(1, w):
        np.minimum(low, grams[j : j + n], out=low)
    high = np.zeros(len(grams), np.uint64)
    for j in range(w):
        np.maximum(high[j : j + n], low, out=high[j : j + n])
    return np.flatnonzero(high == grams)


def _among(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    return sorted_values[np.minimum(at, len(sorted_values) - 1)] == x


def _matches(w: words.Words, index: Index) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, first words, hashes) of the windows of the block that occur in these texts."""
    h, out = w.hashes(), []
    last = w.first[w.text + 1] if len(w.text) else np.zeros(0, np.int64)
    if WINDOW in index.windows and len(h) >= WINDOW:
        grams = words.runs(h, K)
        at = chosen(grams, WINDOW - K + 1)
        at = at[_among(index.prints, grams[at])]
        starts = np.unique((at[:, None] - np.arange(WINDOW - K + 1)).reshape(-1))
        starts = starts[starts >= 0]
        starts = starts[starts + WINDOW <= last[starts]]
        if len(starts):
            own = words.runs(h[starts[:, None] + np.arange(WINDOW)].reshape(-1), WINDOW)[::WINDOW]
            out.append((WINDOW, starts, own))
    for n in index.windows:
        if n < WINDOW and len(h) >= n:
            own = words.runs(h, n)
            starts = np.flatnonzero(_among(index.windows[n][0], own))
            starts = starts[starts + n <= last[starts]]
            out.append((n, starts, own[starts]))
    return [(n, s[ok], x[ok]) for n, s, x in out for ok in [_among(index.windows[n][0], x)]]


def _holders(w: words.Words, index: Index, n: int, starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, item) of all windows of n words that items hold, word for word."""
    known, owner, place = index.windows[n]
    a, b = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
    at, starts = words.spread(a, b - a), np.repeat(starts, b - a)
    ok = np.ones(len(at), bool)
    for i in range(0, len(at), 4096):  # bounds the bytes compared at once
        cells = (starts[i : i + 4096, None] + np.arange(n)).reshape(-1), (place[at[i : i + 4096], None] + np.arange(n)).reshape(-1)
        ok[i : i + 4096] = words.same(w, cells[0], index.words, cells[1]).reshape(-1, n).all(1)
    return starts[ok], owner[at[ok]]


def _pass(df: DataFrame, text: str, shared, first: bool) -> DataFrame:
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_words", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))]
    names = [f.name for f in added]
    kept = [c for c in df.columns if c not in names] if first else df.columns
    schema = T.StructType([df.schema[c] for c in kept if c not in names] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(text))
            for a, b, w in words.scan(col, words.ALNUM):
                n, per_text = b - a, w.per_text
                mark = np.zeros(len(w.start) + 1, np.int64)
                held: dict[int, set[int]] = {}
                for size, found, hashes in _matches(w, index):
                    starts, item = _holders(w, index, size, found, hashes)
                    np.add.at(mark, starts, 1)
                    np.add.at(mark, starts + size, -1)
                    for pair in np.unique(w.text[starts] * len(index.items) + item).tolist():
                        held.setdefault(pair // len(index.items), set()).add(pair % len(index.items))
                hit = np.cumsum(mark)[:-1] > 0
                items = [[index.items[i] for i in held.get(t, ())] for t in range(n)]
                if not first:
                    for t, old in enumerate(batch.column(batch.schema.get_field_index("hit_words")).slice(a, n).to_pylist()):
                        before = np.unpackbits(np.frombuffer(old, np.uint8), count=per_text[t]).astype(bool)
                        hit[w.first[t] : w.first[t + 1]] |= before
                    items = [x + (y or []) for x, y in zip(items, batch.column(batch.schema.get_field_index("items")).slice(a, n).to_pylist(), strict=True)]
                n_hit = np.bincount(w.text[hit], minlength=n)
                bits = [np.packbits(hit[w.first[t] : w.first[t + 1]]).tobytes() if n_hit[t] else b"\0" * -(-int(per_text[t]) // 8) for t in range(n)]
                made = [pa.array(per_text, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(bits, pa.binary()), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))]
                old = [batch.column(i).slice(a, n) for i, c in enumerate(batch.schema.names) if c not in names]
                yield pa.RecordBatch.from_arrays(old + made, names=schema.names)

    return df.select(*[df[c] for c in kept]).mapInArrow(run, schema)


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", percent: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`df` with n_words, n_hit, hit_words (a bit for each word), items (ids as strings, sorted) and contaminated.

    Older columns with these names are replaced. A document is contaminated if it has a hit word and at
    least `percent` per cent of its words are hit.
    """
    spark = df.sparkSession
    known = save(benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).distinct())
    blocks = max(1, -(-int(known.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    out = df
    for i in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i).collect()
        shared = spark.sparkContext.broadcast(Index([(r.item, r.text) for r in rows]))
        out = _pass(out, text, shared, i == 0)
        if i + 1 < blocks:  # one block is in memory at a time
            out = save(out)
            shared.unpersist()
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent))
