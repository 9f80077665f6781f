"""Operator 6: language-model scores by prediction by partial matching.

A text is its words with one space after each and an end; it is coded byte by byte. The context
of a byte is the up to six bytes before it, over spaces back to the start of the text. The trie of
contexts is a table of grams, (context, byte) with their counts, for all orders from six to none.

Counts are kept as partial matching keeps them with update exclusion: a byte counts in a shorter context only
where it is new in the longer one. A context with t counts of d distinct bytes takes DISCOUNT from each
count; an escape to the next shorter context has what this frees, DISCOUNT * d / t, less what that context would
give to bytes that are excluded because the longer one has them, and that part goes back to just these bytes. So a byte
has (n - DISCOUNT) / t + DISCOUNT * d / t * (its probability in the shorter context), n counting as DISCOUNT
where it is unseen, and an escape with exclusion and this recursion are one (a test compares them). A context never seen
hands down at no cost. Below order none all bytes are equally likely.

A gram of a text is scored once, with its count. Words and grams that are frequent enough to fit in a bounded broadcast
are looked up in place, all others in a shuffled join; hot ones never reach the join. Words are told apart by two
64-bit hashes: should two words agree in the first, all are hashed anew.

Null and empty texts are the end alone. With no training text, every byte costs as much as any
other. Repeated rows are scored each by itself, from its own text, and each of them teaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .scratch import save

ORDER, DISCOUNT = 6, 0.85
#: Most words and grams that are broadcast (12 and 96 MB at most); beyond, the rarer ones are joined.
HEAD_WORDS, HEAD_GRAMS = 1 << 19, 6 << 20
#: Ends a word, and stands before it; ends a text. Neither byte occurs in a word.
SPACE, END = 0x20, 0x0A
#: Distinct grams that a task adds up before it hands them on.
HELD = 1 << 21
_BITS = 8 * (ORDER + 1)


def _vocabulary(docs: DataFrame, text: str, train: str, seed: int) -> DataFrame:
    """(hash, n_train, n, low, high): every distinct word, how often it occurs in training texts and in all; low and high are the
    bounds of a second hash, which differ if two words have one hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def handed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            h, other, n_train, n = map(np.concatenate, zip(*parts, strict=True))
            order = np.lexsort((other, h))  # words with one hash stay apart by the other
            h, other, n_train, n = h[order], other[order], n_train[order], n[order]
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (other[1:] != other[:-1]))) if len(h) else np.zeros(0, np.int64)
            return h[first], other[first], *(np.add.reduceat(x, first) if len(first) else x for x in (n_train, n))

        def made(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in handed(parts)], names=["hash", "other", "n_train", "n"])

        for batch in batches:
            learn = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for a, b, w in words.scan(batch.column(0), words.SPACED):
                first, which = w.distinct()
                some = w.only(first)
                n_train = np.bincount(which, weights=learn[a:b][w.text], minlength=len(first)).astype(np.int64)
                held.append((some.hashes(seed).view(np.int64), some.hashes(seed + 1).view(np.int64), n_train, np.bincount(which, minlength=len(first)).astype(np.int64)))
                size += len(first)
                if size >= HELD // 4:
                    held = [handed(held)]
                    size = len(held[0][0])
                    if size >= HELD // 8:
                        yield made(held)
                        held, size = [], 0
        if held:
            yield made(held)

    found = docs.select(text, train).mapInArrow(run, "hash bigint, other bigint, n_train bigint, n bigint")
    return found.groupBy("hash").agg(F.sum("n_train").alias("n_train"), F.sum("n").alias("n"), F.min("other").alias("low"), F.max("other").alias("high"))


def _distinct_hashes(docs: DataFrame) -> tuple[DataFrame, int]:
    """The vocabulary of (text, train), saved, and the first seed under which no two words have one hash."""
    for seed in range(0, 16, 2):
        found = save(_vocabulary(docs, "text", "train", seed))
        if found.where("low != high").isEmpty():
            return found.select("hash", "n_train", "n"), seed
    raise RuntimeError("words have equal hashes under every seed")


def _text_keys(w: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, key): a row for each byte of each text: its words, a space after each, and its end.

    A key holds the order above the context and the byte, in as many bytes as these need.
    """
    size = w.end - w.start
    n = len(w.first) - 1
    begin = np.concatenate([[0], np.cumsum(size + 1)])[w.first] + 2 * np.arange(n + 1)
    padded = np.full(begin[-1], SPACE, np.uint8)
    at = np.concatenate([[0], np.cumsum(size)])[:-1] + np.arange(len(size)) + 2 * w.text + 1
    padded[words.spread(at, size)] = w.data[words.spread(w.start, size)]
    padded[begin[1:] - 1] = END
    which = np.repeat(np.arange(n), np.diff(begin))
    within = np.arange(len(which)) - begin[which]
    x = padded.astype(np.uint64)
    packed = x.copy()
    for k in range(1, min(ORDER, len(x) - 1) + 1):
        packed[k:] |= x[:-k] << np.uint64(8 * k)
    early = np.flatnonzero(within < ORDER)  # what stands before the text is not its context
    packed[early] &= (np.uint64(1) << (np.uint64(8) * (within[early] + 1).astype(np.uint64))) - np.uint64(1)
    real = within > 0
    return which[real], (np.minimum(within, ORDER).astype(np.uint64)[real] << np.uint64(_BITS) | packed[real]).view(np.int64)


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and the sums of the counts of each."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(c[order], first) if len(first) else np.zeros(0, np.int64) for c in counts)


def _tallied(key: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each is learned; a sort of the keys with that mark as their last bit, which needs no inverse."""
    marked = np.sort(key << 1 | learn)
    key = marked >> 1
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(marked & 1, first) if len(first) else np.zeros(0, np.int64)


def _text_grams(docs: DataFrame) -> DataFrame:
    """(key, n): the grams with the longest contexts in the texts of `docs` (text, train), and how often each occurs in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def handed() -> Iterator[pa.RecordBatch]:
            key, n = _summed(np.concatenate(keys), np.concatenate(counts))
            yield from (pa.RecordBatch.from_arrays([pa.array(key[i : i + 100_000]), pa.array(n[i : i + 100_000])], names=["key", "n"]) for i in range(0, len(key), 100_000))

        for batch in batches:
            learn = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, w in words.scan(batch.column(0), words.SPACED):
                text, key = _text_keys(w)
                key, n = _tallied(key, learn[a:b][text])
                keys.append(key)
                counts.append(n)
                held += len(key)
                if held >= HELD:
                    key, n = _summed(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, held = [key], [n], len(key)
                    if held >= HELD // 2:
                        yield from handed()
                        keys, counts, held = [], [], 0
        if keys:
            yield from handed()

    # tasks have added up what they can: rows are dealt as they are, and added once, behind the shuffle
    return docs.select("text", "train").mapInArrow(run, "key bigint, n bigint").repartition("key").groupBy("key").agg(F.sum("n").alias("n"))


def _lists(owner: np.ndarray, key: np.ndarray, n: int) -> list[pa.ListArray]:
    """For each of n owners its distinct keys, and how often each occurs."""
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    fresh = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(fresh, len(key)))
    offsets = pa.array(np.searchsorted(owner[fresh], np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (key[fresh], times)]


def _shorter(key: str, order: int) -> Column:
    """The gram of this order with the farthest byte of its context taken away."""
    return F.lit((order - 1) << _BITS).bitwiseOR(F.col(key).bitwiseAND((1 << (8 * order)) - 1))


def _gram_scores(grams: DataFrame) -> DataFrame:
    """(key, n, score) of all grams: log10 of the probability of the byte in its context.

    Each order holds the grams that are as long as that, and the shorter forms of those above it, which count one each.
    """
    order = F.shiftright("key", _BITS)
    levels = {ORDER: grams.where(order == ORDER)}
    for k in range(ORDER - 1, -1, -1):
        above = levels[k + 1].select(_shorter("key", k + 1).alias("key"), (F.col("n") > 0).cast("long").alias("n"))
        levels[k] = save(grams.where(order == k).union(above).groupBy("key").agg(F.sum("n").alias("n")))
    out, below = [], None
    for k in range(ORDER + 1):
        seen = levels[k].where("n > 0").groupBy(F.shiftright("key", 8).alias("ctx")).agg(F.sum("n").alias("t"), F.count("*").alias("d"))
        rows = levels[k].withColumn("ctx", F.shiftright("key", 8)).join(seen, "ctx", "left")
        if below is None:
            rows = rows.withColumn("p", F.lit(1 / 256))
        else:
            rows = rows.withColumn("shorter", _shorter("key", k)).join(below.select(F.col("key").alias("shorter"), "p"), "shorter")
        freed = F.coalesce(DISCOUNT * F.col("d") / F.col("t"), F.lit(1.0))
        own = F.coalesce(F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("t"), F.lit(0.0))
        below = save(rows.select("key", "n", (own + freed * F.col("p")).alias("p")))
        out.append(below if k == ORDER else below.select("key", "p").join(grams.where(order == k), "key").select("key", "n", "p"))
    scored = out[0]
    for x in out[1:]:
        scored = scored.union(x)
    return scored.select("key", "n", F.log10("p").alias("score"))


def _head(df: DataFrame, n: str, most: int, columns: list[str]) -> dict[str, np.ndarray]:
    """Columns of the rows with the largest `n`, at most `most` of them, in order of the first column."""
    bin_of = F.floor(F.log2(F.col(n) + 1) * 16).cast("int")
    bins = sorted(((r.bin, r.rows) for r in df.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("rows")).collect()), reverse=True)  # at most 1024 rows
    least, total = None, 0
    for b, rows in bins:
        total += rows
        if total > most:
            break
        least = b
    rows = df.where(bin_of >= least) if least is not None else df.limit(0)
    table = rows.select(*columns).toArrow()
    order = np.argsort(table.column(0).to_numpy(), kind="stable")
    return {c: table.column(c).to_numpy()[order] for c in columns}


class Lookup:
    """Places of keys in a table, by a hash: the table is in order of the hash of its keys, and `start` has where those with one beginning of the hash begin."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(1, int(len(keys)).bit_length())
        self.order = np.argsort(words.mix(keys.view(np.uint64)))
        self.keys = keys[self.order]
        self.start = np.append(0, np.cumsum(np.bincount(self._slot(self.keys), minlength=1 << self.bits))).astype(np.int32)

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (words.mix(x.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the order of the hash, whether it is there)."""
        slot = self._slot(x)
        at, end = self.start[slot], self.start[slot + 1]
        place, met = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        left = np.flatnonzero(at < end)
        at, end, own = at[left], end[left], x[left]
        while len(left):
            hit = self.keys[at] == own
            place[left[hit]], met[left[hit]] = at[hit], True
            at += 1
            more = ~hit & (at < end)
            left, at, end, own = left[more], at[more], end[more], own[more]
        return place, met


def _find(known: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there)."""
    if not len(known):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return at, known[at] == x


def scores(docs: DataFrame, held_out: Column, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of `docs`.

    The model learns from all rows that are not held out (null counts as not). base_score is the unigram score
    with half a count added; score is the log10 probability of the text under this model.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc).alias("doc"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    taught = docs.select("text", (~F.col("held_out")).alias("train"))
    known, seed = _distinct_hashes(taught)
    ends = int(docs.where("not held_out").count())
    total, distinct = known.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count_if(F.col("n_train") > 0)).first()
    n, v = int(total) + ends, int(distinct) + (ends > 0)
    log_den = float(np.log10(n + 0.5 * (v + 1)))
    end_base = float(np.log10(ends + 0.5)) - log_den

    gram_scores = save(_gram_scores(save(_text_grams(taught))))
    shared_grams = spark.sparkContext.broadcast(_head(gram_scores, "n", HEAD_GRAMS, ["key", "score"]))
    shared = spark.sparkContext.broadcast(_head(known, "n", HEAD_WORDS, ["hash", "n_train"]))
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, grams = shared.value, shared_grams.value
        if "lookup" not in grams:  # once for each worker; scores in the same order, and the keys are in the look-up
            grams["lookup"] = Lookup(grams.pop("key"))
            grams["score"] = grams["score"][grams["lookup"].order]
            grams["lookup"].order = None
        for batch in batches:
            for a, b, w in words.scan(batch.column(2), words.SPACED):
                first, which = w.distinct()
                h = w.only(first).hashes(seed).view(np.int64)[which]
                place, there = _find(head["hash"], h)
                owner = w.text[there]
                count = head["n_train"][place[there]] if there.any() else np.zeros(0, np.int64)
                lists = _lists(w.text[~there].astype(np.int64), h[~there], b - a)
                text, key = _text_keys(w)
                place, met = grams["lookup"].find(key)
                score = np.where(met, grams["score"][place], 0.0) if len(grams["score"]) else np.zeros(len(key))
                if not met.all():
                    rest = ~met
                    lists += _lists(text[rest], key[rest], b - a)
                else:
                    lists += _lists(text[:0], key[:0], b - a)
                sums = [(count > 0, owner), (np.log10(count + 0.5), owner), (score, text)]
                sums = [np.bincount(o, weights=x, minlength=b - a).astype(float) for x, o in sums]
                made = [pa.array(w.per_text, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *made, *lists], names=["doc", "held_out", "n_words", "known", "base", "score", "rest", "times", "grams", "gram_times"])

    schema = f"doc {kind}, held_out boolean, n_words bigint, known bigint, base double, score double, rest array<bigint>, times array<bigint>, grams array<bigint>, gram_times array<bigint>"
    partial = save(docs.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    rest = partial.where("size(rest) > 0").select("row", F.inline(F.arrays_zip("rest", "times"))).withColumnRenamed("rest", "hash")
    rest = rest.join(known.select("hash", "n_train"), "hash")
    rest = rest.groupBy("row").agg(
        F.sum(F.when(F.col("n_train") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.log10(F.col("n_train") + 0.5) * F.col("times")).alias("more_base"),
    )
    own = partial.where("size(grams) > 0").select("row", F.inline(F.arrays_zip("grams", "gram_times"))).withColumnRenamed("grams", "key")
    own = own.join(gram_scores.select("key", F.col("score").alias("each")), "key").groupBy("row").agg(F.sum(F.col("each") * F.col("gram_times")).alias("more_score"))
    rows = partial.drop("rest", "times", "grams", "gram_times").join(rest, "row", "left").join(own, "row", "left")
    zero = F.lit(0.0)
    return rows.select(
        F.col("doc").alias(doc),
        "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero) - F.col("n_words") * log_den + end_base).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", zero)).alias("score"),
    )
