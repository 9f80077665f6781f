"""Operator 2: near-duplicate documents by circulant MinHash.

Two permutations of the 32-bit universe make all coordinates of a signature: the
first one scatters the shingles, the second one, shifted circularly by k places,
gives coordinate k as the least value over the set. Runs of coordinates form bands,
and texts that agree on a band are candidates. At 36 bands of 6 coordinates a pair
with a Jaccard similarity of 0.85 shares no band with a chance of 4 in 10^8.

Texts with the same words in turn are one class from the start, by a 128-bit BLAKE2 digest of
those words. Only connectivity is asked for, so each bucket tests its members against one
hub. The texts of a hub and of some of its members meet in one task, where words and
shingles become numbers, exactly, and whole sets decide; many members are dealt to many
tasks, each with one copy of the hub. Members of a bucket that are still in different
components after that go through an exact prefix filter on the rarest shingles of their
sets, which leaves few pairs to test. No bucket is gathered in one place, paired with itself or cut short.

Null and empty texts and texts of separators alone have an empty set: no links,
their own component, kept. A text with fewer words than a shingle is one shingle, which only
texts with the same words share. Repeated rows are in one class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .components import components
from .scratch import save

SHINGLE = 5
BANDS, ROWS = 36, 6
#: Most names or pairs of candidates that are broadcast (16 or 32 MB of ids); more are joined by a shuffle.
BROADCAST_NAMES = 2_000_000
#: Bytes of members' texts for which there is one copy of a hub, and bytes of texts that are compared at once.
TOGETHER, SIDE_BY_SIDE = 1 << 20, 1 << 20
_PIECE = 1 << 15


def _sets(w: words.Words, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h = w.hashes()
    grams, out = words.runs(h, k), []
    for i, n in zip(w.first[:-1].tolist(), w.per_text.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(grams[i : i + n - k + 1]))
        elif n:
            out.append(words.mix(words.runs(h[i : i + n], n) + np.uint64(n)))
        else:
            out.append(grams[:0])
    return out


def _scatter(values: np.ndarray) -> np.ndarray:
    """The first permutation, of the 32-bit universe that the upper half of a hash names."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Signatures of nonempty sets, a row for each coordinate and a column for each set."""
    lengths = np.array([len(s) for s in sets])
    place = _scatter(np.concatenate(sets))
    begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    parts, owners = [], []
    for p in range(0, len(place), _PIECE):
        x = place[p : p + _PIECE]
        i, j = np.searchsorted(begin, [p, p + len(x)])
        starts = begin[i:j] - p
        owner = np.arange(i, j)
        if not len(starts) or starts[0]:
            starts, owner = np.concatenate([[0], starts]), np.concatenate([[i - 1], owner])
        y, z, least = np.empty_like(x), np.empty_like(x), np.empty((size, len(starts)), np.uint32)
        for k in range(size):  # the second permutation, at its k-th circular shift
            np.subtract(x, np.uint32(k), out=y)
            np.multiply(y, np.uint32(0x9E3779B1), out=y)
            np.right_shift(y, np.uint32(15), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint32(0x85EBCA77), out=y)
            np.right_shift(y, np.uint32(13), out=z)
            np.bitwise_xor(y, z, out=y)
            least[k] = np.minimum.reduceat(y, starts)
        parts.append(least)
        owners.append(owner)
    owner = np.concatenate(owners)
    return np.minimum.reduceat(np.concatenate(parts, axis=1), np.flatnonzero(np.diff(owner, prepend=-1)), axis=1)


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of 64-bit band keys for each set."""
    parts = sig.reshape(bands, rows, -1).astype(np.uint64)
    key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[:, None], parts.shape[2], axis=1)
    for j in range(rows):
        key = words.mix(key + parts[:, j] * np.uint64(0x9E3779B97F4A7C15))
    return np.ascontiguousarray(key.T).view(np.int64)


def sketch(docs: DataFrame, doc: str, text: str, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc, n_shingles, text_key, bands): set size, 128-bit key of the words in turn (null without words), and band keys
    (null for texts shorter than a shingle)."""
    schema = T.StructType([T.StructField(doc, docs.schema[doc].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("text_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in words.scan(batch.column(1), words.SPACED):
                sets = _sets(w, k)
                full = [s for s, n in zip(sets, w.per_text.tolist(), strict=True) if n >= k]
                keys = _band_keys(signatures(full, bands * rows), bands, rows) if full else np.zeros((0, bands), np.int64)
                some = w.per_text >= k
                offsets = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)), mask=pa.array(~some))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(_text_keys(w), pa.binary()), lists], names=schema.names)

    return docs.select(doc, text).mapInArrow(run, schema)


def _text_keys(w: words.Words) -> list[bytes | None]:
    """A digest of each text's words, each followed by a blank."""
    size = w.end - w.start + 1
    ends = np.concatenate([[0], np.cumsum(size)])
    data = np.full(ends[-1], 0x20, np.uint8)
    data[words.spread(ends[:-1], size - 1)] = w.data[words.spread(w.start, size - 1)]
    raw = memoryview(data)
    cuts = ends[w.first].tolist()
    return [hashlib.blake2b(raw[x:y], digest_size=16).digest() if y > x else None for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def shingle_sets(docs: DataFrame, doc: str, text: str, k: int = SHINGLE) -> DataFrame:
    """(doc, shingles): the whole set of each text, as sorted hashes."""
    schema = T.StructType([T.StructField(doc, docs.schema[doc].dataType), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in words.scan(batch.column(1), words.SPACED):
                sets = _sets(w, k)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=schema.names)

    return docs.select(doc, text).mapInArrow(run, schema)


def _named(docs: DataFrame, names: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, text) of the documents in `names` (doc), saved. Texts stay where they are while the names are few enough to broadcast."""
    names = save(names)
    names = F.broadcast(names) if names.count() <= BROADCAST_NAMES else names
    return save(docs.select(doc, text).join(names, doc, "left_semi"))


def _exact_shingles(w: words.Words, k: int) -> np.ndarray:
    """Numbers of the shingles by their first words, equal for equal shingles alone."""
    first, cell = w.distinct()
    word = words.take(w, first).dictionary_encode().indices.to_numpy()[cell].astype(np.int64)
    x = word[: max(0, len(word) - k + 1)]
    for j in range(1, k):
        _, x = np.unique(x * (len(first) + 1) + word[j : j + len(x)], return_inverse=True)
    return x


def _like_hub(col: pa.Array, hub: np.ndarray, k: int, percent: int) -> np.ndarray:
    """Which texts have 100 * intersection >= percent * union of their shingles with those of the text `hub[i]`."""
    data, offsets = words.buffers(col)
    w = words.split(data[offsets[0] : offsets[-1]], offsets - offsets[0], words.SPACED)
    x = _exact_shingles(w, k)
    text = w.text[: len(x)]
    inside = text == w.text[k - 1 :] if len(x) else np.zeros(0, bool)
    n = len(col)
    pairs = np.unique(x[inside] * n + text[inside])
    text, of_hub = pairs % n, pairs - pairs % n + hub[pairs % n]
    size = np.bincount(text, minlength=n)
    at = np.minimum(np.searchsorted(pairs, of_hub), max(0, len(pairs) - 1))
    both = np.bincount(text[pairs[at] == of_hub], minlength=n) if len(pairs) else size
    return (both * 100 >= (size + size[hub] - both) * percent) & (both > 0) & (hub != np.arange(n))


def verified(pairs: DataFrame, texts: DataFrame, doc: str, text: str, percent: int, k: int = SHINGLE) -> DataFrame:
    """Those distinct pairs (a, b) whose whole sets have 100 * intersection >= percent * union; `texts` holds the texts of all ends."""
    pairs = save(pairs)
    each = texts.select(F.col(doc).alias("b"), F.col(text).alias("t"))
    few = pairs.count() <= BROADCAST_NAMES
    members = each.join(F.broadcast(pairs) if few else pairs, "b").select("a", "b", "t")
    sizes = texts.select(F.col(doc).alias("b"), F.octet_length(text).alias("n"))
    parts = sizes.join(F.broadcast(pairs) if few else pairs, "b").groupBy("a").agg(F.sum("n").alias("held")).join(sizes.select(F.col("b").alias("a"), "n"), "a")
    # a hub is copied once for each 1 MB of its members' texts, or for each length of its own where that is more
    parts = save(parts.select("a", F.greatest(F.coalesce(F.ceil(F.col("held") / F.greatest("n", F.lit(TOGETHER))), F.lit(1)), F.lit(1)).cast("int").alias("parts")))
    shown = F.broadcast(parts) if few else parts
    members = members.join(shown, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", "t")
    hubs = each.withColumnRenamed("b", "a").join(shown, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast(pairs.schema["b"].dataType).alias("b"), "t")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None  # the text of the hub at work
        for batch in batches:
            ends, i = np.cumsum(pc.binary_length(batch.column(2)).to_numpy()), 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SIDE_BY_SIDE, "right")))
                part = batch.slice(i, j - i)
                is_hub, texts = part.column(1).is_null().to_numpy(zero_copy_only=False), part.column(2)
                carried = int(not is_hub[0])
                if carried:
                    texts, is_hub = pa.concat_arrays([hub, texts]), np.append(True, is_hub)
                at = np.maximum.accumulate(np.where(is_hub, np.arange(len(is_hub)), 0))
                like = _like_hub(texts, at, k, percent)[carried:]
                hub = texts.slice(int(at[-1]), 1)
                yield part.select(["a", "b"]).filter(pa.array(like))
                i = j

    kind = pairs.schema["a"].dataType.simpleString(), pairs.schema["b"].dataType.simpleString()
    rows = hubs.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", "b", "t")  # a hub comes before its members
    return rows.select("a", "b", "t").mapInArrow(compare, f"a {kind[0]}, b {kind[1]}")


def prefix_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of `sets` (member, shingles) in different components that the prefix filter cannot rule out.

    With the shingles of every set in one order, the rarest first, two sets above the threshold share a shingle
    in the first places of both, and at most so many shingles follow. Near copies of one text that are too
    far apart differ in just those places, so a large group of them is not paired with itself.
    """
    n = F.size("shingles")
    flat = sets.select("member", n.alias("n"), F.explode("shingles").alias("shingle"))
    often = flat.groupBy("shingle").agg(F.count("*").alias("often"))
    ordered = flat.join(often, "shingle").groupBy("member", "n").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("by"))
    longest = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    first = ordered.join(labels, "member", "left").select("member", "n", F.coalesce("component", "member").alias("component"), F.posexplode(F.slice("by", F.lit(1), longest.cast("int"))).alias("place", "x"))
    first = save(first.select("member", "n", "component", "place", F.col("x.shingle").alias("shingle")))
    short = first.where(F.col("place") < F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent)) + 1)
    short = short.select("shingle", F.col("member").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("place").alias("pa"))
    most = F.least(F.col("na") - F.col("pa"), F.col("n") - F.col("place"))
    close = (F.col("na") < F.col("n")) | ((F.col("na") == F.col("n")) & (F.col("a") < F.col("member")))
    pairs = short.join(first, "shingle").where((F.col("component") != F.col("ca")) & close & (most * 100 >= (F.col("na") + F.col("n") - most) * percent))
    return pairs.select(F.least("a", "member").alias("a"), F.greatest("a", "member").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = 85, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc, n_shingles, component_id, kept), a row for each row of `docs`.

    Ids are taken to be unique. Ties need no rule: a component is named by its smallest id. A null id names nothing.
    """
    docs = docs.select(doc, text)
    sketches = save(sketch(docs, doc, text, k, bands, rows))
    classes = save(sketches.where("text_key is not null").groupBy("text_key").agg(F.min(doc).alias("member")))
    posts = sketches.where("bands is not null").join(classes.select(F.col("member").alias(doc)), doc, "left_semi").select(F.col(doc).alias("member"), F.explode("bands").alias("band"))
    # saved, so that the join has plain shuffles on both sides and Spark can split a hot bucket
    buckets = save(posts.groupBy("band").agg(F.count("*").alias("n"), F.min("member").alias("hub")).where("n > 1").select("band", "hub"))
    shared = save(posts.join(buckets, "band"))
    texts = _named(docs, shared.select(F.col("member").alias(doc)).distinct(), doc, text)

    first = shared.where("member != hub").select(F.col("hub").alias("a"), F.col("member").alias("b")).distinct()
    labels = save(components(verified(first, texts, doc, text, percent, k)).select(F.col("node").alias("member"), "component"))

    # what no hub has tested yet: members of one bucket that are still apart
    inner = shared.where("member != hub").join(labels, "member", "left").select("band", "member", F.coalesce("component", "member").alias("component"))
    apart = save(inner.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band"))
    left = save(inner.join(apart, "band", "left_semi").select(F.col("member").alias(doc)).distinct())
    rest = save(shingle_sets(texts.join(left, doc, "left_semi"), doc, text, k).withColumnRenamed(doc, "member"))
    bridges = save(verified(prefix_pairs(rest, labels, percent), texts, doc, text, percent, k))
    bridges = bridges.join(labels.select(F.col("member").alias("a"), F.col("component").alias("ca")), "a", "left").join(labels.select(F.col("member").alias("b"), F.col("component").alias("cb")), "b", "left")
    merged = components(bridges.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    merged = merged.select(F.col("node").alias("first"), F.col("component").alias("last"))

    named = classes.join(labels, "member", "left").select("text_key", F.coalesce("component", "member").alias("first"))
    named = named.join(merged, "first", "left").select("text_key", F.coalesce("last", "first").alias("component_id"))
    out = sketches.select(doc, "n_shingles", "text_key").join(named, "text_key", "left")
    out = out.select(doc, "n_shingles", F.coalesce("component_id", doc).alias("component_id"))
    return out.withColumn("kept", F.col(doc).eqNullSafe(F.col("component_id")))
