"""Operator 12: alignment of the tokens of two tokenizers over the same bytes.

A is a byte-level vocabulary (tokenizers), B one of pieces (sentencepiece); both see a text with a space in front of it. The ends of the
tokens are marked in two packed bitsets over the bytes. Their AND has the shared cuts, which part a text into groups; popcount
rank of a cut gives the ranges of tokens of a group; each bit of their OR is the end of one link, a pair of tokens whose byte
ranges overlap, and the ranks there name its two tokens.

Before a single space between two other plain characters both tokenizers cut, whatever stands around it: A by its pre-split
pattern, B since no piece has a space after another character (checked when the model is read). So a text is a row
of runs, and each distinct run is tokenized and aligned once by a worker. Links are counted by runs; the ids of each text are written
to a scratch table beside them, so that the second pass aligns whole texts without tokenizing again.

Links of an id pair are counted over the whole corpus, runs by the number of times they occur. The most frequent pairs, HEAD at
most, are broadcast for the second pass; links of all others are joined. Texts that are null or empty, or that the tokens do not spell
(a text with U+2581, say), have no tokens, no links, and count for nothing. Repeated rows count each. Of a
B id's pairs with equal counts all are best.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .bpe import byte_alphabet
from .scratch import save

#: Pairs that are broadcast at most, at 17 bytes each. A bound on memory: all others are joined.
HEAD = 1_000_000
#: Runs, and bytes of runs, that a worker keeps at most; then it starts afresh. Bytes of runs that are tokenized as one text.
KNOWN, KNOWN_BYTES, TOGETHER = 300_000, 16 << 20, 1 << 12

# Bytes that may stand before and after a space at which both tokenizers cut: printable ASCII, and two-byte characters that are no space.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_LEAD2 = np.zeros(256, bool)
_LEAD2[0xC3:0xE0] = True

SUMS = ("n_a", "n_b", "n_groups", "n_links")
#: Bytes of ids that are aligned side by side in the second pass.
SIDE = 1 << 20


class Bits:
    """A packed bitset over bytes; a bit is set at the last byte of each token."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])

    @classmethod
    def of_ends(cls, ends: np.ndarray, n: int) -> Bits:
        bits = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
        bits[ends - 1] = 1
        return cls(np.packbits(bits, bitorder="little").view(np.uint64))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.packed & other.packed)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.packed | other.packed)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.packed[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """Places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.packed.view(np.uint8), bitorder="little"))


def run_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where runs begin in texts that begin at at[:-1]: there, and at each space with plain characters on both sides."""
    ok = np.zeros(len(data), bool)
    if len(data) > 2:
        before = _PLAIN[data[1:-1]]
        before[1:] |= (data[2:-1] >= 0x80) & _LEAD2[data[1:-2]]
        ok[2:] = before & (data[2:] == 0x20)
        ok[:-1] &= _PLAIN[data[1:]] | _LEAD2[data[1:]]
        ok[-1] = False
    ok[at[:-1][np.diff(at) > 0]] = True
    return np.flatnonzero(ok)


class Vocabulary:
    """Bytes of tokens by id."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens])
        self.at, self.data = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.data[words.spread(self.at[ids], self.size[ids])]


class Pool:
    """Rows of items by number, one after the other."""

    def __init__(self):
        self.items, self.at, self.size = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, items: np.ndarray, size: np.ndarray) -> None:
        """Further rows, with size[i] items each."""
        self.at = np.append(self.at, len(self.items) + np.cumsum(size) - size)
        self.items, self.size = np.append(self.items, items), np.append(self.size, size)

    def of(self, number: np.ndarray) -> np.ndarray:
        """Items of these rows in turn."""
        return self.items[words.spread(self.at[number], self.size[number])]


class Aligned:
    """Tokens a and b side by side over the same n bytes."""

    def __init__(self, a_bytes: Vocabulary, b_bytes: Vocabulary, a: np.ndarray, b: np.ndarray, n: int):
        self.a, self.b = a, b
        self.marks = [Bits.of_ends(np.cumsum(v.size[ids]), n) for v, ids in ((a_bytes, a), (b_bytes, b))]
        self.shared, self.either = self.marks[0] & self.marks[1], self.marks[0] | self.marks[1]

    def links(self) -> np.ndarray:
        """Both ids of each link, in order."""
        at = self.either.select()
        return self.a[self.marks[0].rank(at)] << 32 | self.b[self.marks[1].rank(at)]

    def groups(self, digits: Vocabulary, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of `1,2|3;` for each group, where those up to each of `ends`, which are cuts, end)."""
        a, b, marks, shared = self.a, self.b, self.marks, self.shared
        cuts = shared.select() + 1
        to_a, to_b = (m.rank(cuts) for m in marks)
        ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        for own, side, upto, other, sign in ((a, marks[0], to_a, np.append(0, to_b[:-1]), "|"), (b, marks[1], to_b, to_a, ";")):
            group = shared.rank(side.select())
            place = np.arange(len(own)) + other[group]
            ids[place] = own
            mark[place[upto - 1]] = ord(sign)
        size = digits.size[ids] + 1
        stop = np.cumsum(size)
        out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
        out[stop - 1] = mark
        out[words.spread(stop - size, size - 1)] = digits.spell(ids)
        return out, np.append(0, stop)[marks[0].rank(ends) + marks[1].rank(ends)]


class Aligner:
    """Runs of one worker and what is known of them: ids of A and of B and links, each in one pool."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet, names = byte_alphabet(), [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = Vocabulary([bytes(alphabet[c] for c in x) if all(c in alphabet for c in x) else x.encode() for x in names])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("B has pieces with a space after another character; texts cannot be cut at spaces")
        self.b_bytes = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.digits = Vocabulary([str(i).encode() for i in range(max(len(names), len(pieces)))])
        self.unit = np.uint16 if max(len(names), len(pieces)) <= 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.binary())
        self.ok = np.zeros(0, bool)
        self.pools = {name: Pool() for name in ("a", "b", "links")}
        self.bytes = 0

    def _ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B over texts that each begin with a space, all in one row."""
        a = [e.ids for e in self.a.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        b = self.b.encode([t[1:].decode() for t in texts], num_threads=1)  # B adds the space itself
        return tuple(np.fromiter(chain.from_iterable(side), np.int64) for side in (a, b))

    def _spelled(self, runs: list[bytes]) -> list[tuple[list[bytes], np.ndarray, np.ndarray]]:
        """(runs, ids of A, ids of B) whose tokens spell the runs; a run for which they do not is left out."""
        if not runs:
            return []
        texts, size = [[]], 0
        for r in runs:
            plain = len(r) > 1 and (_PLAIN[r[1]] or _LEAD2[r[1]])
            if texts[-1] and (not plain or not closed or size + len(r) > TOGETHER):  # noqa: F821
                texts.append([])
                size = 0
            texts[-1].append(r)
            size += len(r)
            closed = _PLAIN[r[-1]] or (len(r) > 1 and r[-1] >= 0x80 and _LEAD2[r[-2]])
        whole = np.frombuffer(b"".join(runs), np.uint8)
        a, b = self._ids([b"".join(t) for t in texts])
        if np.array_equal(self.a_bytes.spell(a), whole) and np.array_equal(self.b_bytes.spell(b), whole):
            return [(runs, a, b)]
        if len(runs) == 1:
            return []
        half = len(runs) // 2
        return self._spelled(runs[:half]) + self._spelled(runs[half:])

    def _learn(self, runs: list[bytes]) -> None:
        spelled = self._spelled(runs)
        fine = {r for part, _, _ in spelled for r in part}
        bad = [r for r in runs if r not in fine]
        parts = [(bad, *np.zeros((2, 0), np.int64), False), *((*part, True) for part in spelled)]
        for part in parts:
            self._add(*part)
        self.known = pa.concat_arrays([self.known, *(pa.array(part[0], pa.binary()) for part in parts)])

    def _add(self, runs: list[bytes], a: np.ndarray, b: np.ndarray, ok: bool) -> None:
        """Align runs whose tokens in turn are a and b."""
        if not runs:
            return
        ends = np.cumsum([len(r) for r in runs])
        self.ok = np.append(self.ok, np.full(len(runs), ok))
        self.bytes += int(ends[-1])
        if not ok:
            for pool in self.pools.values():
                pool.add(a, np.zeros(len(runs), np.int64))
            return
        side = Aligned(self.a_bytes, self.b_bytes, a, b, int(ends[-1]))
        for pool, items, upto in zip(self.pools.values(), (a, b, side.links()), (*side.marks, side.either), strict=True):
            pool.add(items, np.diff(upto.rank(np.append(0, ends))))

    def numbers(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of each run; what is new is learned."""
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int32).tobytes())
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, bounds, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        runs = coded.dictionary
        place = pc.index_in(runs, value_set=self.known)
        if place.null_count:
            before = len(self.known)
            self._learn(runs.filter(place.is_null()).to_pylist())
            place = pc.coalesce(place, pc.add(pc.index_in(runs, value_set=self.known[before:]), pa.scalar(before, pa.int32())))
        return place.to_numpy().astype(np.int64)[coded.indices.to_numpy()]

    def texts(self, col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(from, to, numbers of runs, first run of each text, whether the text is spelled) for parts of the column."""
        if not len(col):
            return
        data, offsets = words.buffers(col)
        a = 0
        while a < len(offsets) - 1:
            if len(self.known) > KNOWN or self.bytes > KNOWN_BYTES:
                yield a, a, *np.zeros((2, 0), np.int64), np.zeros(0, bool)  # what was counted by number has to be taken now
                self.forget()
            b = min(max(a + 1, int(np.searchsorted(offsets, offsets[a] + words.CHUNK_BYTES, "right")) - 1), len(offsets) - 1)
            at = offsets[a : b + 1] - offsets[a]
            led = at + np.concatenate([[0], np.cumsum(np.diff(at) > 0)])
            spaced = np.full(led[-1], 0x20, np.uint8)
            full = np.flatnonzero(np.diff(at))
            spaced[words.spread(led[full] + 1, np.diff(at)[full])] = data[offsets[a] : offsets[b]]
            starts = run_starts(spaced, led)
            number = self.numbers(spaced, starts)
            first = np.searchsorted(starts, led)
            bad = np.concatenate([[0], np.cumsum(~self.ok[number])])
            yield a, b, number, first, (bad[first[1:]] == bad[first[:-1]]) & (np.diff(first) > 0)
            a = b


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of a worker, which keeps it from task to task."""
    key = a_path, b_path
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _packed(ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """ids[cuts[i]:cuts[i + 1]] as bytes, two for each id where all vocabularies are small enough, and four otherwise."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * ids.itemsize).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])


def tokenized(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """`docs` without `text` and with `_a` and `_b` (packed ids, none where the tokens do not spell the text), and rows with (_a_id, _b_id, _n) instead: how many links
    of some of the texts hold each pair of ids. In the others `_n` is null."""
    kept = [c for c in docs.columns if c != text]
    names = ["_a", "_b", "_a_id", "_b_id", "_n"]
    kinds = [T.BinaryType(), T.BinaryType(), T.IntegerType(), T.IntegerType(), T.LongType()]
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in kept] + [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        times, own_kinds = np.zeros(0, np.int64), None

        def counted() -> pa.RecordBatch:
            some, pool = np.flatnonzero(times), aligner.pools["links"]
            keys, n = pool.of(some), np.repeat(times[some], pool.size[some])
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            n, keys = np.add.reduceat(n, first) if len(first) else n, keys[first]
            made = [pa.nulls(len(keys), pa.binary()), pa.nulls(len(keys), pa.binary()), pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(n)]
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(keys), k) for k in own_kinds), *made], names=schema.names)

        for batch in batches:
            own_kinds = [batch.column(i).type for i in range(len(kept))]
            for a, b, number, first, spelled in aligner.texts(batch.column(len(kept))):
                if a == b:
                    yield counted()
                    times = np.zeros(0, np.int64)
                    continue
                live = np.repeat(spelled, np.diff(first))
                own = np.bincount(number[live], minlength=len(aligner.known))
                own[: len(times)] += times
                times = own
                packed = []
                for pool in (aligner.pools["a"], aligner.pools["b"]):
                    upto = np.append(0, np.cumsum(np.where(live, pool.size[number], 0)))[first]
                    packed.append(_packed(pool.of(number[live]).astype(aligner.unit), upto))
                rest = [pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(kept))), *packed, *rest], names=schema.names)
        if own_kinds is not None:
            yield counted()

    return docs.select(*[docs[c] for c in kept], docs[text]).mapInArrow(run, schema)


def _unpacked(col: pa.Array, unit: type) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds of each row's ids)."""
    data, offsets = words.buffers(col)
    size = np.dtype(unit).itemsize
    return np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), unit).astype(np.int64), (offsets - offsets[0]) // size


@dataclass
class Head:
    """Pairs in order, how many links have each, and whether no pair of its B id has more."""

    keys: np.ndarray
    links: np.ndarray
    best: np.ndarray


def _ranked_pairs(ids: DataFrame) -> DataFrame:
    counts = ids.where("_n is not null").groupBy(F.col("_a_id").alias("a_id"), F.col("_b_id").alias("b_id"))
    pairs = save(counts.agg(F.sum("_n").alias("links")))
    most = pairs.groupBy("b_id").agg(F.max("links").alias("most"))  # a row for each id of B's vocabulary at most
    key = F.shiftleft(F.col("a_id").cast("long"), 32).bitwiseOR(F.col("b_id").cast("long"))
    return save(pairs.join(F.broadcast(most), "b_id").select(key.alias("key"), "links", (F.col("links") == F.col("most")).alias("best")))


def _head(pairs: DataFrame, most: int) -> tuple[Head, int]:
    """(the most frequent pairs, the number of links that those left out have at most)."""
    octave = F.floor(F.log2("links") * 16)
    steps = pairs.groupBy(octave.alias("step")).agg(F.count("*").alias("n"), F.min("links").alias("least")).orderBy(F.desc("step")).collect()  # at most 16 for each bit
    least, total = 0 if sum(s.n for s in steps) <= most else None, 0
    if least is None:
        least = max((s.links for s in pairs.agg(F.max("links").alias("links")).collect())) + 1
        for s in steps:
            total += s.n
            if total > most:
                break
            least = s.least
    rows = pairs.where(F.col("links") >= least).orderBy("key").toArrow()
    return Head(*(rows.column(c).to_numpy() for c in ("key", "links", "best"))), least - 1


def aligned(docs: DataFrame, a_path: str, b_path: str, text: str = "text", head: int = HEAD) -> DataFrame:
    """`docs` without `text` and with n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent one of its B id), count_sum
    (of the counts of all links' pairs) and `groups` (text: ids of A and of B of each group, as in `1,2|3;4|5`). Older columns of these names are replaced."""
    added = [*SUMS, "n_best", "count_sum"]
    kept = [c for c in docs.columns if c not in {text, *added, "groups", "_rest"}]
    ids = save(tokenized(docs.select(*[docs[c] for c in kept], docs[text]), a_path, b_path, text))
    pairs = _ranked_pairs(ids)
    top, below = _head(pairs, head)
    shared = docs.sparkSession.sparkContext.broadcast(top)
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, T.LongType()) for n in added] + [T.StructField("groups", T.StringType()), T.StructField("_rest", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, top = _aligner(a_path, b_path), shared.value
        for batch in batches:
            sides = [_unpacked(batch.column(len(kept) + i), aligner.unit) for i in (0, 1)]
            bounds = sides[0][1] + sides[1][1]
            i = 0
            while i < batch.num_rows:
                j = min(max(i + 1, int(np.searchsorted(bounds, bounds[i] + SIDE, "right")) - 1), batch.num_rows)
                (a, at_a), (b, at_b) = ((own[at[i] : at[j]], at[i : j + 1] - at[i]) for own, at in sides)
                ends = np.append(0, np.cumsum(aligner.a_bytes.size[a]))[at_a]  # of texts, in bytes, after 0
                side = Aligned(aligner.a_bytes, aligner.b_bytes, a, b, int(ends[-1]))
                upto = side.either.rank(ends)
                keys = side.links()
                place = np.minimum(np.searchsorted(top.keys, keys), max(len(top.keys) - 1, 0))
                hit = top.keys[place] == keys if len(top.keys) else np.zeros(len(keys), bool)
                made = [np.diff(at_a), np.diff(at_b), np.diff(side.shared.rank(ends)), np.diff(upto)]
                for x in (top.best, top.links):
                    c = np.append(0, np.cumsum(np.where(hit, x[place], 0) if len(top.keys) else np.zeros(len(keys), np.int64)))
                    made.append(np.diff(c[upto]))
                held = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(~hit))[upto].astype(np.int32)), pa.array(keys[~hit]))
                own = [batch.column(k).slice(i, j - i) for k in range(len(kept))]
                groups = words.joined(*side.groups(aligner.digits, ends))
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x.astype(np.int64)) for x in made), groups, held], names=schema.names)
                i = j

    out = ids.where("_n is null").select(*kept, "_a", "_b").mapInArrow(run, schema)
    if not below or not pairs.where(F.col("links") <= below).head(1):
        return out.drop("_rest")
    out = save(out.withColumn("_row", F.monotonically_increasing_id()))
    rare = out.where(F.size("_rest") > 0).select("_row", F.explode("_rest").alias("key")).groupBy("_row", "key").agg(F.count("*").alias("k"))
    more = rare.join(pairs.where(F.col("links") <= below), "key").groupBy("_row").agg(F.sum(F.col("k") * F.col("best").cast("int")).alias("_best"), F.sum(F.col("k") * F.col("links")).alias("_sum"))
    out = out.join(more, "_row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0)))
    return out.select(*kept, *added, "groups")
