"""Operator 4: token-id files, coded by a static range asymmetric numeral system.

A file set is a folder: `table` holds one frequency table, which all blocks share, and
`blocks` holds blocks of whole documents in ascending order of their id, as Parquet
rows, so Spark's committer keeps half-written files out. The ids of a block are
dealt to interleaved lanes in turn; each lane has a state of its own, and all lanes
share one stream of 32-bit words. A block carries its position in the id stream, its
documents with their lengths, its final lane states (the checkpoint from which it
is decoded) and a CRC-32, so any block decodes alone and any number in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .library import packed_ids
from .scratch import folder, save

LANES = 128
BLOCK_IDS = 1 << 16
#: Blocks that are coded side by side; this bounds memory.
SIDE_BY_SIDE = 48
_LOW, _WORD = np.uint64(1 << 31), np.uint64(32)


class Table:
    """Frequencies of token ids, scaled to a sum of 2**bits; an id that never occurs has none."""

    def __init__(self, scaled: np.ndarray):
        self.scaled = scaled.astype(np.uint32)
        self.bits = int(self.scaled.sum()).bit_length() - 1
        self.below = (np.cumsum(self.scaled) - self.scaled).astype(np.uint32)
        self.symbol = np.repeat(np.arange(len(scaled), dtype=np.uint16 if len(scaled) <= 1 << 16 else np.uint32), scaled)

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """At least 1 for each id that occurs; what rounding leaves over goes to or comes from the most frequent ids."""
        some = int((counts > 0).sum())
        bits = max(12, some.bit_length() + 3)
        total = max(1, int(counts.sum()))
        scaled = np.where(counts > 0, np.maximum(1, counts.astype(object) * (1 << bits) // total), 0).astype(np.int64)
        if not some:
            scaled[0] = 1
        order, left = np.argsort(-scaled, kind="stable"), (1 << bits) - int(scaled.sum())
        for i in order:
            step = left if left > 0 else max(left, 1 - int(scaled[i]))
            scaled[i] += step
            left -= step
            if not left:
                break
        return cls(scaled)


def _grid(n: int) -> int:
    return -(-n // LANES)


def encode_blocks(blocks: list[np.ndarray], table: Table) -> list[bytes]:
    """Payload of each block: lane states, then the words in the order in which a decoder reads them."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    steps = [_grid(len(blocks[i])) for i in order]
    fill = int(np.argmax(table.scaled))
    ids = np.full((max(steps, default=0), len(blocks), LANES), fill, np.uint32)
    for k, i in enumerate(order):
        flat = np.full(steps[k] * LANES, fill, np.uint32)
        flat[: len(blocks[i])] = blocks[i]
        ids[: steps[k], k] = flat.reshape(-1, LANES)
    state = np.full((len(blocks), LANES), _LOW, np.uint64)
    said, spoke = np.zeros(ids.shape, np.uint32), np.zeros(ids.shape, bool)
    bits, active = np.uint64(table.bits), np.searchsorted(-np.array(steps), -np.arange(len(ids)), "left")
    for t in range(len(ids) - 1, -1, -1):
        n = active[t]
        x, s = state[:n], ids[t, :n]
        f, c = table.scaled[s].astype(np.uint64), table.below[s].astype(np.uint64)
        full = x >= (((_LOW >> bits) << _WORD) * f)
        spoke[t, :n], said[t, :n] = full, x.astype(np.uint32)
        x = np.where(full, x >> _WORD, x)
        q = x // f
        state[:n] = (q << bits) + (x - q * f) + c
    out: list[bytes] = [b""] * len(blocks)
    for k, i in enumerate(order):
        out[i] = state[k].astype("<u8").tobytes() + said[: steps[k], k][spoke[: steps[k], k]].astype("<u4").tobytes()
    return out


def decode_blocks(payloads: list[bytes], lengths: list[int], table: Table) -> list[np.ndarray]:
    order = sorted(range(len(payloads)), key=lambda i: -lengths[i])
    steps = [_grid(lengths[i]) for i in order]
    head = LANES * 8
    state = np.array([np.frombuffer(payloads[i], "<u8", LANES) for i in order], np.uint64).reshape(-1, LANES)
    words = np.frombuffer(b"".join(payloads[i][head:] for i in order) + b"\0" * 4, "<u4")
    at = np.concatenate([[0], np.cumsum([(len(payloads[i]) - head) // 4 for i in order])[:-1]]).astype(np.int64) if order else np.zeros(0, np.int64)
    out = np.zeros((max(steps, default=0), len(payloads), LANES), np.uint32)
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    active = np.searchsorted(-np.array(steps), -np.arange(len(out)), "left")
    for t in range(len(out)):
        n = active[t]
        x = state[:n]
        slot = x & mask
        s = table.symbol[slot.astype(np.int64)]
        x = table.scaled[s] * (x >> bits) + (slot - table.below[s])
        empty = x < _LOW
        rank = np.cumsum(empty, axis=1)
        word = words[np.minimum(at[:n, None] + rank - 1, len(words) - 1)]
        state[:n] = np.where(empty, (x << _WORD) | word, x)
        at[:n] += rank[:, -1]
        out[t, :n] = s
    made: list[np.ndarray] = [out[:0].reshape(-1)] * len(payloads)
    for k, i in enumerate(order):
        made[i] = out[: steps[k], k].reshape(-1)[: lengths[i]]
    return made


def _bounds(df: DataFrame, doc: str, shards: int) -> list[int]:
    """Ids that cut the documents into shards of about as many rows."""
    cuts = [i / shards for i in range(1, shards)]
    found = df.agg(F.percentile_approx(doc, cuts, 100 * shards)).first()[0] if cuts else None
    return sorted(set(found or []))


def _raw_blocks(tokens: DataFrame, doc: str, shards: int) -> DataFrame:
    """Blocks of whole documents, each with as many ids as BLOCK_IDS or one document more, in order within a shard."""
    schema = "shard int, block int, doc_ids array<bigint>, lengths array<int>, n_ids bigint, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, docs, parts, size = None, 0, [], [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "doc_ids": pa.array([docs], pa.list_(pa.int64())), "lengths": pa.array([[len(p) // 2 for p in parts]], pa.list_(pa.int32())), "n_ids": pa.array([size], pa.int64()), "ids": pa.array([b"".join(parts)], pa.binary())})

        for batch in batches:
            for s, d, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if docs and (s != shard or size >= BLOCK_IDS):
                    yield close()
                    block, docs, parts, size = block + 1 if s == shard else 0, [], [], 0
                shard = s
                docs.append(d)
                parts.append(x)
                size += len(x) // 2
        if docs:
            yield close()

    dealt = tokens.select("shard", doc, "ids").repartitionById(shards, "shard").sortWithinPartitions("shard", doc, "ids")
    return dealt.mapInArrow(run, schema)


def _counts(raw: DataFrame, vocabulary: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=vocabulary)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for r in raw.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most one row for each id of the vocabulary
        out[r.id] = r.n
    return out


def write(docs: DataFrame, path: str, tokenizer: str, end: int, vocabulary: int, doc: str = "doc_id", text: str = "text", shards: int | None = None) -> None:
    """Write the ids of all texts, each followed by `end`, as a file set in ascending order of integer ids.

    Null texts count as empty (the end id alone), null ids come first, rows with equal ids are in the order of their
    ids' bytes. `vocabulary` is at most 65536. `shards` is the number of ranges of ids (the session's shuffle partitions).
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.array(_bounds(docs, doc, shards), np.int64)
    tokens = packed_ids(docs.select(doc, text), tokenizer, end, text, also=_shard(doc, cuts))
    raw = save(_raw_blocks(tokens, doc, shards))
    table = Table.of_counts(_counts(raw, vocabulary))
    shared = spark.sparkContext.broadcast(table)

    sums = raw.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))  # a row for each shard
    within = raw.select("shard", "block", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")).alias("in_shard"))
    starts = within.join(before, "shard").select("shard", "block", (F.col("base") + F.col("in_shard")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SIDE_BY_SIDE):
                part = batch.slice(at, SIDE_BY_SIDE)
                ids = [np.frombuffer(x.as_buffer(), "<u2").astype(np.uint32) for x in part.column(5)]
                made = [pa.array(encode_blocks(ids, shared.value), pa.binary()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:5], *made], names=[*part.schema.names[:5], "payload", "crc"])

    coded = raw.mapInArrow(run, "shard int, block int, doc_ids array<bigint>, lengths array<int>, n_ids bigint, payload binary, crc bigint")
    coded = coded.join(F.broadcast(starts), ["shard", "block"]) if raw.count() <= 100_000 else coded.join(starts, ["shard", "block"])
    coded.write.option("compression", "none").parquet(f"{path}/blocks")
    rows = [(i, int(n)) for i, n in enumerate(table.scaled) if n]
    spark.createDataFrame(rows, "id int, scaled bigint").coalesce(1).write.parquet(f"{path}/table")


def _shard(doc: str, cuts: np.ndarray) -> tuple[T.StructField, Callable[[pa.RecordBatch], pa.Array]]:
    """The column `shard`: how many cuts an id is not below; null ids are in shard 0."""

    def of(batch: pa.RecordBatch) -> pa.Array:
        ids = batch.column(batch.schema.get_field_index(doc)).cast(pa.int64())
        return pa.array(np.searchsorted(cuts, ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "right"), pa.int32())

    return T.StructField("shard", T.IntegerType()), of


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document of a file set, its ids packed as little-endian unsigned 32-bit integers.

    A block whose ids do not have its checksum is an error.
    """
    rows = spark.read.parquet(f"{path}/table").collect()  # at most one row for each id of the vocabulary
    scaled = np.zeros(max(r.id for r in rows) + 1, np.int64)
    for r in rows:
        scaled[r.id] = r.scaled
    shared = spark.sparkContext.broadcast(Table(scaled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SIDE_BY_SIDE):
                part = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.slice(at, SIDE_BY_SIDE).columns, strict=True)}
                docs, starts, sizes, packed = [], [], [], []
                blocks = decode_blocks(part["payload"], part["n_ids"], shared.value)
                for ids, crc, start, own, lengths in zip(blocks, part["crc"], part["start"], part["doc_ids"], part["lengths"], strict=True):
                    whole = ids.astype("<u4").tobytes()
                    if zlib.crc32(whole) != crc:
                        raise ValueError(f"the block at id {start} does not have its checksum")
                    ends = np.cumsum(lengths)
                    docs += own
                    starts += (start + ends - lengths).tolist()
                    sizes += lengths
                    packed += [whole[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    blocks = spark.read.parquet(f"{path}/blocks").select("payload", "n_ids", "crc", "start", "doc_ids", "lengths")
    return blocks.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def written(docs: DataFrame, tokenizer: str, end: int, vocabulary: int, **options) -> DataFrame:
    """`write` to a new folder in the shared scratch place, and `read` it back."""
    path = folder(docs.sparkSession)
    write(docs, path, tokenizer, end, vocabulary, **options)
    return read(docs.sparkSession, path)
