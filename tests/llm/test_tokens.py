"""Operators 1, 4 and 8 against the tokenizers library, exact round trips and edge cases."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waymark.llm import bpe, library, queries, rans, token_files, words

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "plain words, don't 'S we're 12 34", "a<|endoftext|> b  c\n\n d\t x", "   ", "", None, "  lead", "trail ", "x\xa0y　z", "\x1c\x1d a", "a\x01b \x01",
    "日本語テキスト😀😀", "İΣ'll é", "é ́x", "aaaa" * 3000, "=" * 200, " " * 500 + "x", "<|endoftext|>", "plain words, don't 'S we're 12 34",
]


@pytest.fixture(scope="module")
def library_byte():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def automaton():
    return bpe.load(BYTE)


def table(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))


def test_round_trip_and_parts(spark, library_byte):
    docs = table(spark)
    done = bpe.round_trip(docs, BYTE)
    assert done.columns == ["doc_id", "text", "ids", "decoded"]
    rows = {r.doc_id: r for r in done.collect()}
    for i, t in enumerate(TEXTS):
        want = library_byte.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == want
        assert rows[i].decoded == library_byte.decode(want, skip_special_tokens=False) == (t or "")
    apart = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()}
    assert apart == {i: r.decoded for i, r in rows.items()}
    assert bpe.round_trip(docs.where("doc_id < 0"), BYTE).count() == 0
    empty = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bpe.decode(empty, BYTE).first().decoded == ""


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("a 's't\n\tre5.", max_size=30), max_size=4))
def test_any_text(automaton, library_byte, texts):
    ids = bpe.Encoder(automaton).encode_column(pa.array(texts, pa.string()))
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.to_pylist()] == [library_byte.encode(t, add_special_tokens=False).ids for t in texts]
    assert bpe.Decoder(automaton).decode_column(ids).to_pylist() == texts


def test_parts_and_a_small_memo(automaton, library_byte, monkeypatch):
    long = "It's a long one, isn't it? " * 40 + "é" * 300 + " <|endoftext|> x" + "ab" * 400 + " end"
    texts = [long, None, "", long[1:], "x " * 500, long]
    whole = bpe.Encoder(automaton).encode_column(pa.array(texts, pa.string()))
    assert [np.frombuffer(x, "<u4").tolist() for x in whole.to_pylist()] == [library_byte.encode(t or "", add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(bpe, "PART", 64)
    monkeypatch.setattr(bpe, "MEMO_PIECES", 5)
    assert bpe.Encoder(automaton).encode_column(pa.array(texts, pa.string())).equals(whole)
    assert bpe.Encoder(automaton).encode_column(pa.array(texts, pa.string()).slice(2, 3)).equals(whole.slice(2, 3))
    broken = pa.array([np.array([automaton.added["<|endoftext|>"], 0xC3], "<u4").tobytes(), None], pa.binary())
    assert bpe.Decoder(automaton).decode_column(broken).to_pylist()[1] == ""


def test_automaton_accepts_just_the_encoding(automaton, library_byte):
    ids = np.array(library_byte.encode("internationalisation", add_special_tokens=False).ids)
    assert automaton.has_arc(ids[:-1], ids[1:]).all()
    data = np.frombuffer(b"thth", np.uint8)
    t, h = (automaton.token[automaton.root[b]] for b in b"th")
    assert not automaton.has_arc(np.array([t]), np.array([h])).any()
    ids, count = automaton.paths(data, np.array([2, 2, 4]))
    assert count.tolist() == [1, 0, 1] and ids[0] == ids[1]


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_a_polynomial_confuses(spark, n):
    one, two = thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba"))
    made = library.SpacedEncoder(WORD)
    got = made.encode_column(pa.array([one, two, f"{one} {two}"], pa.string()), 1)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [made.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in (one, two, f"{one} {two}")]
    assert got[0] != got[1]


def test_runs_with_one_hash(monkeypatch):
    real = words.Words.hashes
    monkeypatch.setattr(words.Words, "hashes", lambda self, seed=0: real(self, seed) & np.uint64(3))
    made, texts = library.SpacedEncoder(WORD), ["one two three four five six", "six seven Eight\tnine ten one", "", "two.three,four"]
    for _ in range(2):
        got = made.encode_column(pa.array(texts, pa.string()), 1)
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [made.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_spaced_encoder(texts):
    made = library.SpacedEncoder(WORD)
    for _ in range(2):
        got = made.encode_column(pa.array(texts, pa.string()), 1)
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [made.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=400), min_size=1, max_size=6))
def test_coder(blocks):
    blocks = [np.array(b, np.uint32) for b in blocks]
    counts = sum((np.bincount(b, minlength=301) for b in blocks), np.zeros(301, np.int64))
    coder = rans.Table.of_counts(counts)
    assert int(coder.scaled.astype(np.int64).sum()) == 1 << coder.bits and ((coder.scaled > 0) >= (counts > 0)).all()
    got = rans.decode_blocks(rans.encode_blocks(blocks, coder), [len(b) for b in blocks], coder)
    assert all((a == b).all() for a, b in zip(got, blocks, strict=True))


def test_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(rans, "BLOCK_IDS", 500)
    tokenizer = Tokenizer.from_file(WORD)
    rows = [(7 * i % 31 if i % 9 else None, t) for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    got = sorted(rans.written(docs, WORD, 1, 49408, shards=3).collect(), key=lambda r: r.start)
    ids = lambda t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
    want = sorted(((-1 if d is None else d, np.frombuffer(ids(t), "<u4").astype("<u2").tobytes(), ids(t)) for d, t in rows), key=lambda x: x[:2])
    assert [(-1 if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in got] == [(d, x) for d, _, x in want]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert rans.written(docs.where("doc_id > 99"), WORD, 1, 49408).count() == 0
    path = str(tmp_path / "set")
    rans.write(docs, path, WORD, 1, 49408, shards=2)
    broken = spark.read.parquet(f"{path}/blocks").withColumn("crc", F.col("crc") + 1)
    broken.write.parquet(f"{path}/other")
    (tmp_path / "set/blocks").rename(tmp_path / "set/old")
    (tmp_path / "set/other").rename(tmp_path / "set/blocks")
    with pytest.raises(Exception, match="checksum"):
        rans.read(spark, path).collect()
    assert zlib.crc32(b"") == 0


def test_token_counts(spark, tmp_path):
    tokenizer = Tokenizer.from_file(WORD)
    tokenizer.encode_special_tokens = True
    docs = table(spark).repartition(3, "doc_id").drop("decoded")
    got = {r.doc_id: r.n_tokens for r in token_files.counted(docs, WORD, 49407).collect()}
    assert got == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    flat, end = [5, 9, 9, 3, 4, 9, 7], 9
    (tmp_path / "part-00000").write_bytes(np.array(flat, "<u2").tobytes())
    (tmp_path / "part-00001").write_bytes(b"")
    (tmp_path / "part-00002").write_bytes(np.array([9], "<u2").tobytes())
    for size in (2, 4, 6, 100):
        rows = sorted(tuple(r)[1:] for r in token_files.token_counts(token_files.listed(spark, str(tmp_path)), end, range_bytes=size).collect())
        assert rows == [(0, 0, 0, True), (0, 0, 1, True), (1, 2, 0, True), (2, 3, 2, True), (3, 6, 1, False)]
    assert token_files.counted(docs.where("doc_id < 0"), WORD, 49407).count() == 0


def test_token_counts_do_not_rest_on_the_order_of_rows(spark):
    tokenizer = Tokenizer.from_file(WORD)
    tokenizer.encode_special_tokens = True
    rows = [(i % 40, TEXTS[i % len(TEXTS)]) for i in range(120)] + [(None, "null id"), (7, " ".join(["long"] * 50_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)  # dealt in turn: another order each time it is run
    want = sorted((-1 if d is None else d, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 10)
    try:
        got = token_files.counted(docs, WORD, 49407).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got) == want


def test_queries_of_tokens(spark, tmp_path):
    rows = [(3 * i % 50, t) for i, t in enumerate(TEXTS)] + [(49, " ".join(["long", "words,"] * 20_000)), (49, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(1)).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    ids = lambda tokenizer, t: tokenizer.encode(t or "", add_special_tokens=False).ids
    want = sorted((d, len(ids(byte, t)), sha(np.array(ids(byte, t), "<u4").tobytes()), sha(byte.decode(ids(byte, t), skip_special_tokens=False).encode())) for d, t in rows)
    assert sorted(map(tuple, queries.op1_bpe(spark, str(tmp_path)).collect())) == want
    got = sorted(map(tuple, queries.op4_rans(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    held = {d: [] for d, _ in rows}
    for d, t in rows:
        held[d].append((len(ids(word, t)) + 1, zlib.crc32(np.array(ids(word, t) + [1], "<u4").tobytes())))
    assert [r[0] for r in got] == sorted(d for d, _ in rows) and [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    assert all(sorted(r[2:] for r in got if r[0] == d) == sorted(x) for d, x in held.items())
    word.encode_special_tokens = True
    assert sorted(map(tuple, queries.op8_token_counts(spark, str(tmp_path)).collect())) == sorted((d, len(ids(word, t))) for d, t in rows)
