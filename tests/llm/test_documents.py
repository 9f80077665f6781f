"""Operators 2, 3, 5 and 6 against plain versions, with edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from waymark.llm import components, minhash, pii, ppm, queries, winnow, words

random.seed(11)
VOCABULARY = ["".join(random.choice("abcdeéABC") for _ in range(random.randint(1, 7))) for _ in range(150)]


def prose(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


def changed(text, n):
    w = text.split(" ")
    for _ in range(n):
        w[random.randrange(len(w))] = random.choice(VOCABULARY) + "x"
    return " ".join(w)


def corpus():
    base, out = prose(300), []
    out += [base] * 4 + [changed(base, k) for k in (1, 1, 2, 2, 3, 4, 5, 6, 8, 12) for _ in range(4)]
    chain = prose(120)
    for _ in range(12):  # each close to the one before, the ends far apart
        out.append(chain)
        chain = changed(chain, 1)
    out += [None, "", "   \t\n", "one two", "One\nTWO", "one two three four five", "one two three four five", prose(30_000)]
    out += [prose(random.randint(3, 60)) for _ in range(40)]
    return list(enumerate(out))


def table(spark, rows, partitions=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)


def test_words_of_many_texts():
    texts = ["", "a b", "B", None, " x ", "b a"]
    w = words.split(*words.buffers(pa.array(texts, pa.string())), words.SPACED)
    h = w.hashes()
    assert w.per_text.tolist() == [0, 2, 1, 0, 1, 2]
    named = [w.bytes_of(i) for i in range(len(h))]
    assert named == [b"a", b"b", b"b", b"x", b"b", b"a"]
    assert all((h[i] == h[j]) == (named[i] == named[j]) for i in range(6) for j in range(6))
    assert words.take(w, np.array([3, 0])).to_pylist() == [b"x", b"a"]


def test_near_duplicates(spark):
    rows = corpus()
    docs = table(spark, rows).withColumn("n_shingles", F.lit("clash")).withColumn("bands", F.lit(0))
    want = brute.near_duplicates(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in minhash.near_duplicates(docs.where("doc_id < 20")).collect())
    assert minhash.near_duplicates(docs.where("doc_id < 0")).count() == 0
    alone = minhash.near_duplicates(docs.where("text is null")).collect()
    assert [(r.n_shingles, r.component_id == r.doc_id) for r in alone] == [(0, True)]


def test_repeated_ids_and_clashing_hashes(spark, monkeypatch):
    rows = [(1, prose(30)), (1, "other words altogether here now"), (2, prose(3)), (2, None)]
    got = minhash.near_duplicates(table(spark, rows)).collect()
    assert len(got) == 4 and all(r.component_id == r.doc_id for r in got)
    whole, n = " ".join(f"w{i}" for i in range(40)), 5
    texts = pa.array([whole, whole + " x", whole.replace("w20", "w21"), "", "w1 w2", whole.upper()])
    real = words.Words.hashes
    monkeypatch.setattr(words.Words, "hashes", lambda self, seed=0: real(self, seed) & np.uint64(1))
    assert minhash._like_hub(texts, np.zeros(6, int), n, 85).tolist() == [False, True, False, False, False, True]


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x


def test_hubs_over_batches(spark, monkeypatch):
    rows = [(i, t) for i, t in corpus() if i < 60 and t and len(t.split()) > 4]
    docs, sets = table(spark, rows), {d: brute.shingles(t) for d, t in rows}
    pairs = [(a, b) for a in (rows[0][0], rows[9][0], rows[-1][0]) for b, _ in rows if a != b]
    want = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    asked = spark.createDataFrame(pairs, "a long, b long")
    for at_once, copies in ((1 << 20, 1 << 20), (3000, 20_000), (1, 1 << 20)):
        monkeypatch.setattr(minhash, "SIDE_BY_SIDE", at_once)
        monkeypatch.setattr(minhash, "TOGETHER", copies)
        assert {tuple(r) for r in minhash.verified(asked, docs, "doc_id", "text", 85).collect()} == want


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_a_polynomial_confuses(spark, n):
    one, two = thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba"))
    docs = table(spark, [(1, one), (2, two), (3, f"{one} {prose(20)}")])
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3}
    bench = spark.createDataFrame([("i", two)], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in winnow.contamination(docs, bench).collect()} == {1: 0, 2: 1, 3: 0}
    got = {r.doc_id: r for r in ppm.scores(docs, F.col("doc_id") == 2).collect()}
    assert (got[2].n_known, got[1].n_known) == (1, 2) and got[1].score != got[2].score


def test_windows_with_one_hash(spark, monkeypatch):
    items = [(1, " ".join(f"b{i}" for i in range(15))), (2, " ".join(f"c{i}" for i in range(13))), (3, "d1 d2")]
    rows = [(1, items[0][1] + " x y"), (2, " ".join(f"e{i}" for i in range(40))), (3, "z d1 d2 z d1 d3"), (4, items[1][1].upper())]
    index = winnow.Index([(str(i), t) for i, t in items])
    real = winnow._among
    w = words.split(*words.buffers(pa.array([t for _, t in rows])), words.ALNUM)
    monkeypatch.setattr(winnow, "_among", lambda known, x: real(known, x) | True)
    every = np.arange(3)
    hashes = np.full(3, index.windows[13][0][0])
    assert all(len(winnow._holders(w, index, 13, every + 17, hashes)[0]) == 0 for _ in range(2))


def test_signatures_over_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 5, 400, 3, 1000)]
    whole = minhash.signatures(sets, 12)
    monkeypatch.setattr(minhash, "_PIECE", 64)
    assert (minhash.signatures(sets, 12) == whole).all()
    assert (minhash.signatures(sets[2:3], 12)[:, 0] == whole[:, 2]).all()


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7)]
    groups = brute.Groups()
    for a, b in links:
        groups.join(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: groups.root(x) for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contamination(spark):
    items = [prose(13), prose(40), "Alpha beta", "", None, prose(6)]
    items += [items[1], items[1][: len(items[1]) // 2]]
    rows = corpus()[:20] + [(1000, prose(50) + " " + items[0].upper() + ", " + prose(9)), (1001, items[1]), (1002, f"x ALPHA-beta {prose(200)}"), (1003, prose(400) + " " + items[5]), (1004, None), (1005, "")]
    rows += [(1006, f"{items[0]} {items[0]}"), (1007, items[0][:-1])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = brute.contamination(rows, list(enumerate(items)))
    docs = table(spark, rows).withColumn("items", F.lit(1)).withColumn("n_hit", F.lit("clash"))
    for block in (1 << 24, 200):
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in winnow.contamination(docs, bench, block_bytes=block).collect()}
        assert got == want
    none = winnow.contamination(docs, bench.where("item_id < 0")).where("n_hit > 0 or contaminated").count()
    assert none == 0 and winnow.contamination(docs.where("doc_id < 0"), bench).count() == 0


PERSONAL = [
    "mail a.b+c@d-e.f.org now", "x@a.b@c.d", "a@b", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004", "4111 1111 1111 1111 or 4111-1111-1111-1112", "4111111111111111",
    "+1 (988) 555-2485, +12, +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "é😀 a@b.cd  +49 30 1234567", "", None, "9" * 5000 + "." + "a" * 5000 + "@b.c", "0 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5",
    "at at a.b at c dot d", "call (988) 555-2485 or 4111.1111.1111.1111", " ".join(f"u{i}@h{i}.net" for i in range(300)), "1.2.3.4@5.6.7.8",
]


def test_personal_data(spark):
    rows = list(enumerate(PERSONAL)) + [(100 + i, f"note {i} mail u{i}@h.org card 4111 1111 1111 {1000 + i} tel +1 (988) 555-{1000 + i} ip 10.0.0.{i} v 1.2.3.{i + 250}") for i in range(80)]
    docs = table(spark, rows)
    got = {r.doc_id: r.spans for r in pii.spans_by_document(docs).collect()}
    for d, t in rows:
        mine = [(x.kind, x.s, x.e) for x in got.get(d, []) if x.base]
        assert mine == brute.personal(t), (d, t and t[:60])
        assert [(x.k, x.s) for x in got.get(d, [])] == sorted((x.k, x.s) for x in got.get(d, []))
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == "mail [EMAIL] now" and clean[9] is None and clean[8] == "" and clean[7].startswith("é😀 [EMAIL]  [PHONE]")
    joined = "joe@x.com4111 1111 1111 1111 end"  # spans that overlap go together
    assert pii.redact(table(spark, [(1, joined)])).first().text == "[EMAIL] end"
    assert pii.spans_by_document(docs.where("doc_id < 0")).count() == 0
    assert pii.redact(docs.where("doc_id in (8, 9)")).count() == 2


def test_rows_with_one_id_are_redacted_each_by_itself(spark):
    rows = [(1, "mail a@b.org now"), (1, "nothing personal at all here"), (1, "mail a@b.org now"), (None, "ip 10.0.0.1"), (2, None)]
    docs = table(spark, rows).withColumn("spans", F.lit("clash")).withColumn("_spans", F.lit(1)).withColumn("key", F.lit(2)).withColumn("doc", F.lit(3))
    got = sorted((str(r.doc_id), str(r.text), r.spans) for r in pii.redact(docs).collect())
    assert got == [("1", "mail [EMAIL] now", "clash"), ("1", "mail [EMAIL] now", "clash"), ("1", "nothing personal at all here", "clash"), ("2", "None", "clash"), ("None", "ip [IP]", "clash")]
    assert pii.redact(docs).columns == docs.columns


def test_learned_spans_of_each_kind(spark):
    rng, rows = random.Random(3), []
    for i in range(400):
        fill = " ".join(rng.choice(VOCABULARY) for _ in range(6))
        n = f"{1000 + i}"
        rows.append((i, f"{fill} mail u{i}@host.org or card 4111 1111 1111 1111 or call +1 (988) 555-{n} at host 10.0.{i % 250}.7 {fill} on 20{10 + i % 9}-0{1 + i % 9}-1{i % 9} order 77-{n}-{10 + i % 80} we met at noon"))
    planted = ["please mail bob (at) host (dot) org today", "card 4111.1111.1111.1111 thanks", "call (988) 555-2485 now", "at host 10 . 0 . 3 . 7 there"]
    rows += [(1000 + i, x) for i, x in enumerate(planted)] + [(2000, "we met at noon on 2011-04-12 about order 77-1234-55")]
    rows += [(2001, "please mail ann [AT] host [DOT] org today"), (2002, "the 9777946427004852 at re, at 10.30"), (2003, "")]
    spans = pii.candidates(table(spark, rows))
    fitted = pii.fit(spans, pii._wide_only(spans))
    assert set(fitted) == set(pii.KINDS) and all(len(models) == 2 and 0.5 <= threshold for models, threshold in fitted.values())
    got = {r.doc_id: [x.kind for x in r.spans if not x.base] for r in pii.spans_by_document(table(spark, rows)).collect()}
    assert [got.get(1000 + i) for i in range(4)] == [["email"], ["card"], ["phone"], ["ip"]] and not got.get(2000)
    assert got.get(2001) == ["email"] and not got.get(2002)


def test_trees_learn_from_every_example(spark):
    """Examples that look alike are one row with their number; none is left out, however many they are."""
    rows = [(i, " ".join(f"mail u{i}@host{j}.org at noon of 20{10 + j % 9}-0{1 + j % 9}-11;" for j in range(40))) for i in range(200)]
    spans = pii.candidates(table(spark, rows))
    made = pii.examples(spans, pii._wide_only(spans))
    alike, n = pii.counted(made), made.count()
    assert n > 20_000 and alike.agg(F.sum("n")).first()[0] == n and alike.count() < n / 10
    assert {(r.kind, r.label): r.n for r in alike.groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()}["email", 1.0] == 200 * 40


def test_kinds_without_examples_add_nothing(spark):
    rows = [(i, f"mail u{i}@host.org we met at noon") for i in range(60)] + [(100, "bob (at) host (dot) org or card 4111.1111.1111.1111")]
    spans = pii.candidates(table(spark, rows))
    assert "card" not in pii.fit(spans, pii._wide_only(spans)) and pii.fit(spans.where("doc is null"), spans.where("doc is null")) == {}
    assert all(x.kind != "card" for r in pii.spans_by_document(table(spark, rows)).collect() for x in r.spans)


def test_long_list_of_numbers(spark):
    text = " ".join(["12 345.6789"] * 3000) + " x@y.zz"
    got = [r for r in pii.candidates(table(spark, [(1, text)], 1)).collect() if r.base]
    assert [(r.kind, r.s, r.e) for r in got] == brute.personal(text) and pii._BLOCK < 3000


def test_pii_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(PERSONAL)] + [(7, PERSONAL[0])]
    table(spark, rows).withColumn("spans", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_pii(spark, str(tmp_path)).collect()
    digest = lambda t: hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in brute.personal(t)).encode()).hexdigest()
    count = lambda t, k: sum(x[0] == k for x in brute.personal(t))
    assert sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted((d, *(count(t, k) for k in pii.KINDS), digest(t)) for d, t in rows)


def plain_ppm(train):
    """Escapes and exclusion, spelled out: log10 of the probability of a text."""
    whole = lambda words: b" " + b"".join(w.encode() + b" " for w in words) + b"\n"
    counts = defaultdict(Counter)
    for p in map(whole, train):
        for i in range(1, len(p)):
            for k in range(min(i, ppm.ORDER), -1, -1):  # with update exclusion
                new = not counts[p[i - k : i]][p[i]]
                counts[p[i - k : i]][p[i]] += 1
                if not new:
                    break

    @cache
    def byte(context, s):
        """The probability of a byte; where the longer context has seen others, they are excluded below."""
        seen = {a: n for a, n in counts[context].items() if n} if context in counts else {}
        below = (lambda a: byte(context[1:], a)) if context else (lambda a: 1 / 256)
        if not seen:
            return below(s)
        t, d = sum(seen.values()), len(seen)
        freed = ppm.DISCOUNT * d / t
        excluded = sum(below(a) for a in seen)
        escape = freed * (1 - excluded)
        if s not in seen:
            return escape * below(s) / (1 - excluded)
        own = {a: (n - ppm.DISCOUNT) / t + freed * below(a) for a, n in seen.items()}
        return (1 - escape) * own[s] / sum(own.values())

    def text(tokens):
        p = whole(tokens)
        return sum(math.log10(byte(p[max(0, i - ppm.ORDER) : i], p[i])) for i in range(1, len(p)))

    text.byte = byte
    return text


@pytest.mark.parametrize("head", [1 << 19, 20])
def test_language_model(spark, monkeypatch, tmp_path, head):
    monkeypatch.setattr(ppm, "HEAD_WORDS", head)
    monkeypatch.setattr(ppm, "HEAD_GRAMS", head)
    monkeypatch.setattr(ppm, "HELD", head)
    rows = list(enumerate([prose(random.randint(1, 40)) for _ in range(30)] + [None, "", " \n ", "ünseen zzz-word", "a " * 60, "b" * 300]))
    rows += [(100, "some words in Order"), (101, "order  in words\nsome"), (7, prose(9)), (7, rows[7][1])]
    table(spark, rows).withColumn("score", F.lit("clash")).withColumn("n", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op6_ppm(spark, str(tmp_path))
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out.collect())
    tokens = [(d, brute.SPACED.findall((t or "").translate(brute.LOWER))) for d, t in rows]
    is_held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    train = [w for d, w in tokens if not is_held(d)]
    counts, model = Counter(w for t in train for w in t), plain_ppm(train)
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    den = math.log10(n + 0.5 * (v + 1))
    want = sorted((d, is_held(d), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, sum(math.log10(counts[x] + 0.5) - den for x in w) + math.log10(len(train) + 0.5) - den, model(w)) for d, w in tokens)
    assert len(got) == len(want) and len({d for d, w in tokens if is_held(d)}) > 3
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9)
    by_id = {g[0]: g for g in got}
    assert by_id[100][6] != by_id[101][6]  # the order of words counts
    for context in (b"", b" ", b"e ", b" zz", b"never "):
        assert math.isclose(sum(model.byte(context, a) for a in range(256)), 1, rel_tol=1e-9)


def words_with_one_hash():
    """Two words of 20 letters with equal hashes, by a birthday search over sums of eight parts (the first four of one word, the others of the other)."""
    dice, n = np.random.default_rng(1), 1 << 17
    value, factor = words._byte_values(), words._factor(20)
    letters = [dice.integers(0x61, 0x6E, (n, 5)) + (13 if k >= 4 else 0) for k in range(8)]
    sums = [(value[x] * factor[5 * (k % 4) : 5 * (k % 4) + 5]).sum(1, dtype=np.uint64) for k, x in enumerate(letters)]
    lists = [(s if k < 4 else np.uint64(0) - s, np.arange(n)[:, None]) for k, s in enumerate(sums)]
    for bits in (16, 32, 64):  # pairs of lists whose sums end in so many zeros
        merged = []
        for (x, i), (y, j) in zip(lists[::2], lists[1::2], strict=True):
            mask = np.uint64((1 << bits) - 1)
            order = np.argsort(y & mask)
            low, need = (y & mask)[order], (np.uint64(0) - x) & mask
            first, size = np.searchsorted(low, need), np.searchsorted(low, need, "right") - np.searchsorted(low, need)
            left, right = np.repeat(np.arange(len(x)), size), order[words.spread(first, size)]
            merged.append((x[left] + y[right], np.concatenate([i[left], j[right]], axis=1)))
        lists = merged
    parts = [bytes(letters[k][i].astype(np.uint8)).decode() for k, i in enumerate(lists[0][1][0])]
    return "".join(parts[:4]), "".join(parts[4:])


def test_two_words_with_one_hash(spark):
    a, b = words_with_one_hash()
    hashes = [next(words.scan(pa.array([x]), words.SPACED))[2].hashes()[0] for x in (a, b)]
    assert a != b and hashes[0] == hashes[1]
    docs = spark.createDataFrame([(f"{a} c d", True), (f"{b} e f", True)], "text string, train boolean")
    known, seed = ppm._distinct_hashes(docs)
    assert (known.count(), seed) == (6, 2)


def test_held_out_texts_score_above_the_base(spark):
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no test tables")
    got = [r for r in queries.op6_ppm(spark, str(path.parent)).collect() if r.held_out]
    assert len(got) > 100 and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_language_model_without_training(spark):
    docs = table(spark, [(1, "ab"), (2, None)])
    got = {r.doc_id: r for r in ppm.scores(docs, F.lit(True)).collect()}
    assert got[1].train_tokens == 0 and got[1].n_known == 0 and math.isclose(got[1].score, -4 * math.log10(256)) and math.isclose(got[2].score, -math.log10(256))
    assert ppm.scores(docs.where("doc_id < 0"), F.lit(False)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_keys_are_found_by_hash_and_tallied_by_a_sort(n):
    dice = np.random.default_rng(n)
    keys = np.unique(dice.integers(0, 1 << 59, n))
    lookup = ppm.Lookup(keys)
    asked = np.concatenate([keys, keys[:7], dice.integers(0, 1 << 59, 100)])
    place, met = lookup.find(asked)
    assert (met == np.isin(asked, keys)).all() and (keys[lookup.order][place[met]] == asked[met]).all()
    drawn = np.concatenate([keys, keys[::2]])
    learn = dice.integers(0, 2, len(drawn)).astype(bool)
    key, times = ppm._tallied(drawn, learn)
    assert (key == keys).all() and times.tolist() == [int(learn[drawn == k].sum()) for k in keys]
