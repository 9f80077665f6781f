"""Operators 11 to 13: main texts of pages, aligned tokens and periodic runs, against plain versions."""

import hashlib
import html as entities
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from waymark.llm import align, extract, periodic, queries, words

SMALL = "/root/testdata/sf0.001"


# --- 11


def article(page):
    """The article of the tables' pages, block by block."""
    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*$", "", inside.group(1)) if inside else "")
    made = [" ".join(entities.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(b for b in made if b)


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    found = {r.page_id: r for r in queries.op11_extract(spark, SMALL).collect()}
    assert len(found) == pages.count()
    for p in pages.collect():
        assert found[p.page_id].text == article(p.html) and found[p.page_id].n_chars == len(article(p.html)) and found[p.page_id].url == p.url


WORDY = "word " * 50


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<header><h1>Site</h1></header><nav><a href=x>Home</a></nav><main><h1>T</h1><p>One &lt;two&gt;</p><ul><li>a<li>b</ul><div class='advert'>BUY</div><p>x <a href=y>l</a> y</p><form>f</form></main><footer>f</footer>", "T\nOne <two>\na\nb\nx l y"),
        (f"<div id=cookie-notice>We use cookies, a lot of them, accept?</div><div class=content><h1>H</h1><p>S.</p><p>{WORDY}</p><div class=ads><p>b</p><p>b</p><p>b</p><p>b</p></div><p>End.</p></div><div class='post comments'><p>{WORDY * 9}</p></div>", f"H\nS.\n{WORDY.strip()}\nEnd."),
        (f"<h1>Flat</h1><p>a b<p>{WORDY}<p>End<div>&copy; 2020</div>", f"Flat\na b\n{WORDY.strip()}\nEnd"),
        (f"<div><h1>T</h1></div><ul><li><a href=a>x</a><li><a href=b>y</a><li><a href=c>z</a><li><a href=d>w</a></ul><div><p>{WORDY}</p><p>b</p></div>", f"T\n{WORDY.strip()}\nb"),
        (f"<article><p>{WORDY}</p><h3>3 Comments</h3><p>{WORDY * 5}</p></article>", WORDY.strip()),
        ("<body class='has-sidebar header-fixed'><div class='main with-sidebar'><p>text</p></div></body>", "text"),
        ("<form id=aspnet><main><p>text</p></main></form>", "text"),
        ("<article><header><h1>T</h1></header><p>x<p>y<footer>f</footer></article>", "T\nx\ny"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ('<article><p title="a>b">q</p><p title=it\'s>r</p><P CLASS=x>s</p><!-- > -->t</article>', "q\nr\ns\nt"),
        ("<p>a<b>b</p>c</b> d", "ab\nc d"),
        ("<article><p>a &amp b &am", "a & b &am"),
        ("<article><p>a &nbsp;\t b <br> c</p><p> </p></artic", "a b c"),
        ("<script>if (a<b) document.write('<p>x</p>')</script><style>p{}</style>", ""),
        ("plain", "plain"),
        ("<!-- never closed <p>x", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_page(page, text):
    assert extract.main_text(page) == text


@pytest.mark.parametrize("page", ['<p title="' * 100_000, "<" * 300_000, "<div>x" * 30_000, "<script>" * 60_000, "<!--" * 100_000, "<a b='" * 60_000, "<h3>Comments</h3>" * 5_000])
def test_pages_without_an_end_take_linear_time(page):
    assert isinstance(extract.main_text(page), str)


def test_extracted_columns(spark):
    rows = [(1, "<p>a</p>", "old"), (1, "<p>a</p>", "old"), (None, None, None)]
    out = extract.extracted(spark.createDataFrame(rows, "page_id long, html string, text string"))
    assert out.columns == ["page_id", "text"] and sorted(map(tuple, out.collect()), key=str) == [(1, "a"), (1, "a"), (None, "")]
    assert extract.extracted(spark.createDataFrame([], "html string, n int")).collect() == []


# --- 12


def plain_links(text, aligner):
    """(ids of A, ids of B, groups, links) of a text, token by token; None if the tokens do not spell it."""
    if not text:
        return None
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    ends = []
    for ids, v in ((a, aligner.a_bytes), (b, aligner.b_bytes)):
        spelled = [v.spell(np.array([i])).tobytes() for i in ids]
        if b"".join(spelled) != (" " + text).encode():
            return None
        ends.append(np.cumsum([len(x) for x in spelled]).tolist())
    spans = [[*zip([0, *e[:-1]], e, ids, strict=True)] for e, ids in zip(ends, (a, b), strict=True)]
    groups, last = [], 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        groups.append("|".join(",".join(str(i) for s, e, i in side if last <= s < cut) for side in spans))
        last = cut
    links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
    return a, b, groups, links


PARTS = [" ", "  ", "a", "b", "'s", "é", "ß", "日", "本", " ", "　", "\t", "\n", "<s>", "<|endoftext|>", "1", "23", ".", "...", "▁", "́", "😀", "The", " the", "Ж", "\x00", "\x1c", "\u0085", "ﬁ", "%%%", "&amp;"]


def made_texts():
    dice = random.Random(5)
    joined = [dice.choice(["", " "]).join(dice.choice(PARTS) for _ in range(dice.randint(1, 25))) for _ in range(400)]
    return [None, "", " ", "a", " a", "a ", "▁", "word " * 3000, *joined, *joined[:50]]


@pytest.mark.parametrize("head", [align.HEAD, 20, 0])
def test_aligned(spark, head):
    texts, aligner = made_texts(), align.Aligner(queries.BYTE_TOKENIZER, queries.PIECE_TOKENIZER)
    plain = [plain_links(t, aligner) for t in texts]
    count = {}
    for p in plain:
        for link in p[3] if p else ():
            count[link] = count.get(link, 0) + 1
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    docs = spark.createDataFrame([(i, t, "old", 7) for i, t in enumerate(texts)], "doc_id long, text string, groups string, n_a int").repartition(3)
    found = {r.doc_id: r for r in align.aligned(docs, queries.BYTE_TOKENIZER, queries.PIECE_TOKENIZER, head=head).collect()}
    assert len(found) == len(texts)
    for i, p in enumerate(plain):
        r = found[i]
        if p is None:
            assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) == (0,) * 6 + ("",)
            continue
        a, b, groups, links = p
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(groups), len(links)) and r.groups == ";".join(groups)
        assert (r.n_best, r.count_sum) == (sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links))


def test_aligned_query(spark):
    aligner = align.Aligner(queries.BYTE_TOKENIZER, queries.PIECE_TOKENIZER)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    whole = dict(texts)
    for r in queries.op12_align(spark, SMALL).collect():
        if len(texts.pop(r.doc_id) or "") and r.doc_id % 4 == 0:  # the plain version is slow
            p = plain_links(whole[r.doc_id], aligner) if r.n_a < 400 else None
            if p:
                assert r.groups_sha256 == hashlib.sha256(";".join(p[2]).encode()).hexdigest() and r.n_links == len(p[3])
    assert not texts


def test_aligned_empty(spark):
    for rows in ([], [(1, None), (1, "")]):
        out = align.aligned(spark.createDataFrame(rows, "doc_id long, text string"), queries.BYTE_TOKENIZER, queries.PIECE_TOKENIZER)
        assert [r.n_links for r in out.collect()] == [0] * len(rows)


def test_texts_are_tokenized_once(spark):
    """The second pass takes ids from the scratch table; the texts are read once."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(list(enumerate(made_texts())), "doc_id long, text string").localCheckpoint()
    out = align.aligned(docs.mapInArrow(counted, docs.schema), queries.BYTE_TOKENIZER, queries.PIECE_TOKENIZER)
    assert len(out.collect()) == read.value == docs.count()


def test_runs_are_learned_again(monkeypatch):
    aligner, texts = align.Aligner(queries.BYTE_TOKENIZER, queries.PIECE_TOKENIZER), pa.array([f"a{i} b{i} ▁c" for i in range(50)])
    monkeypatch.setattr(align, "KNOWN", 5)
    monkeypatch.setattr(words, "CHUNK_BYTES", 30)
    seen = [(a, b) for a, b, *_ in aligner.texts(texts)]
    assert [x for a, b in seen for x in range(a, b)] == list(range(50)) and any(a == b for a, b in seen)


# --- 13


def plain_runs(s, least):
    """{(start, length): smallest period} by trying every period."""
    out = {}
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = j
    return sorted((a, n, q) for (a, n), q in out.items())


def test_runs_of_made_sequences():
    dice = random.Random(3)
    for _ in range(1500):
        n, k, least = dice.randint(1, 60), dice.choice([1, 2, 3, 5]), dice.choice([2, 4, 12])
        s = [dice.randrange(k) for _ in range(n)]
        a, p = dice.randrange(n), dice.randint(1, n)
        s = [s[i] if i < a or dice.random() < 0.02 else s[min(a + (i - a) % p, n - 1)] for i in range(n)]
        start, end, period = periodic.runs_of(np.array([*s, 99]), least)
        assert sorted(zip(start.tolist(), (end - start).tolist(), period.tolist(), strict=True)) == plain_runs(s, least)


def test_fibonacci_and_long_runs():
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    start, end, period = periodic.runs_of(np.array([*b, 9]), 12)
    assert sorted(zip(start.tolist(), (end - start).tolist(), period.tolist(), strict=True)) == plain_runs(b, 12)
    start, end, period = periodic.runs_of(np.array([1] * 200_000 + [2]), 12)
    assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [200_000], [1])


def test_periodic_columns(spark):
    text = "x " + "a b c " * 5 + "y"
    rows = [(1, text, 5), (1, text, 5), (2, None, 1), (3, "", 1), (4, " \t\n", 1), (5, "a\tb\x0b" * 6, 1), (None, "A a " * 6, 1), (6, "é " * 12, 1)]
    out = periodic.runs(spark.createDataFrame(rows, "doc_id long, text string, n_words int").coalesce(1)).collect()
    made = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out]
    one = (1, 17, [(1, 15, 3)], "x a b c y")
    assert made == [one, one, (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""), (5, 12, [(0, 12, 2)], "a b"), (None, 12, [(0, 12, 2)], "A a"), (6, 12, [(0, 12, 1)], "é")]
    assert periodic.runs(spark.createDataFrame([], "text string")).collect() == []


def test_periodic_query(spark):
    found = {r.doc_id: r for r in queries.op13_periodic(spark, SMALL).collect()}
    table = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    assert len(found) == len(table["doc_id"])
    for doc, text in zip(table["doc_id"], table["text"], strict=True):
        w, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(doc).encode())
        if len(w) > 1500:
            continue
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        own = plain_runs(w, 12)
        gone = {i for s, n, q in own for i in range(s + q, s + n)}
        best = max(own, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(own, key=lambda x: (x[0], x[2])))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        r = found[doc]
        assert r.n_runs == len(own) and (r.start, r.length, r.period) == (best or (None,) * 3) and r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert (r.runs_sha256, r.collapsed_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept))
