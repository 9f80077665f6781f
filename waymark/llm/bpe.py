"""Operator 1: BPE encoding and decoding by a tokenization automaton.

The merges of a byte-level vocabulary compile into a deterministic automaton over
tokens, one merge gadget after another. At first there is one state with a loop
for each byte. The gadget of merge (u, v) -> w takes the state that u leads to,
gives u a copy of it without the arc v, and adds an arc w to the target of v
wherever an arc u leaves. All arcs with one label lead to one state, so a state is
named by its token. A token sequence is accepted if and only if it is the BPE
encoding of its text, and every text has just one; encoding a word is following
the accepted path that spells it, decoding is emitting the labels of the arcs.

The compiled tables are arrays. A copy shares the past of the state it was taken from and an
added arc that of the arc beside it, so with states and labels numbered in the order of
these two forests, the arcs that one gadget takes away are one rectangle of numbers. A state's
row is the union of its rectangles, as runs of labels without an arc; states with equal rows
are one (14,410 rows and 318,000 runs for 50,000 merges). A second table, by node and byte,
spells labels. All words of a batch follow their paths side by side.

Null texts count as empty ones, which have no ids. A token that the file marks as added is one
token where its string occurs in a text, as the library has it. Repeated rows give equal rows.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import words

#: The public pre-split pattern of byte-level vocabularies (a fixed value), which `Encoder.starts` applies to arrays.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER, _LETTER, _NUMBER, _WHITE = range(4)

#: Most pieces, and bytes of pieces, that one Python worker keeps; beyond that it starts afresh. This bounds memory, not results.
MEMO_PIECES, MEMO_BYTES = 150_000, 4 << 20
#: Bytes of text that are worked on at once; a longer text is cut where the pattern cuts as well.
PART = 1 << 18


def byte_alphabet() -> dict[str, int]:
    """Byte by its printable stand-in: printable Latin-1 stands for itself, the rest for U+0100 onwards."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_WHITE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[points[m.start() : m.end()]] = kind
    return out


class _Forest:
    """Numbers of tokens such that a token and all its younger children with what hangs on them are one run that ends with the token."""

    def __init__(self, parent: dict[int, tuple[int, int]], size: int):
        self.children = defaultdict(list)
        for child, (above, at) in parent.items():
            self.children[above].append((at, child))
        self.number, self.least = np.zeros(size, np.int64), np.zeros(size, np.int64)
        n = 0
        for root in range(size):
            todo = [] if root in parent else [(root, 0)]
            while todo:
                x, i = todo.pop()
                if not i:
                    self.least[x] = n
                    self.children[x].sort()
                if i < len(self.children[x]):
                    todo += [(x, i + 1), (self.children[x][i][1], 0)]
                else:
                    self.number[x] = n
                    n += 1

    def since(self, x: int, place: int) -> int:
        """The first number of the children of x from this place on, or of x itself."""
        return self.least[self.children[x][place][1]] if place < len(self.children[x]) else self.number[x]


class TokenAutomaton:
    """The compiled automaton. START is the state before any token."""

    START = -1

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], added: dict[str, int]):
        self.added = added
        size = max(labels) + 1
        label = [labels.get(t, b"") for t in range(size)]
        self.length = np.array([len(x) for x in label])
        self.ends = np.cumsum(self.length)
        self.bytes = np.frombuffer(b"".join(label), np.uint8)
        self._compile_arcs(merges, size)
        merged = {w for _, _, w in merges}
        self._compile_spelling({x: t for t, x in labels.items() if len(x) == 1 or t in merged})
        self.classes = character_classes()

    def _compile_arcs(self, merges: list[tuple[int, int, int]], size: int) -> None:
        copied: dict[int, tuple[int, int]] = {}
        beside: dict[int, tuple[int, int]] = {}
        for at, (u, v, w) in enumerate(merges):
            copied.setdefault(w, (v, at))
            beside.setdefault(w, (u, at))
        states, arcs = _Forest(copied, size), _Forest(beside, size)
        gone = np.zeros((len(merges), 4), np.int64)
        for at, (u, v, _) in enumerate(merges):  # copies of u taken later lack the arc v, and the arcs put beside v since
            gone[at] = states.since(u, bisect_right(states.children[u], (at, size))), states.number[u], arcs.since(v, bisect_left(arcs.children[v], (at, -1))), arcs.number[v]
        times = gone[:, 1] - gone[:, 0] + 1
        which = np.repeat(np.arange(len(merges)), times)
        state = gone[which, 0] + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        order = np.lexsort((gone[which, 2], state))
        state, low, high = state[order], gone[which[order], 2], gone[which[order], 3]
        reach = np.maximum.accumulate(state * size + high) if len(state) else state
        first = np.flatnonzero(np.concatenate([[True], state[1:] * size + low[1:] > reach[:-1] + 1])) if len(state) else state
        state, low = state[first], low[first]
        high = (reach[np.append(first[1:], len(reach)) - 1] - state * size) if len(state) else state
        cut, rows, row_of, runs = np.searchsorted(state, np.arange(size + 1)).tolist(), {}, np.zeros(size, np.int32), []
        for s in range(size):
            key = low[cut[s] : cut[s + 1]].tobytes(), high[cut[s] : cut[s + 1]].tobytes()
            row = rows.setdefault(key, len(rows))
            if row == len(runs):
                runs.append(slice(cut[s], cut[s + 1]))
            row_of[s] = row
        row = np.repeat(np.arange(len(runs)), [r.stop - r.start for r in runs])
        #: by state, its row; by label, its number; and runs of numbers without an arc, in order of row and number
        self.row, self.number = row_of[states.number].astype(np.int64) * size, arcs.number
        self.gone_from = np.concatenate([np.array([-1]), *(low[r] for r in runs)]) + np.concatenate([[0], row * size])
        self.gone_to = np.concatenate([np.array([-1]), *(high[r] for r in runs)]) + np.concatenate([[0], row * size])

    def _compile_spelling(self, token: dict[bytes, int]) -> None:
        if len({x for x in token if len(x) == 1}) < 256:
            raise ValueError("the vocabulary lacks single bytes")
        nodes = {x[:i] for x in token for i in range(1, len(x) + 1)}
        number = {x: i for i, x in enumerate(sorted(nodes, key=lambda x: (len(x), x)))}
        edges = sorted((number[x[:-1]] << 8 | x[-1], i) for x, i in number.items() if len(x) > 1)
        #: the node of each byte, the arcs of the others by node and byte, and the token that a node spells
        self.root = np.array([number[bytes([b])] for b in range(256)], np.int32)
        self.edge, self.target = (np.array(c, np.int64) for c in (zip(*edges, strict=True) if edges else ([-1], [-1])))
        self.token = np.full(len(number), -1, np.int32)
        for x, t in token.items():
            self.token[number[x]] = t

    def has_arc(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Whether arcs with these labels leave these states (of two lists of tokens)."""
        key = self.row[state] + self.number[label]
        return self.gone_to[np.searchsorted(self.gone_from, key, "right") - 1] < key

    def paths(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(labels of the accepted paths of all words, number of labels of each); `data` holds the words, `ends` where each ends."""
        size = np.diff(ends, prepend=0)
        begin, end = np.repeat(ends - size, size), np.repeat(ends, size)
        at, node, found = np.arange(len(data)), self.root[data].astype(np.int64), []
        for k in range(len(data)):  # every label that spells k + 1 bytes from a place on
            t = self.token[node]
            found.append((at[t >= 0], np.full(int((t >= 0).sum()), k), t[t >= 0]))
            more = at + k + 1 < end[at]
            at, key = at[more], node[more] << 8 | data[at[more] + k + 1]
            place = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            known = self.edge[place] == key
            at, node = at[known], self.target[place[known]]
            if not len(at):
                break
        at, more, t = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else ((), (), ())))
        far = at - begin[at]
        order = np.argsort(far, kind="stable")
        at, more, t = at[order], more[order], t[order]
        cuts = np.searchsorted(far[order], np.arange(int(size.max(initial=0)) + 1)).tolist()
        #: the label that ends at each byte on the one path there
        last = np.full(len(data), -1, np.int64)
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            label, stop = t[a:b], at[a:b] + more[a:b]
            if k:
                ok = self.has_arc(last[at[a:b] - 1], label)
                label, stop = label[ok], stop[ok]
            last[stop] = label
        count, back = np.zeros(len(ends), np.int64), []
        word, place = np.flatnonzero(size), ends[size > 0] - 1
        while len(word):
            label = last[place]
            back.append((word, count[word].copy(), label))
            count[word] += 1
            place = place - self.length[label]
            left = place >= ends[word] - size[word]
            word, place = word[left], place[left]
        out, stops = np.zeros(int(count.sum()), np.uint32), np.cumsum(count)
        for word, k, label in back:
            out[stops[word] - 1 - k] = label
        return out, count


def load(path: str) -> TokenAutomaton:
    """Compile the automaton of a byte-level BPE file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
    labels = {t: bytes(alphabet[c] for c in x) for x, t in vocab.items()}
    merges = []
    for m in spec["model"]["merges"]:
        u, v = m if isinstance(m, list) else m.split(" ")
        merges.append((vocab[u], vocab[v], vocab[u + v]))
    added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
    labels |= {t: x.encode() for x, t in added.items()}
    return TokenAutomaton(labels, merges, added)


class Encoder:
    """Ids of texts; keeps the ids of pieces met before, told apart by their bytes."""

    def __init__(self, automaton: TokenAutomaton):
        self.automaton = automaton
        added = sorted(automaton.added, key=len, reverse=True)
        self.special = re.compile(b"|".join(re.escape(x.encode()) for x in added) or rb"(?!)")
        self.cut_inside = not any(" " in x for x in added)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {x.encode(): i for i, x in enumerate(self.automaton.added)}
        self.pool = np.array(list(self.automaton.added.values()), np.uint32)
        self.at, self.size = np.arange(len(self.pool)), np.ones(len(self.pool), np.int64)
        self.bytes = 0

    def starts(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where the pieces of PRE_SPLIT start; `edges` are the starts of texts, which no piece crosses."""
        if (data < 0x80).all():
            c, offsets = data, None
        else:
            c = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
            offsets = np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)) if len(c) else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], offsets])
            edges = np.searchsorted(offsets, edges)
        n, kind = len(c), self.automaton.classes[c]
        edge = np.zeros(n + 3, bool)
        edge[edges] = True
        start = edge.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        white = kind == _WHITE
        after = np.flatnonzero(white[:-1] & ~white[1:] & ~edge[1:n]) + 1  # text after white space: the last blank goes with it
        start[after] = c[after - 1] != 0x20
        start[after - 1] = True
        for p in self._contractions(c, start, edge, n):
            start[p[0] + 1] = False
            start[p[1]] = True
        found = np.flatnonzero(start[:n])
        return found if offsets is None else offsets[found]

    @staticmethod
    def _contractions(c: np.ndarray, start: np.ndarray, edge: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of the apostrophe, where the next piece starts) of 's 't 'm 'd, then of 're 've 'll."""
        p = np.flatnonzero((c == 0x27) & start[:n])
        p = p[p + 1 < n]
        p = p[~edge[p + 1]]
        one = p[np.isin(c[p + 1], list(b"stmd"))]
        yield one, one + 2
        p = p[p + 2 < n]
        p = p[~edge[p + 2]]
        two = p[np.isin(c[p + 1].astype(np.uint32) << 8 | c[p + 2], [a << 8 | b for a, b in (b"re", b"ve", b"ll")])]
        yield two, two + 3

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of whole texts, or parts of a long one, which end before a blank between two letters or digits of ASCII."""
        a, stop = int(offsets[0]), int(offsets[-1])
        plain = words.ALNUM & (np.arange(256) < 0x80)
        while a < stop:
            b = int(offsets[np.searchsorted(offsets, a + PART, "right") - 1])
            if b <= a:
                b = int(offsets[np.searchsorted(offsets, a, "right")])
                for at in range(a + PART, b if self.cut_inside else 0, PART):
                    x = data[at : min(at + PART, b)]
                    here = np.flatnonzero((x[1:-1] == 0x20) & plain[x[:-2]] & plain[x[2:]])
                    if len(here):
                        b = at + 1 + int(here[0])
                        break
            yield a, b
            a = b

    def _which(self, pieces: pa.Array) -> np.ndarray:
        """The place of each piece among the known ones; new ones are encoded first."""
        coded = pieces.dictionary_encode()
        names, indices = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        place = np.array([self.known.get(x, -1) for x in names])
        new = np.flatnonzero(place < 0)
        if len(self.known) + len(new) > MEMO_PIECES or self.bytes > MEMO_BYTES:
            self.forget()
            place = np.array([self.known.get(x, -1) for x in names])
            new = np.flatnonzero(place < 0)
        if len(new):
            data, ends = words.buffers(coded.dictionary.take(pa.array(new)))
            ids, size = self.automaton.paths(data[ends[0] : ends[-1]], ends[1:] - ends[0])
            place[new] = len(self.size) + np.arange(len(new))
            self.known |= zip([names[i] for i in new.tolist()], place[new].tolist(), strict=True)
            self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(size) - size])
            self.pool, self.size = np.concatenate([self.pool, ids]), np.concatenate([self.size, size])
            self.bytes += int(ends[-1] - ends[0])
        return place[indices]

    def encode_column(self, col: pa.Array) -> pa.Array:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        data, offsets = words.buffers(col)
        out, total, before = [], 0, np.zeros(len(offsets), np.int64)
        try:
            for a, b in self._parts(data, offsets):
                part = data[a:b]
                inside = (offsets >= a) & (offsets < b)
                edges = np.unique(np.append(offsets[inside] - a, 0))
                held = [m.span() for m in self.special.finditer(part.tobytes())] if self.automaton.added else []
                held = [(s, e) for s, e in held if not ((edges > s) & (edges < e)).any()]
                edges = np.unique(np.concatenate([edges, *held])).astype(np.int64) if held else edges
                starts = self.starts(part, edges[edges < len(part)])
                for s, e in held:
                    starts = starts[(starts <= s) | (starts >= e)]
                bounds = pa.py_buffer(np.append(starts, len(part)).astype(np.int32).tobytes())
                which = self._which(pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, bounds, pa.py_buffer(part.tobytes())]))
                size = self.size[which]
                out.append(self.pool[words.spread(self.at[which], size)].tobytes())
                passed = np.concatenate([[0], np.cumsum(size)])
                before[inside] = total + passed[np.searchsorted(starts, offsets[inside] - a)]
                total += int(passed[-1])
        except UnicodeDecodeError:  # not UTF-8: what is not becomes U+FFFD
            return self.encode_column(pa.array([x.decode("utf-8", "replace") for x in col.cast(pa.binary()).fill_null(b"").to_pylist()], pa.string()))
        before[offsets == offsets[-1]] = total
        return pa.BinaryArray.from_buffers(pa.binary(), len(col), [None, pa.py_buffer((before * 4).astype(np.int32).tobytes()), pa.py_buffer(b"".join(out))])


class Decoder:
    """Texts of ids: the labels of the arcs, joined; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, automaton: TokenAutomaton):
        self.bytes, self.length, self.at = automaton.bytes, automaton.length, automaton.ends - automaton.length

    def decode_column(self, col: pa.Array) -> pa.Array:
        raw, offsets = words.buffers(col.fill_null(b"") if col.null_count else col)
        ids = np.frombuffer(raw[offsets[0] : offsets[-1]].tobytes(), "<u4")
        ends = np.concatenate([[0], np.cumsum(self.length[ids])])
        parts = [self.bytes[words.spread(self.at[x], self.length[x])].tobytes() for x in (ids[i : i + PART] for i in range(0, len(ids), PART))]
        text, cuts = b"".join(parts), ends[(offsets - offsets[0]) // 4]
        first = np.frombuffer(text, np.uint8)[cuts[cuts < len(text)]]
        try:
            text.decode("utf-8")
            whole = not ((first & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if not whole:
            return pa.array([text[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.string())
        return pa.StringArray.from_buffers(len(col), pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(text))


_tools_of: list = []


def _tools(automaton: TokenAutomaton) -> tuple[Encoder, Decoder]:
    """The encoder and decoder of an automaton; a worker keeps those it used last from task to task."""
    if not _tools_of or _tools_of[0] is not automaton:
        _tools_of[:] = automaton, Encoder(automaton), Decoder(automaton)
    return _tools_of[1], _tools_of[2]


def _add(df: DataFrame, tokenizer: str, source: str, added: list[tuple[str, T.DataType]], work) -> DataFrame:
    """`df` with columns that `work(encoder, decoder, values)` makes of the column `source`; older columns of these names go."""
    spark = df.sparkSession
    names = [n for n, _ in added]
    kept = [c for c in df.columns if c not in names or c == source]
    shared = spark.sparkContext.broadcast(load(tokenizer))
    schema = T.StructType([df.schema[c] for c in kept if c not in names] + [T.StructField(n, t) for n, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _tools(shared.value)
        for batch in batches:
            made = work(encoder, decoder, batch.column(batch.schema.get_field_index(source)))
            columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in names]
            yield pa.RecordBatch.from_arrays(columns + made, names=[n for n in batch.schema.names if n not in names] + names)

    return df.select(*[df[c] for c in kept]).mapInArrow(run, schema)


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`df` with the column `ids`: each text's ids, packed as little-endian unsigned 32-bit integers."""
    return _add(df, tokenizer, text, [(ids, T.BinaryType())], lambda e, d, x: [e.encode_column(x)])


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`df` with the column `text`: the text of packed ids; null ids give the empty text."""
    return _add(df, tokenizer, ids, [(text, T.StringType())], lambda e, d, x: [d.decode_column(x)])


def round_trip(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`encode` and then `decode` of its ids, in one pass over the texts."""

    def work(e: Encoder, d: Decoder, x: pa.Array) -> list[pa.Array]:
        packed = e.encode_column(x)
        return [packed, d.decode_column(packed)]

    return _add(df, tokenizer, text, [(ids, T.BinaryType()), (decoded, T.StringType())], work)
