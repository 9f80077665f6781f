"""Operator 9: toxicity by weak supervision.

Voters look at a text: one for each entry of a lexicon (words and word beginnings that occur
far more often in toxic labelled texts), pattern voters for how a text looks, and a voter for
clean where no entry occurs. A generative label model, fitted without labels, estimates by
expectation maximisation how often each voter speaks on toxic and on clean texts; voters
that still agree beyond that are correlated, and share their weight. A linear classifier
learns the posterior labels from counts of the entries and text statistics.

Null and empty texts get the score of a text without entries. Without both labels, or with no word that tells them apart, all scores
are 0. Repeated rows teach and are scored each by itself; of equally good entries the one with the smaller hash comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import labelled, textstats, words
from .scratch import save

#: Entries of the lexicon at most; toxic texts that hold an entry at least, and how much likelier it is there, where there are labels enough.
ENTRIES, SUPPORT, LIFT = 400, 8, 50.0
#: How many of the entries may be there by chance.
CHANCE = 0.1
#: Lengths of word beginnings, in bytes.
STEMS = (3, 4, 5, 6, 7, 8)


def _terms(w: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of words without marks around them, and of the beginnings of longer words."""
    hashes, of = [w.hashes()], [np.arange(len(w.start))]
    for n in STEMS:
        longer = np.flatnonzero(w.end - w.start > n)
        stems = words.Words(w.data, w.at, w.start[longer], w.start[longer] + n, w.text[longer], w.first)
        hashes.append(words.mix(stems.hashes() + np.uint64(n)))
        of.append(longer)
    return np.concatenate(hashes), np.concatenate(of)


@dataclass
class Lexicon:
    """Hashes of entries in order, and the rank of each: 0 is the best entry."""

    hashes: np.ndarray
    rank: np.ndarray

    @classmethod
    def of(cls, best_first: np.ndarray) -> Lexicon:
        order = np.argsort(best_first)
        return cls(best_first[order], order)

    def __len__(self) -> int:
        return len(self.hashes)

    def matches(self, w: words.Words) -> tuple[np.ndarray, np.ndarray]:
        """(text, rank) of every word that has an entry; a word counts for the best of its entries alone."""
        best = np.full(len(w.start), len(self))
        if len(self) and len(best):
            h, of = _terms(w)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self) - 1)
            ok = self.hashes[at] == h
            np.minimum.at(best, of[ok], self.rank[at[ok]])
        hit = best < len(self)
        return w.text[hit], best[hit]


def _floors(n: dict[int, int]) -> tuple[int, float]:
    """(toxic texts, likelihood) that entries are asked for: with fewer labels fewer texts, and no more than half of the best that so many can show."""
    support = max(2, min(SUPPORT, -(-n[1] // 25)))
    return support, min(LIFT, 0.5 * (support / n[1]) / (0.5 / n[0]))


def _chosen(counts: DataFrame, n: dict[int, int], most: int, support: int, lift: float) -> np.ndarray:
    """Terms of (term, toxic, clean, kinds) that are frequent in toxic texts of many kinds and far likelier there, the surest first.

    Of very many terms some are in toxic texts alone by chance. How likely that is of a term that has nothing to do with toxicity is
    bounded (Chernoff); terms are taken in the order of this bound as long as at most CHANCE of those taken are expected to be there by chance, of all
    terms that occur often enough to be told from it (Benjamini and Hochberg).
    """
    share, total = n[1] / (n[0] + n[1]), F.col("kinds") + F.col("clean")
    rate = (F.col("toxic") / n[1]) / ((F.col("clean") + 0.5) / n[0])
    part = lambda k, p: F.when(k > 0, k * F.log(k / (total * p))).otherwise(0.0)
    surety = F.when(F.col("kinds") > total * share, part(F.col("kinds"), share) + part(F.col("clean"), 1 - share)).otherwise(0.0)
    tested = counts.where(total * -np.log(share) >= np.log(1000)).withColumn("surety", surety)
    fine = tested.where((F.col("kinds") >= support) & (F.col("kinds") * 2 >= F.col("toxic")) & (rate >= lift))
    best = fine.orderBy(F.desc("surety"), "term").limit(most).select("term", "surety").toArrow()
    chance, m = np.exp(-best.column("surety").to_numpy()), tested.count()
    ok = np.flatnonzero(chance * m <= CHANCE * np.arange(1, len(chance) + 1))
    return best.column("term").to_numpy()[: ok[-1] + 1 if len(ok) else 0]


def _tally(rows: DataFrame, pick, apart: bool) -> DataFrame:
    """(term, toxic, clean, kinds): texts with a term. kinds: toxic ones, near copies of a text counted (mostly) once if `apart`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy()
            for a, b, w in words.scan(batch.column(2), words.ALNUM):
                text, term = pick(w)
                order = np.lexsort((term, text))
                term, text = term[order], text[order]
                fresh = np.concatenate([[True], (term[1:] != term[:-1]) | (text[1:] != text[:-1])]) if len(term) else np.zeros(0, bool)
                term, text = term[fresh], text[fresh]
                toxic = label[a:b][text]
                if apart:
                    runs, least = words.runs(w.hashes(), 5), np.full(b - a, np.iinfo(np.uint64).max, np.uint64)
                    np.minimum.at(least, w.text[: len(runs)], runs)
                    made = [term, toxic.astype(np.int64), 1 - toxic.astype(np.int64), np.where(toxic == 1, least[text].view(np.int64), 0)]
                else:
                    term, inverse = np.unique(term, return_inverse=True)
                    bad = np.bincount(inverse, weights=toxic, minlength=len(term)).astype(np.int64)
                    made = [term, bad, np.bincount(inverse, minlength=len(term)) - bad, np.zeros(len(term), np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in made], names=["term", "toxic", "clean", "kind"])

    found = rows.mapInArrow(run, "term bigint, toxic bigint, clean bigint, kind bigint").groupBy("term")
    kinds = F.count_distinct(F.when(F.col("toxic") > 0, F.col("kind"))) if apart else F.sum("toxic")
    return found.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), kinds.alias("kinds"))


def _lexicon(rows: DataFrame) -> Lexicon:
    """Entries from the labelled sample: first all terms by themselves, then those that some words have as their best."""

    def every(w: words.Words) -> tuple[np.ndarray, np.ndarray]:
        h, of = _terms(w)
        return w.text[of], h

    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    if not n.get(0) or not n.get(1):
        return Lexicon.of(np.zeros(0, np.uint64))
    (support, lift), counts = _floors(n), save(_tally(rows, every, False))
    while True:
        first = _chosen(counts, n, 5 * ENTRIES, support, lift).view(np.uint64)
        wide = Lexicon.of(first)

        def best(w: words.Words, wide: Lexicon = wide) -> tuple[np.ndarray, np.ndarray]:
            text, rank = wide.matches(w)
            return text, rank.astype(np.int64)

        made = first[_chosen(_tally(rows, best, True), n, ENTRIES, support, lift)] if len(first) else first
        if len(made) or lift < 1.5:
            return Lexicon.of(made)
        support, lift = max(1, support // 2), lift / 3  # toxic words are less telling here


def _observed(w: words.Words, plain: words.Words, lexicon: Lexicon) -> np.ndarray:
    """A row for each text: counts of the entries by rank, then the statistics of the text."""
    counts = np.zeros((len(w.at) - 1, len(lexicon)))
    np.add.at(counts, lexicon.matches(w), 1)
    return np.concatenate([counts, textstats.statistics(plain)], axis=1)


def _scan(col: pa.Array, lexicon: Lexicon) -> Iterator[tuple[int, int, np.ndarray]]:
    for a, b, plain in words.scan(col, words.SPACED, lower=False):
        yield a, b, _observed(words.split(plain.data, plain.at, words.ALNUM), plain, lexicon)


def votes(observed: np.ndarray, entries: int) -> np.ndarray:
    """A column for each voter: 1 if it speaks. Entry voters, then clean, shouting, capitals and symbols."""
    counts, stats = observed[:, :entries], dict(zip(textstats.NAMES, observed[:, entries:].T, strict=True))
    patterns = [counts.sum(1) == 0, stats["shout"] > 0.02, stats["upper"] > 0.3, stats["symbol"] > 0.05]
    return np.concatenate([counts > 0, np.stack(patterns, axis=1)], axis=1).astype(float)


def label_model(v: np.ndarray, prior: float, entries: int, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of toxic, rates of speaking on clean and toxic texts, correlations of the voters).

    An entry that does not occur abstains. Voters that are correlated share their weight on the texts on which they
    speak together, so ten forms of one word count hardly more than one.
    """
    post = np.clip(v[:, :entries].max(1, initial=0), 0.02, 0.98)
    rates, together = np.zeros((2, v.shape[1])), np.zeros((v.shape[1], v.shape[1]))
    for step in range(rounds):
        before = post
        total = np.stack([1 - post, post])
        rates = (total @ v + 1e-2) / (total.sum(1)[:, None] + 2e-2)
        if step in (1, 5, 15):  # correlations: what voters share beyond the label
            rest = v - (rates[0] + np.outer(post, rates[1] - rates[0]))
            spread = np.sqrt((rest**2).sum(0)) + 1e-9
            together = np.abs(rest.T @ rest / np.outer(spread, spread))
            together[together < 0.1] = 0
            np.fill_diagonal(together, 0)
        said = v * (np.log(rates[1]) - np.log(rates[0])) / (1 + v @ together)
        silent = ((1 - v) * (np.log1p(-rates[1]) - np.log1p(-rates[0])))[:, entries:]
        post = 1 / (1 + np.exp(-np.clip(said.sum(1) + silent.sum(1) + np.log(prior / (1 - prior)), -35, 35)))
        if np.abs(post - before).max() < 1e-6:
            break
    return post, rates, together


@dataclass
class Model:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, observed: np.ndarray) -> np.ndarray:
        x = (_inputs(observed, len(self.lexicon)) - self.mean) / self.scale
        z = np.concatenate([x, np.ones((len(x), 1))], axis=1) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _inputs(observed: np.ndarray, entries: int) -> np.ndarray:
    counts, stats = observed[:, :entries], observed[:, entries:]
    return np.concatenate([np.log1p(counts), np.minimum(counts.sum(1, keepdims=True), 1), np.log1p(counts.sum(1, keepdims=True)), stats], axis=1)


def fit(rows: DataFrame) -> Model | None:
    """Learn from (doc, label, text); None if there are not both labels, or nothing tells toxic texts."""
    rows = save(rows)
    lexicon = _lexicon(rows)
    if not len(lexicon):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, observed in _scan(batch.column(2), lexicon):
                packed = pa.array([r.astype(np.float32).tobytes() for r in observed], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), packed], names=["doc", "label", "f"])

    kind = rows.schema["doc"].dataType.simpleString()
    table = rows.select("doc", "label", "text").mapInArrow(run, f"doc {kind}, label int, f binary").orderBy("doc", "f").toArrow()
    label = table.column("label").to_numpy()
    observed = np.frombuffer(b"".join(table.column("f").to_pylist()), np.float32).reshape(len(label), -1).astype(float)
    post, _, _ = label_model(votes(observed, len(lexicon)), float(np.clip(label.mean(), 0.001, 0.999)), len(lexicon))
    x = _inputs(observed, len(lexicon))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    return Model(lexicon, mean, scale, textstats.logistic(x, post, ridge=3.0))


def classify(docs: DataFrame, labels: DataFrame, usable: Column | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with `score` (0 to 1, higher is likelier toxic) and `predicted` (1 from 0.5 on), learned from `labels.toxic`.

    Older columns of these names are replaced.
    """
    usable = labelled.trainable() if usable is None else usable
    model = fit(labelled.sample(docs, labels, "toxic", usable, doc, text))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "score"]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value.lexicon if shared.value else Lexicon.of(np.zeros(0, np.uint64))
        for batch in batches:
            for a, b, observed in _scan(batch.column(batch.schema.get_field_index(text)), lexicon):
                made = shared.value.score(observed) if shared.value else np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(made)], names=schema.names)

    out = docs.select(*[docs[c] for c in kept]).mapInArrow(run, schema)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
