"""The similarity join of two tables of names, as an equi-join of q-grams and exact scores of the pairs it proposes.

A score from the cutoff on needs a common subsequence of the two strings, or of the shorter one and a window of the longer one. With L of
m and w characters in it, at least (2q - 1) L - (q - 1) (m + w) - q + 1 grams of q characters are common: a character left out breaks q
of the first string's grams, one put in breaks q - 1. For each length of a token and each class of lengths of names the largest q with which that is one gram at
least is used. If `least` of a token's grams are common, the rarest (all - least + 1) of them hold one that is (prefix filter): these
are the token's keys, all grams of a name are the name's, and both hold the class of the name's length. Rare grams come first, by
their counts over the names; only the GRAMS most frequent ones are counted, which bounds what the driver sees. That order has no bearing on the result.
Pairs that share a key are made distinct and scored only if their letters allow the strict cutoff: a letter that one string has and the other
has not is not in a common subsequence (`allowed`).

Lenient scores also gain from common words, so words are keys as well; how many pairs share a frequent word is how many the lenient score accepts,
in the main. Neither side is collected or has to fit into a task: Spark chooses broadcast or shuffle by size, and splits keys that are skewed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, floor, log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import scores

#: Frequent grams whose order is by count.
GRAMS = 4096
#: Characters of grams, the most telling ones first. Lengths in one class differ by a quarter; those over the last class are in it.
SIZES, STEP, CLASSES = (4, 3, 2, 1), 1.25, 31
#: Up to this length what has to be common is counted exactly, beyond by a bound without rounding.
EXACT = 48


@dataclass(frozen=True)
class Form:
    """A form of strings and what makes two of them similar: their ratio, or that of the shorter one to a window, from a value on.

    window(m, n) is that value for strings of m <= n characters; over 100 if no window can help. `most`: how many times as long the longer one is at most.
    """

    name: str
    of: Callable[[str], str]
    whole: float
    window: Callable[[int, int], float]
    most: float


def forms(scorer: str, cutoff: float) -> list[Form]:
    """All ways in which a score reaches the cutoff (from 50 on), but for common words."""
    if not 50 <= cutoff <= 100:
        raise ValueError(f"the cutoff has to be from 50 to 100, not {cutoff}")
    in_order = lambda x: " ".join(sorted(x.split()))
    once = lambda x: " ".join(sorted(set(x.split())))
    scaled = lambda m, n: cutoff * n / m
    if scorer == "strict":
        return [Form("raw", str, 101.0, scaled, 100 / cutoff), Form("sorted", in_order, cutoff, lambda m, n: 101.0, 200 / cutoff - 1)]
    # the weighted ratio takes partial ratios times 0.9 and 0.95 * 0.9 where one string is 1.5 to 8 times as long, and sets of words times 0.95
    far = lambda m, n: cutoff / 0.9 if 1.5 * m <= n < 8 * m else 101.0
    far_words = lambda m, n: cutoff / 0.855
    return [
        Form("raw", str, cutoff, lambda m, n: min(scaled(m, n), far(m, n)), 8.0),
        Form("sorted", in_order, cutoff, far_words, float("inf")),
        Form("distinct", once, cutoff / 0.95, far_words, float("inf")),
    ]


def length_class(n: int) -> int:
    return min(int(log(n) / log(STEP) + 1e-9), CLASSES - 1)


def _common_grams(form: Form, m: int, n: int) -> dict[int, int] | None:
    """For each q, how many grams of q characters are common at least to similar strings of m <= n characters; None if none are similar."""
    grams = lambda q, least, total: (2 * q - 1) * least - (q - 1) * total - q + 1
    part, found = form.window(m, n), []
    if m <= EXACT:
        for c, w in [(form.whole, n)] + [(part, k) for k in range(1, m + 1)]:
            least = max(1, ceil(c * (m + w) / 200 - 1e-9))
            if c <= 100 + 1e-9 and least <= min(m, w):
                found.append((least, m + w))
    else:  # linear in m + w, so the least value is at an end
        for c, totals in ((form.whole, [m + n]), (part, [m + m * c / (200 - c), 2 * m] if (c := part) < 200 else [])):
            found += [(c * t / 200, t) for t in totals if c <= 100 + 1e-9 and c * t / 200 <= m + 1e-9]
    return {q: min(floor(grams(q, least, total) + 1e-9) for least, total in found) for q in SIZES} if found else None


@lru_cache(maxsize=None)
def _probes(scorer: str, cutoff: float, at: int, m: int, longest: int) -> tuple[tuple[int, int, int], ...]:
    """(class, q, least): for tokens of m characters in a form, the grams they need in common with names of a class of lengths, up to the class `longest`."""
    form, out = forms(scorer, cutoff)[at], []
    reach = int(min(form.most, 8) * m) + 1  # of still longer names only windows count, which no longer depend on the length
    for c in range(longest + 1):
        low, high = (next(n for n in range(max(1, int(STEP**k) - 1), int(STEP**k) + 3) if length_class(n) >= min(k, CLASSES - 1)) for k in (c, c + 1))
        high = 10 * reach if c == CLASSES - 1 else high
        lengths = [n for n in range(low, min(high, reach + 1))] or ([low] if low < high and form.most > 8 else [])
        found = [x for n in lengths if length_class(n) == c and (x := _common_grams(form, *sorted((m, n))))]
        if found:
            q = next((q for q in SIZES if min(x[q] for x in found) >= 1), 1)
            out.append((c, q, max(1, min(x[q] for x in found))))
    return tuple(out)


def token_keys(text: str, scorer: str, cutoff: float, rank: dict[str, int], longest: int = CLASSES - 1) -> set[str]:
    """Keys that a token is looked up by, among names up to the class `longest`."""
    out = {f"w{w}" for w in text.split()} if scorer == "lenient" else set()
    for at, form in enumerate(forms(scorer, cutoff)):
        x = form.of(text)
        rarest: dict[int, list[str]] = {}
        for c, q, least in _probes(scorer, cutoff, at, len(x), longest) if x else ():
            if q not in rarest:
                rarest[q] = sorted((x[i : i + q] for i in range(len(x) - q + 1)), key=lambda g: (rank.get(g, 0), g))
            out.update(f"{at}.{c}.{g}" for g in rarest[q][: len(rarest[q]) - least + 1])
    return out or {""}


def name_keys(text: str, scorer: str, cutoff: float) -> set[str]:
    """Keys under which a name is found."""
    out = {f"w{w}" for w in text.split()} if scorer == "lenient" else set()
    for at, form in enumerate(forms(scorer, cutoff)):
        x = form.of(text)
        if x:
            out.update(f"{at}.{length_class(len(x))}.{x[i : i + q]}" for q in SIZES for i in range(len(x) - q + 1))
    return out or {""}


def _gram_ranks(names: DataFrame) -> dict[str, int]:
    """Places of the most frequent grams of the names, the rarest of them first; all others come before them."""
    gram = lambda q: F.when(F.length("normal") >= q, F.transform(F.sequence(F.lit(1), F.length("normal") - (q - 1)), lambda i: F.substring("normal", i, F.lit(q))))
    grams = names.select(F.explode(F.concat(*[F.coalesce(gram(q), F.array().cast("array<string>")) for q in SIZES])).alias("g"))
    frequent = grams.groupBy("g").count().orderBy(F.desc("count"), "g").limit(GRAMS).collect()
    return {r.g: len(frequent) - i for i, r in enumerate(frequent)}


def lengths(cutoff: float, least: int, most: int) -> tuple[int, int]:
    """The lengths of tokens that may reach the strict cutoff (from 50 on) with names of `least` to `most` characters."""
    return ceil(least / (200 / cutoff - 1) - 1e-9), floor(most * (200 / cutoff - 1) + 1e-9)


def _letters(x: str) -> int | None:
    """A bit for each of 63 classes of characters; none for strings whose white space is not in normal form."""
    return sum({1 << ord(c) % 63 for c in x}) if x == " ".join(x.split()) else None


def allowed(cutoff: float) -> Column:
    """Whether the lengths and letters of (normal, letters, name_normal, name_letters) allow the strict cutoff."""
    a, b = F.length(F.coalesce("normal", F.lit(""))), F.length(F.coalesce("name_normal", F.lit("")))
    apart = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    short, long, c = F.least(a, b), F.greatest(a, b), F.lit(cutoff - 1e-6)
    common = F.least(a - apart("letters", "name_letters"), b - apart("name_letters", "letters"))
    whole, window = 200 * common >= c * (a + b), 200.0 * common * short >= c * long * (short + common)
    return F.coalesce(whole | window, F.lit(True))


def _keyed(df: DataFrame, keys: Callable[[str], set[str]]) -> DataFrame:
    """(key, the two columns of df, letters): a row for each key of the second column."""
    given, normal = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            made, held = [list(keys(x)) for x in texts], pa.array([_letters(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.string())), batch.column(0), batch.column(1), held], names=["keys", given, normal, "letters"])

    # strings leave Python once, not with each key
    return df.mapInArrow(run, f"keys array<string>, {given} string, {normal} string, letters long").select(F.explode("keys").alias("key"), given, normal, "letters")


def proposed(tokens: DataFrame, names: DataFrame, scorer: str, cutoff: float) -> DataFrame:
    """(token, normal, name, name_normal): pairs that may have the score, each once."""
    forms(scorer, cutoff)  # an unusable cutoff is an error here, not in a task
    tokens = tokens.select("token", "normal").distinct()
    names = names.select("name", F.col("normal").alias("name_normal")).distinct()
    rank = _gram_ranks(names.select(F.col("name_normal").alias("normal")))
    longest = length_class(max(1, names.agg(F.max(F.length("name_normal"))).first()[0] or 0))
    left, right = _keyed(tokens, lambda x: token_keys(x, scorer, cutoff, rank, longest)), _keyed(names, lambda x: name_keys(x, scorer, cutoff))
    pairs = left.join(right.withColumnRenamed("letters", "name_letters"), "key")
    pairs = pairs.where(allowed(cutoff)) if scorer == "strict" else pairs
    return pairs.select("token", "normal", "name", "name_normal").distinct()


def similar(tokens: DataFrame, names: DataFrame, scorer: str, cutoff: float) -> DataFrame:
    """(token, name, score): distinct pairs from the cutoff on. `tokens` has token and normal, `names` has name and normal.

    `scorer` is strict or lenient. Null counts as empty, and two empty strings as equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = scores(scorer, *([x or "" for x in batch.column(k).to_pylist()] for k in (1, 3)))
            kept = pa.array(made >= cutoff)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(2).filter(kept), pa.array(made).filter(kept)], names=["token", "name", "score"])

    return proposed(tokens, names, scorer, cutoff).mapInArrow(run, "token string, name string, score double")
