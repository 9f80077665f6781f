"""Operator 10: a quality classifier by Bradley-Terry pairwise ranking.

A document's score is linear in the statistics of its text. It is learned from preference
pairs, a good labelled document over a bad one, by the logistic loss on the difference of
their features. The score quantile at the share of bad documents is the threshold; scores are
scaled so that it is CUT, and so that they are as sharp as the labels are.

Every labelled document is compared. Documents are dealt by a hash into groups with about RIVALS of the rarer label each, and within a group
each is compared with all of the other label, so that comparisons grow with the documents, not with their square. Statistics stay
in the tasks; each step of the fit is a job, of which the driver gets the sums. These are of whole numbers, so their order does not show.

Null and empty texts are scored by all-zero statistics. Of several texts of one id that with the least statistics
teaches. Without both labels all scores are CUT.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import labelled, textstats, words
from .scratch import save

CUT = 0.3
#: Documents of the rarer label in a group at least, where there are as many; about how many of the other label are in one part of it.
RIVALS, WIDTH = 20, 2000
#: Sums are of whole numbers of 1 / UNIT.
UNIT = float(1 << 24)
#: Tasks of a step of the fit at most.
TASKS = 64
#: Bins of a step towards the threshold, and steps: to 2^-48 of the range of scores.
BINS, STEPS = 4096, 4


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    threshold: float

    def score(self, f: np.ndarray) -> np.ndarray:
        raw = ((textstats.expanded(f) - self.mean) / self.scale) @ self.weights
        z = self.slope * (raw - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _features(rows: DataFrame) -> DataFrame:
    """(doc, label, f) of (doc, label, text), a row for each id; f holds packed statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in words.scan(batch.column(2), words.SPACED, lower=False):
                made = pa.array([x.tobytes() for x in textstats.statistics(w)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), made], names=["doc", "label", "f"])

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, label int, f binary").groupBy("doc", "label").agg(F.min("f").alias("f"))


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), len(textstats.NAMES))


def _dealt(rows: DataFrame, n: dict[int, int]) -> DataFrame:
    """(part, bad, good): lists of packed statistics to compare with each other. The more frequent label of a group is in parts, each with the whole rarer label."""
    rare = int(n[1] < n[0])
    groups = max(1, n[rare] // RIVALS)
    parts = max(1, -(-n[1 - rare] // (groups * WIDTH)))
    own = F.array(F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(parts)).cast("int"))
    dealt = rows.select(F.pmod(F.xxhash64("doc"), F.lit(groups)).alias("group"), F.explode(F.when(F.col("label") == rare, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(own)).alias("part"), "label", "f")
    listed = [F.array_sort(F.collect_list(F.when(F.col("label") == k, F.col("f")))).alias(name) for k, name in enumerate(("bad", "good"))]
    return dealt.groupBy("group", "part").agg(*listed).select("part", *("bad", "good"))


def _sums(rows: DataFrame, size: int, work: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum of work(*columns of a batch) over all batches: `size` whole numbers of 1 / UNIT, which do not depend on how rows fall into batches.

    Each of TASKS tasks at most has one row for its sum, and the driver adds these: no shuffle, whose tasks and threads the driver would have to keep.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += work(*batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    made = rows.coalesce(TASKS).mapInArrow(run, "sums binary").collect()
    return sum((np.frombuffer(r.sums, np.int64) for r in made), np.zeros(size, np.int64)) / UNIT


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * UNIT).astype(np.int64)


def _by_part(dealt: DataFrame, size: int, work: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of work(part, statistics of the bad, of the good) over all parts of groups."""

    def all_parts(part: pa.Array, bad: pa.Array, good: pa.Array) -> np.ndarray:
        return sum((_whole(work(k.as_py(), _unpacked(x.values), _unpacked(y.values))) for k, x, y in zip(part, bad, good, strict=True)), np.zeros(size, np.int64))

    return _sums(dealt, size, all_parts)


def _weights(dealt: DataFrame, mean: np.ndarray, scale: np.ndarray, share: float) -> np.ndarray:
    """Coefficients of the logistic loss on all differences of a good and a bad document, each with the weight `share`."""
    size = len(mean)
    upper = np.triu_indices(size)

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def work(part: int, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
            x, y = ((textstats.expanded(f) - mean) / scale for f in (bad, good))
            z = (y @ w)[None, :] - (x @ w)[:, None]  # a row for each bad, a column for each good document
            p = 1 / (1 + np.exp(np.clip(z, -35, 35)))
            bend = p * (1 - p)
            cross = x.T @ (bend @ y)
            curve = (x * bend.sum(1)[:, None]).T @ x + (y * bend.sum(0)[:, None]).T @ y - cross - cross.T
            return share * np.concatenate([[np.logaddexp(0, -z).sum()], x.T @ p.sum(1) - y.T @ p.sum(0), curve[upper]])

        made = _by_part(dealt, 1 + size + len(upper[0]), work)
        curve = np.zeros((size, size))
        curve[upper] = made[1 + size :]
        return float(made[0]), made[1 : 1 + size], curve + np.triu(curve, 1).T

    return textstats.newton(at, size, ridge=20.0)


def _quantile(raw: DataFrame, below: int, n: int) -> float:
    """The quantile below / n of the column `raw`, between two values as numpy has it."""
    low, high = raw.agg(F.min("raw"), F.max("raw")).first()
    left, inside, high = below, n, float(np.nextafter(high, np.inf))
    for _ in range(STEPS):
        width = (high - low) / BINS
        if low + width == low:
            break

        def counted(raw: pa.Array, low: float = low, high: float = high, width: float = width) -> np.ndarray:
            x = raw.to_numpy()
            x = x[(x >= low) & (x < high)]
            return _whole(np.bincount(np.minimum(np.floor((x - low) / width), BINS - 1).astype(np.int64), minlength=BINS))

        counts = _sums(raw.select("raw"), BINS, counted).astype(np.int64)
        ends = np.cumsum(counts)
        at = int(np.searchsorted(ends, left))  # the bin of the last value below
        left, inside = left - (int(ends[at - 1]) if at else 0), int(counts[at])
        low, high = low + at * width, high if at == BINS - 1 else low + (at + 1) * width
    last, first = raw.agg(F.max(F.when(F.col("raw") < high, F.col("raw"))), F.min(F.when(F.col("raw") >= high, F.col("raw")))).first()
    return last if left < inside else last + (first - last) * (1 - below / n)  # the next value is one of the same bin, or the first beyond


def _slope(raw: DataFrame, threshold: float) -> float:
    """How sharply the labels turn with the score at the threshold: a logistic regression with one coefficient."""

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def work(label: pa.Array, raw: pa.Array) -> np.ndarray:
            x, y = raw.to_numpy() - threshold, label.to_numpy()
            z = x * w[0]
            p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            return _whole(np.stack([np.logaddexp(0, z) - y * z, (p - y) * x, p * (1 - p) * x * x])).sum(1)  # a whole number for each row

        loss, slope, curve = _sums(raw, 3, work)
        return loss, np.array([slope]), np.array([[curve]])

    return float(textstats.newton(at, 1, ridge=1.0)[0])


def fit(rows: DataFrame) -> Ranker | None:
    """Learn from all of (doc, label, text); None if there are not both good and bad documents."""
    rows = save(_features(rows).where("label in (0, 1)"))
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(n) < 2:
        return None
    dealt, size = save(_dealt(rows, n)), 6 * len(textstats.NAMES)
    rare = int(n[1] < n[0])

    def moments(part: int, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        some = [textstats.expanded(f) for k, f in enumerate((bad, good)) if k != rare or part == 0]  # each document once
        x = np.concatenate(some)
        return np.concatenate([x.sum(0), (x * x).sum(0), [len(bad) * len(good)]])

    made, total = _by_part(dealt, 2 * size + 1, moments), n[0] + n[1]
    mean = made[:size] / total
    scale = np.sqrt(np.maximum(made[size : 2 * size] / total - mean * mean, 0)) + 1e-6
    weights = _weights(dealt, mean, scale, min(1.0, RIVALS * n[rare] / max(made[-1], 1)))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = (textstats.expanded(_unpacked(batch.column(1))) - mean) / scale
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((x * weights).sum(1))], names=["label", "raw"])

    raw = save(rows.select("label", "f").mapInArrow(scores, "label int, raw double"))
    threshold = _quantile(raw, n[0], total)
    return Ranker(mean, scale, weights, max(_slope(raw, threshold), 0.1), threshold)


def scored(docs: DataFrame, model: Ranker | None, text: str = "text", score: str = "score") -> DataFrame:
    """`docs` with the column `score`; an older column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != score]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in words.scan(batch.column(batch.schema.get_field_index(text)), words.SPACED, lower=False):
                made = shared.value.score(textstats.statistics(w)) if shared.value else np.full(b - a, CUT)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(made)], names=schema.names)

    return docs.select(*[docs[c] for c in kept]).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, usable: Column | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with `score` (0 to 1, higher is better) and `predicted` (1 from CUT on), learned from `labels.quality`."""
    usable = labelled.trainable() if usable is None else usable
    model = fit(labelled.every(docs, labels, "quality", usable, doc, text))
    return scored(docs, model, text).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
