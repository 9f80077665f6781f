"""Operator 7: near-duplicate embeddings by product quantisation.

Unit vectors fall into coarse cells; each is listed in its PROBES nearest cells, so two close
vectors on either side of a border still meet. In a list a vector is its residual from the
cell's centre, coded as one centroid number for each subspace, with the length of what the
code leaves out. A pair is first judged by its asymmetric distance, looked up in tables of one
vector's distances to all centroids; as the coding error is known, that test drops no pair
above the threshold. What passes is compared by exact cosine in double precision.

Equal vectors of one label are one class with a weight. Long lists are cut into chunks, and pairs of chunks are
separate groups, which return link counts and a spanning forest, never all pairs. A pair
that meets in several cells counts in the first of them alone.

Vectors of different lengths never link; those of each length have a model of their own, but lengths that few vectors have
are compared in whole, all such lengths in one job. Labels that are null, and vectors
that are null, zero, or hold null or non-finite components link with nothing. Repeated vectors are linked like others. The model is fitted on a bounded sample; all vectors are listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import save

#: Vectors that the model is fitted on, at most; cells a vector is listed in; rows of a chunk.
SAMPLE, PROBES, CHUNK = 20_000, 6, 1024
SUBSPACES, CENTROIDS, MOST_CELLS = 8, 64, 4096
#: A length is rare if another has more vectors and it has at most so many, with so many components in all.
RARE, RARE_NUMBERS = 4096, 1 << 22


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, a thousand rows at a time."""
    size = (centres**2).sum(1)
    return np.concatenate([np.argmin(size - 2 * x[i : i + 1000] @ centres.T, axis=1) for i in range(0, len(x), 1000)]) if len(x) else np.zeros(0, np.int64)


def _means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centres of k-means, from distinct rows of the sample."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Model:
    """Cell centres and, for each subspace, the centroids of residuals."""

    def __init__(self, sample: np.ndarray, total: int):
        self.length = sample.shape[1]
        self.cells = _means(sample, max(1, min(MOST_CELLS, len(sample) // 8, int(np.sqrt(total) / 2))), 1)
        near = _nearest(sample, self.cells)
        residual = sample - self.cells[near]
        self.parts = np.array_split(np.arange(self.length), min(SUBSPACES, self.length))
        self.books = [_means(residual[:, p], min(CENTROIDS, len(residual)), 2 + i) for i, p in enumerate(self.parts)]

    def probes(self, x: np.ndarray) -> np.ndarray:
        """The nearest cells of each vector, in order of their numbers."""
        far = (self.cells**2).sum(1) - 2 * x @ self.cells.T
        p = min(PROBES, len(self.cells))
        return np.sort(np.argpartition(far, p - 1, axis=1)[:, :p], axis=1).astype(np.int32)

    def codes(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, lengths of the coding errors)."""
        codes = np.empty((len(residual), len(self.parts)), np.uint8)
        left = np.zeros(len(residual))
        for i, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            far = ((residual[:, None, p] - book) ** 2).sum(2)
            codes[:, i] = far.argmin(1)
            left += far.min(1)
        return codes, np.sqrt(left)

    def tables(self, residual: np.ndarray) -> list[np.ndarray]:
        """Squared distances of each vector's parts to all centroids."""
        return [((residual[:, None, p] - book) ** 2).sum(2) for p, book in zip(self.parts, self.books, strict=True)]


def _unit(rows: list) -> tuple[list[int], list[bytes]]:
    """(places, unit vectors as packed doubles) of the rows that can link; their squares neither overflow nor vanish."""
    keep, out = [], []
    for i, v in enumerate(rows):
        if not v:
            continue
        x = np.array(v, np.float64)  # null becomes NaN
        most = np.abs(x).max()
        if np.isfinite(most) and most > 0:
            x /= most
            keep.append(i)
            out.append((x / np.sqrt((x * x).sum())).tobytes())
    return keep, out


def _unit_column(df: DataFrame) -> DataFrame:
    """(id, label, v): the vectors that can link, scaled to length one, as packed doubles."""
    kind = df.schema["id"].dataType.simpleString(), df.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, v = _unit(batch.column(2).to_pylist())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(v, pa.binary())], names=["id", "label", "v"])

    return df.select("id", "label", "v").mapInArrow(run, f"id {kind[0]}, label {kind[1]}, v binary")


def _matrix(col: pd.Series, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(col), kind).reshape(len(col), -1)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes, the least node of its component under the links (a, b)."""
    low = np.arange(n)
    while len(a):
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if (before == low).all():
            break
    return low


def links(classes: DataFrame, model: Model, cosine: float) -> DataFrame:
    """(id, found, root) by chunk pair: weights of the classes that a class links to there, and a class of its component.

    `classes` has id, label, v and weight.
    """
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kinds = classes.schema["id"].dataType.simpleString(), classes.schema["label"].dataType.simpleString()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                cells = shared.value.probes(np.frombuffer(b"".join(part.column(2).to_pylist()), np.float64).reshape(part.num_rows, -1))
                again = pa.array(np.repeat(np.arange(part.num_rows), cells.shape[1]))
                owner = pa.array([r.tobytes() for r in cells], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.take(again) for c in part.columns), owner.take(again), pa.array(cells.reshape(-1))], names=["id", "label", "v", "weight", "probes", "cell"])

    rows = save(classes.select("id", "label", "v", "weight").mapInArrow(listed, f"id {kinds[0]}, label {kinds[1]}, v binary, weight bigint, probes binary, cell int"))
    sizes = rows.groupBy("label", "cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    rows = rows.join(sizes, ["label", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("id", "label", "v", "weight", "probes", "cell", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    radius = np.sqrt(2 - 2 * cosine) + 1e-9

    def compare(group: pa.Table) -> pa.Table:
        model, pdf = shared.value, group.to_pandas()
        x, weight, probes, cell = _matrix(pdf.v), pdf.weight.to_numpy(), _matrix(pdf.probes, np.int32), int(pdf.cell.iloc[0])
        same = pdf.i.iloc[0] == pdf.j.iloc[0]
        left = np.flatnonzero(pdf.chunk.to_numpy() == pdf.i.iloc[0])
        right = left if same else np.flatnonzero(pdf.chunk.to_numpy() == pdf.j.iloc[0])
        residual = x - model.cells[cell]
        codes, left_out = model.codes(residual[right])
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            far = np.zeros((len(some), len(right)))
            for table, code in zip(model.tables(residual[some]), codes.T, strict=True):
                far += table[:, code]
            a, b = np.nonzero(np.sqrt(far) <= radius + left_out)
            a, b = some[a], right[b]
            if same:
                a, b = a[a < b], b[a < b]
            ok = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
            a, b = a[ok], b[ok]
            # both are listed in `cell`; the pair counts here if they share no earlier cell
            shared_before = ((probes[a][:, :, None] == probes[b][:, None, :]) & (probes[a][:, :, None] < cell)).any(axis=(1, 2))
            ends.append((a[~shared_before], b[~shared_before]))
        a, b = (np.concatenate([e[k] for e in ends]) if ends else np.zeros(0, np.int64) for k in (0, 1))
        found = np.bincount(a, weights=weight[b], minlength=len(x)) + np.bincount(b, weights=weight[a], minlength=len(x))
        low = _forest(a, b, len(x))
        some = np.flatnonzero(found > 0)
        ids = pdf.id.to_numpy()
        return pa.table({"id": ids[some], "found": found[some].astype(np.int64), "root": ids[low[some]]})

    return rows.groupBy("label", "cell", "i", "j").applyInArrow(compare, f"id {kinds[0]}, found bigint, root {kinds[0]}")


def near_duplicates(vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """(vec, n_links, component_id, kept), a row for each row of `vectors`; ids are taken to be unique integers."""
    rows = vectors.select(F.col(vec).alias("id"), F.col(label).alias("label"), F.col(embedding).alias("v"))
    usable = rows.where("label is not null and v is not null and id is not null")
    lengths = sorted((r.length, r.n) for r in usable.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n")).where("length > 0 and n > 1").collect())  # a row for each length
    out = rows.select("id").withColumn("n_links", F.lit(0).cast("bigint")).withColumn("component_id", F.col("id"))
    most = max((n for _, n in lengths), default=0)
    common = [(length, n) for length, n in lengths if n == most or n > RARE or n * length > RARE_NUMBERS]
    found = [x for length, n in common if (x := _members(usable, length, n, cosine)) is not None]
    if len(common) < len(lengths):
        found.append(_rare_members(usable.where("size(v) > 0").where(~F.size("v").isin([length for length, _ in common])), cosine))
    if found:
        members = reduce(DataFrame.union, found)
        out = rows.select("id").join(members, "id", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(vec), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _rare_links(classes: DataFrame, cosine: float) -> DataFrame:
    """(id, found, root) as in `links`, of classes whose lengths few vectors have: each with all others of its label and length."""
    kind = classes.schema["id"].dataType.simpleString()

    def compare(group: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(group["v"].to_pylist()), np.float64).reshape(group.num_rows, -1)
        weight, ends, step = group["weight"].to_numpy(), [], max(1, (1 << 20) // x.shape[1])
        for at in range(0, len(x), 256):
            a, b = np.nonzero(x[at : at + 256] @ x.T >= cosine - 1e-9)
            a, b = (a + at)[a + at < b], b[a + at < b]
            for i in range(0, len(a), step):  # the deciding sums, as where lists of cells are compared
                p, q = a[i : i + step], b[i : i + step]
                ok = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                ends.append((p[ok], q[ok]))
        a, b = (np.concatenate([e[k] for e in ends]) if ends else np.zeros(0, np.int64) for k in (0, 1))
        found = np.bincount(a, weights=weight[b], minlength=len(x)) + np.bincount(b, weights=weight[a], minlength=len(x))
        some, ids = np.flatnonzero(found > 0), group["id"].to_numpy()
        return pa.table({"id": ids[some], "found": found[some].astype(np.int64), "root": ids[_forest(a, b, len(x))[some]]})

    return classes.groupBy("label", F.octet_length("v").alias("bytes")).applyInArrow(compare, f"id {kind}, found bigint, root {kind}")


def _rare_members(usable: DataFrame, cosine: float) -> DataFrame:
    """(id, n_links, component_id) of the vectors whose lengths are rare."""
    unit = save(_unit_column(usable))
    classes = save(unit.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("weight")))
    return _linked(unit, classes, save(_rare_links(classes, cosine)))


def _members(usable: DataFrame, length: int, n: int, cosine: float) -> DataFrame | None:
    """(id, n_links, component_id) of the vectors of one length that can link, of about n."""
    unit = save(_unit_column(usable.where(F.size("v") == length)))
    share = min(1.0, SAMPLE / n)
    drawn = unit.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * share)).limit(2 * SAMPLE).select("v").toArrow().column(0)
    sample = np.frombuffer(b"".join(drawn.to_pylist()), np.float64).reshape(-1, length)
    if not len(sample):
        return None
    classes = save(unit.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("weight")))
    return _linked(unit, classes, save(links(classes, Model(sample, n), cosine)))


def _linked(unit: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """(id, n_links, component_id) of the vectors `unit`, from the links of their classes."""
    counts = found.groupBy("id").agg(F.sum("found").alias("found"))
    nodes = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    known = classes.join(counts, "id", "left").join(nodes, "id", "left")
    known = known.select("label", "v", (F.coalesce("found", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return unit.join(known, ["label", "v"]).select("id", "n_links", "component_id")
