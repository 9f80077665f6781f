"""Labelled rows to learn from: all of them, or a bounded sample, drawn by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of a sample (a documented bound of operator 9; scores cover all rows).
SAMPLE = 20_000
#: Most labels that are broadcast to the texts (some 10 MB); more are joined as Spark chooses.
BROADCAST_LABELS = 200_000


def _known(labels: DataFrame, value: str, usable: Column, doc: str) -> DataFrame:
    rows = labels.select(F.col(doc).alias("doc"), F.col(value).cast("int").alias("label")).where("doc is not null and label is not null")
    return rows.groupBy("doc").agg(F.max("label").alias("label")).where(usable)


def every(docs: DataFrame, labels: DataFrame, value: str, usable: Column, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, label, text) of all labelled documents for which `usable` holds, a row for each text of an id. Null labels and null ids are left out; of several labels of one id the largest counts."""
    known = _known(labels, value, usable, doc)
    known = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    return docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(known, "doc").select("doc", "label", "text")


def sample(docs: DataFrame, labels: DataFrame, value: str, usable: Column, doc: str = "doc_id", text: str = "text", most: int = SAMPLE) -> DataFrame:
    """(doc, label, text) of at most `most` labelled documents for which `usable` holds.

    Null labels and null ids are left out; of several labels of one id the largest counts, and of several texts of one
    id the least, so that an id that is repeated without end gives one row.
    """
    rows = _known(labels, value, usable, doc)
    n = max(1, rows.count())
    drawn = rows.where(F.pmod(F.xxhash64("doc"), F.lit(1_000_000)) < min(1_000_000, int(1_000_000 * 0.95 * most / n) if n > most else 1_000_000)).limit(most)
    texts = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(drawn), "doc")
    return texts.groupBy("doc", "label").agg(F.min("text").alias("text"))


def trainable(doc: str = "doc") -> Column:
    """Rows that labels may be learned from: crc32 of the id as text is not divisible by 5."""
    return F.crc32(F.col(doc).cast("string").cast("binary")) % 5 != 0
