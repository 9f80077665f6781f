"""A corpus pipeline of five of the training-data operators, each stage written as Parquet and read by the next.

Stages take (spark, docs, sf_dir). All but the last return the columns of documents; the
last returns a row for each document that is left, with its token ids and the text they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import bpe, minhash, pii, quality, winnow
from waymark.llm.queries import BYTE_TOKENIZER, table
from waymark.llm.scratch import save
from waymark.llm.session import small_batches
from waymark.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates of the dedup stage share 80 per cent of their shingles. A pair at that threshold shares none of so many bands with a chance of 4 in 10^8.
PERCENT, BANDS, ROWS = 80, 43, 5


def ready(spark: SparkSession) -> None:
    """Executors have the package, and batches are small."""
    ship(spark)
    small_batches(spark)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    ready(spark)
    return quality.classify(docs.select(COLUMNS), table(spark, sf_dir, "labels")).where("predicted = 1").select(COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    ready(spark)
    copies = save(minhash.near_duplicates(docs, percent=PERCENT, bands=BANDS, rows=ROWS).where("not kept").select("doc_id"))
    copies = F.broadcast(copies) if copies.count() <= minhash.BROADCAST_NAMES else copies
    return docs.select(COLUMNS).join(copies, "doc_id", "left_anti").select(COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    ready(spark)
    return winnow.contamination(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).where("not contaminated").select(COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars counts the new text."""
    ready(spark)
    return pii.redact(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded): packed ids of each text, and the text that they decode to."""
    ready(spark)
    done = bpe.round_trip(docs.select("doc_id", "text"), BYTE_TOKENIZER)
    return done.select("doc_id", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe encoding and decoding", bpe_stage),
]

#: SQL cannot train the classifiers or run the tokenizer; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole of `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
