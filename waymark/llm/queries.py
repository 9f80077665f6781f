"""The registered queries of the operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, extract, minhash, periodic, pii, ppm, pq, quality, rans, token_files, toxicity, winnow
from .oracles import ORACLE_SQL
from .session import small_batches

__all__ = ["ORACLE_SQL", "QUERIES"]

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")
WORD_VOCABULARY = 49_408


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_TOKENIZER)
    return done.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op4_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = rans.written(table(spark, sf_dir, "documents"), WORD_TOKENIZER, 1, WORD_VOCABULARY)
    return files.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, every = F.filter("spans", lambda x: x.base), F.col("spans")
    digest = lambda xs: F.coalesce(F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x.kind, x.s, x.e)), ","), F.lit(""))
    counts = [F.coalesce(F.expr(f"size(filter(spans, x -> x.base and x.kind = '{k}'))"), F.lit(0)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(every).alias("spans"))


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return ppm.scores(table(spark, sf_dir, "documents"), held_out)


def op7_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.counted(table(spark, sf_dir, "documents"), WORD_TOKENIZER, WORD_VOCABULARY - 1).select("doc_id", "n_tokens")


def _held_out() -> Column:
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", _held_out(), "score", "predicted")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", _held_out(), "score", "predicted")


def op11_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.aligned(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_TOKENIZER, PIECE_TOKENIZER)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def with_tails(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten, by the crc32 of its id, repeats the words from some place on; others as they are. A null id has no tail."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words, n = F.col("words"), F.size("words").cast("long")
    a = F.col("g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
    tailed = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i))), " ")
    held = docs.select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("g"))
    held = held.withColumn("words", F.when(F.col("g").isNotNull(), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)))
    return held.select("doc_id", F.when(n > 0, tailed).otherwise(F.col("text")).alias("text"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.runs(with_tails(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("back"), (-r.period).alias("short"), r.start.alias("start"), r.period.alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.select("doc_id", "runs", "collapsed", best.alias("best"), lines.alias("lines")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_minhash": op2_minhash,
    "op3_decontaminate": op3_decontaminate,
    "op4_rans": op4_rans,
    "op5_pii": op5_pii,
    "op6_ppm": op6_ppm,
    "op7_pq": op7_pq,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_extract": op11_extract,
    "op12_align": op12_align,
    "op13_periodic": op13_periodic,
}
