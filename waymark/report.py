"""Answers as flat rows for reading, and accuracy against expected stations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import SURETY


def shown(answers: DataFrame) -> DataFrame:
    """A row for each result, with surety in words (unknown codes as they are) and N/A for a missing distance."""
    label = F.create_map(*[F.lit(x) for kv in SURETY.items() for x in kv])
    rows = answers.select("request_id", "case", "method", "warning", F.inline("results"))
    surety = F.coalesce(label[F.col("confidence")], F.col("confidence"))
    return rows.select("request_id", "case", "method", "warning", "rank", "station", "district", surety.alias("surety"), F.coalesce("distance", F.lit("N/A")).alias("distance"), "match_score")


def accuracy(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """(n, rank1, any_rank, empty): how many of `expected` (request_id, station) are at rank 1, at any rank, or without results; a null station expects none."""
    rows = expected.join(answers.select("request_id", F.transform("results", lambda x: x.station).alias("found")), "request_id", "left")
    none = F.coalesce(F.size("found"), F.lit(0)) <= 0
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce(F.try_element_at("found", F.lit(1)) == F.col("station"), none & F.col("station").isNull())).alias("rank1"),
        F.count_if(F.coalesce(F.array_contains("found", F.col("station")), F.lit(False))).alias("any_rank"),
        F.count_if(none).alias("empty"),
    )
