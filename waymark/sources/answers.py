"""Answers of a slow or paid service, kept in a table from run to run.

Queries without an answer that is young enough are asked inside the tasks, several at once in each, and again after a pause where the service
fails, as long as a task's budget of repeats lasts. A failure is kept with its reason, and is asked again in the next run.
"""

from __future__ import annotations

import asyncio
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commits

ANSWER = "query string, lat double, lng double, formatted string, reason string, asked_at timestamp"


@dataclass(frozen=True)
class AskConfig:
    """at_once: calls under way in a task; repeats: of one query; budget: repeats of a task; pause_s doubles with each repeat."""

    at_once: int = 8
    repeats: int = 3
    budget: int = 1000
    pause_s: float = 0.2
    keep_days: float = 90.0


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """All answers and failures ever kept."""
    parts = [f"{path}/data/{commits.content(spark, f'{path}/commits/{n}')['folder']}" for n in commits.names(spark, f"{path}/commits")]
    return spark.read.schema(ANSWER).parquet(*parts) if parts else spark.createDataFrame([], ANSWER)


def _asked(queries: DataFrame, ask: Callable, config: AskConfig) -> DataFrame:
    async def one(query: str, gate: asyncio.Semaphore, left: list[int]) -> tuple:
        async with gate:
            for turn in range(config.repeats + 1):
                try:
                    found = await ask(query) if asyncio.iscoroutinefunction(ask) else await asyncio.to_thread(ask, query)
                    return (query, *found, None) if found else (query, None, None, None, "no answer")
                except (ArithmeticError, AttributeError, LookupError, NameError, TypeError, ValueError):
                    raise  # the adapter is wrong, not the service
                except Exception as e:
                    reason = f"{type(e).__name__}: {e}"
                if turn == config.repeats or left[0] <= 0:
                    break
                left[0] -= 1
                await asyncio.sleep(config.pause_s * 2**turn)
            return query, None, None, None, reason

    async def all_of(part: list[str], left: list[int]) -> list[tuple]:
        gate = asyncio.Semaphore(config.at_once)
        return await asyncio.gather(*[one(q, gate, left) for q in part])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = [config.budget]
        for part in parts:
            made = pd.DataFrame(asyncio.run(all_of(part["query"].tolist(), left)), columns=["query", "lat", "lng", "formatted", "reason"])
            yield made.astype({"lat": float, "lng": float})

    return queries.mapInPandas(run, ANSWER.removesuffix(", asked_at timestamp")).withColumn("asked_at", F.current_timestamp())


def answered(queries: DataFrame, ask: Callable[[str], tuple[float, float, str] | None], path: str, config: AskConfig = AskConfig()) -> DataFrame:
    """(query, lat, lng, formatted, reason) for each distinct query that is not null; `reason` is null where there is an answer.

    `ask` is a function or a coroutine function. An error of the service (OSError, TimeoutError, one of its own) is a failure and is kept;
    an error of programming ends the job. New answers become part of the table at `path` at once, when all are there.
    """
    spark = queries.sparkSession
    queries = queries.select("query").where("query is not null").distinct()
    young = F.col("asked_at") > F.current_timestamp() - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(config.keep_days * 86400))
    kept = read_answers(spark, path).where(young & F.col("reason").isNull()).groupBy("query").agg(F.max_by(F.struct("lat", "lng", "formatted"), "asked_at").alias("x")).select("query", "x.*")
    missing = queries.join(kept, "query", "left_anti")
    folder = uuid.uuid4().hex
    _asked(missing, ask, config).write.parquet(f"{path}/data/{folder}")
    commits.create(spark, f"{path}/commits/{folder}.json", {"folder": folder})
    new = spark.read.schema(ANSWER).parquet(f"{path}/data/{folder}").drop("asked_at")
    return kept.join(queries, "query", "left_semi").withColumn("reason", F.lit(None).cast("string")).unionByName(new)
