"""Requests as a stream: what is new in a micro-batch goes through the whole ladder, what was answered before keeps its answer.

The state is a table of answers by what was asked, a folder for each batch. It is looked up by a join, with requests made distinct
first, so one address that a third of all requests repeat is no burden to one task. Answers older than `keep` are asked for again.
A batch that is repeated after a failure sees the answers of earlier batches alone, and replaces its own folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import trimmed
from ..plans.ladder import ANSWER, resolve
from ..scratch import save
from ..sources import commits

ASKED = ["address", "known_station", "known_district"]


def _answered(spark: SparkSession, path: str, before: int, keep: str) -> DataFrame | None:
    """The youngest answer to each request of earlier batches that is not too old; None where there is no earlier batch."""
    parts = [f"{path}/{n}" for n in commits.names(spark, path) if n.startswith("batch=") and int(n.split("=")[1]) < before]
    if not parts:
        return None
    rows = spark.read.parquet(*parts).where(F.col("answered_at") > F.expr(f"current_timestamp() - interval {keep}"))
    made = [c for c in rows.columns if c not in ASKED]
    return rows.groupBy(*ASKED).agg(F.max_by(F.struct(*made), "answered_at").alias("x")).select(*ASKED, "x.*")


def answer_batch(rows: DataFrame, number: int, out: str, refer: Callable[[], dict], keep: str = "36500 days") -> None:
    """Answer one batch: rows of `out`/batch=<number>, and what had to be found out for them in `out`/_answers/batch=<number>."""
    spark = rows.sparkSession
    rows = save(rows.select("request_id", *[trimmed(c).alias(c) for c in ASKED]))
    known, asked = _answered(spark, f"{out}/_answers", number, keep), rows.select(*ASKED).distinct()
    new = asked.join(known.select(*ASKED), ASKED, "left_anti") if known is not None else asked
    new = save(new.withColumn("request_id", F.monotonically_increasing_id()))
    found = resolve(new, **refer()).join(new, "request_id").withColumn("answered_at", F.current_timestamp())
    found.select(*ASKED, *[c for c in ANSWER if c != "request_id"], "answered_at").write.mode("overwrite").parquet(f"{out}/_answers/batch={number}")
    every = spark.read.parquet(f"{out}/_answers/batch={number}")
    every = every.unionByName(known) if known is not None else every
    rows.join(every.drop("answered_at"), ASKED).select(*ANSWER).write.mode("overwrite").parquet(f"{out}/batch={number}")


def answer_stream(requests: DataFrame, out: str, checkpoint: str, refer: Callable[[], dict], trigger: dict | None = None, keep: str = "36500 days") -> StreamingQuery:
    """Start a query that answers a stream of requests and writes a folder of Parquet to `out` for each batch.

    `refer` returns the arguments of `resolve` other than requests; it is asked for each batch, so that changes of the reference
    tables take effect on what is asked from then on. `keep` is how long an answer holds, as in '90 days'.
    """
    batch = lambda rows, number: answer_batch(rows, number, out, refer, keep)
    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
