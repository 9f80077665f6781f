"""Settings that bound the memory of Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch at most; whole texts go in, so a batch may be one text longer.
BATCH = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches be no larger than BATCH. A worker holds one with what it makes of it, beside the JVM's copies."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH}b")
