"""Shared scratch tables: the one way in which operators cut lineage.

A scratch table is Parquet in the folder that the session names in
`spark.checkpoint.dir`, which driver and executors share, so that a lost
executor loses nothing and a later read never recomputes the steps before.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder. Without that setting it is in a temporary one, in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="waymark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/waymark-{uuid.uuid4().hex}"


def save(df: DataFrame) -> DataFrame:
    """Write `df` to a scratch table and return a reader of it."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """`df` for a join of two tables that both grow with the requests, and of which neither may be broadcast.

    Spark takes the size of a scratch table from its compressed files, by the share of the columns that are read. Few columns of many
    rows pass for little then, and the driver would hold all of these rows.
    """
    return df.hint("merge")
