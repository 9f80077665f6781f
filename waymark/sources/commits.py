"""Commits: small files that one writer alone can create, on any file system of the cluster, and what they list.

Data are written first, under a name that nobody reads; the commit then makes them part of the table at once. What a writer leaves that
fails, or loses against another one, is never read.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _system(spark, path)
    return system.exists(place)


def create(spark: SparkSession, path: str, content: dict) -> bool:
    """Write the file whole; False if it is there already. The file system's rename without overwriting decides between two writers."""
    context, jvm = spark.sparkContext, spark.sparkContext._jvm
    place, system = _system(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}")
    out = system.create(part, True)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.makeQualified(place).toUri(), context._jsc.hadoopConfiguration())
    try:
        files.rename(part, place, context._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Py4JJavaError as e:
        system.delete(part, False)
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    return True


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder in order, without hidden ones; none if there is no folder."""
    place, system = _system(spark, path)
    return sorted(n for f in system.listStatus(place) if not (n := f.getPath().getName()).startswith(".")) if system.exists(place) else []


def content(spark: SparkSession, path: str) -> dict:
    place, system = _system(spark, path)
    stream = system.open(place)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
