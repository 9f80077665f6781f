"""Operator 8: token counts by a separator scan of flat token files.

A flat file is nothing but ids of a fixed width, each document followed by the
end-of-document id; there is no index. Files are cut into byte ranges that any task
reads alone. A range finds its separators with one vectorised comparison; where its
first document began is what the ranges before it know, so a prefix scan over
the ranges of a file carries the last separator and the number of separators along.

A document is named where it is written: the task that appends its ids to a file returns its id with the file and its
place there. A task that fails or is run twice writes files of its own, which no row that Spark committed names, so the
order of rows and its changes do not matter.

Null and empty texts are documents of no ids, repeated rows are documents of their own. Ids after the last separator of a
file are one more document, marked as not terminated. An empty file has no documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .library import encoder
from .scratch import folder, save

RANGE_BYTES = 4 << 20


def write(docs: DataFrame, path: str, tokenizer: str, end: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Write 16-bit ids to flat files below `path`, one for each task, and return (doc, file, ordinal), saved.

    Strings of special tokens in a text are ordinary text, so `end` occurs at the end of documents alone.
    """
    schema = T.StructType([docs.schema[doc], T.StructField("file", T.StringType()), T.StructField("ordinal", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        coder, at, stream, name = encoder(tokenizer, plain=True), 0, None, f"{uuid.uuid4().hex}.ids"
        try:
            for batch in batches:
                if stream is None:
                    fs, folder_name = FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
                    fs.create_dir(folder_name)
                    stream = fs.open_output_stream(f"{folder_name}/{name}")
                stream.write(b"".join(coder.encode_column(batch.column(1), end)))
                places = pa.array(np.arange(at, at + batch.num_rows))
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * batch.num_rows, pa.string()), places], names=schema.names)
        finally:
            if stream is not None:
                stream.close()

    return save(docs.select(doc, text).mapInArrow(run, schema))


def _ranges(files: DataFrame, width: int, range_bytes: int) -> DataFrame:
    step = range_bytes // width * width
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("at")
    return files.select("path", "length", at).withColumn("size", F.least(F.lit(step), F.col("length") - F.col("at"))).repartition(F.col("path"), F.col("at"))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files below `path` that are not empty."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path).select("path", "length").where("length > 0")


def separators(files: DataFrame, end: int, width: int = 2, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, at, ends, open): of each byte range of `files` (path, length), the places of its separators, counted in ids from the start of the file.

    The last range of a file that does not end with a separator has one more end, and `open` is true.
    """
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for r in batch.to_pylist():
                fs, name = FileSystem.from_uri(r["path"])
                with fs.open_input_file(name) as f:
                    ids = np.frombuffer(f.read_at(r["size"], r["at"]), kind)
                ends = np.flatnonzero(ids == end) + r["at"] // width
                rest = r["at"] + r["size"] >= r["length"] and ids[-1] != end
                ends = np.append(ends, r["length"] // width) if rest else ends
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([r["at"]], pa.int64()), pa.array([ends], pa.list_(pa.int64())), pa.array([bool(rest)])], names=["path", "at", "ends", "open"])

    return _ranges(files, width, range_bytes).mapInArrow(run, "path string, at bigint, ends array<bigint>, open boolean")


def token_counts(files: DataFrame, end: int, width: int = 2, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, ordinal, start, n_tokens, terminated): each document of the flat `files` (path, length), without its separator."""
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    found = separators(files, end, width, range_bytes)
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    found = found.withColumn("carried", F.coalesce(F.last(last, ignorenulls=True).over(before), F.lit(-1))).withColumn("passed", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
    starts = F.concat(F.array("carried"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    docs = found.select("path", "passed", "open", F.size("ends").alias("n"), F.posexplode(F.arrays_zip(starts.alias("s"), F.col("ends").alias("e"))).alias("i", "d")).where("i < n")
    return docs.select("path", (F.col("passed") + F.col("i")).alias("ordinal"), (F.col("d.s") + 1).alias("start"), (F.col("d.e") - F.col("d.s") - 1).alias("n_tokens"), (~F.col("open") | (F.col("i") < F.col("n") - 1)).alias("terminated"))


def counted(docs: DataFrame, tokenizer: str, end: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, file, ordinal, start, n_tokens): `write` flat files to the shared scratch place, scan them, and name the documents."""
    spark, path = docs.sparkSession, folder(docs.sparkSession)
    names = write(docs, path, tokenizer, end, doc, text)
    if names.isEmpty():
        return names.select(doc, "file", "ordinal", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("n_tokens"))
    file = F.regexp_extract("path", r"([^/]+)$", 1)
    files = listed(spark, path).join(F.broadcast(names.select(F.col("file").alias("known")).distinct()), file == F.col("known"), "left_semi")  # a row for each task
    counts = token_counts(files, end).select(file.alias("file"), "ordinal", "start", "n_tokens")
    return names.join(counts.hint("merge"), ["file", "ordinal"], "left").select(doc, "file", "ordinal", "start", "n_tokens")
