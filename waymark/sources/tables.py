"""The tables of the engine.

master: row_no, district, station (standard form, in file order by row_no); coordinates: district, station, lat, lng.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import LOOKUPS, SURETY, LinkConfig
from ..functions.text import standard, trimmed
from ..scratch import save, shuffled
from . import commits
from .answers import AskConfig, answered

LOG_COLUMNS = ["FILE NO", "ADDRESS", "PREDICTED PS", "PREDICTED DISTRICT", "ACTUAL PS KNOWN", "STATUS", "RESULT LOOKUP", "RESULT MATCH", "MATCH"]
LOG_WRITTEN = ["ADDRESS", "PREDICTED PS", "PREDICTED DISTRICT", "RESULT LOOKUP", "RESULT MATCH"]


def column_of(df: DataFrame, header: str) -> str | None:
    """The column whose header is this one, but for case and white space around it."""
    return next((c for c in df.columns if c.strip().upper() == header), None)


def first_there(spark: SparkSession, paths: list[str]) -> str:
    """The first of the paths that exists, on any file system; none is an error."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return path
    raise FileNotFoundError(f"none of these is there: {', '.join(paths)}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table by the ending of its path: parquet, csv, json, orc, or (where pandas has an engine for it) xlsx."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in ("xlsx", "xls"):
        return spark.createDataFrame(pd.read_excel(path, dtype=str))
    return spark.read.csv(path, header=True) if ending == "csv" else getattr(spark.read, ending if ending in ("json", "orc") else "parquet")(path)


def scan_master(spark: SparkSession, paths: list[str], row_no: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(master, rejected) of the first of the paths that is there. rejected: row_no, district, station, reason, line.

    Columns are declared as text, bound by their headers, and never guessed. Rejected are lines with too few or too many fields, row
    numbers that are none, blank districts and stations, and repeats of a key; of repeated rows the first by number stays.
    """
    path = first_there(spark, paths)
    raw = read(spark, path)
    names = [column_of(raw, "DISTRICT"), column_of(raw, "POLICE STATION") or column_of(raw, "STATION")] + ([column_of(raw, row_no.upper())] if row_no else [])
    if None in names:
        raise KeyError(f"{path} needs the columns DISTRICT, POLICE STATION{f' and {row_no}' if row_no else ''}")
    line = F.lit(None).cast("string")
    if path.rsplit(".", 1)[-1].lower() == "csv":
        declared = T.StructType([T.StructField(c, T.StringType()) for c in raw.columns] + [T.StructField("_line", T.StringType())])
        raw, line = spark.read.schema(declared).csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_line"), F.col("_line")
    number = F.expr(f"try_cast(trim(`{names[2]}`) as bigint)") if row_no else F.monotonically_increasing_id()
    rows = save(raw.select(number.alias("row_no"), *[standard(F.col(f"`{c}`")).alias(n) for c, n in zip(names, ("district", "station"), strict=False)], line.alias("line")))
    reason = F.when(F.col("line").isNotNull(), "malformed line").when(F.col("row_no").isNull(), "no row number").when(F.col("district") == "", "no district").when(F.col("station") == "", "no station")
    rows = rows.withColumn("reason", reason)
    fine = rows.where("reason is null")
    first = fine.groupBy("district", "station").agg(F.min("row_no").alias("first"), F.min_by(F.struct("row_no", "district", "station"), "row_no").alias("x"))
    again = fine.join(first.select("district", "station", "first"), ["district", "station"]).where("row_no > first").withColumn("reason", F.concat(F.lit("repeats row "), F.col("first")))
    columns = ["row_no", "district", "station", "reason", "line"]
    return first.select("x.*"), rows.where("reason is not null").select(columns).unionByName(again.select(columns))


def standard_master(df: DataFrame, row_no: str | None = None) -> DataFrame:
    """Master rows with a district and a station that are neither null nor blank.

    `row_no` names a column with the order of rows; without it, rows are in alphabetical order, numbered by ranges of names.
    """
    names = [column_of(df, h) for h in ("DISTRICT", "POLICE STATION")]
    names = [n or column_of(df, h) for n, h in zip(names, ("DISTRICT", "STATION"), strict=True)]
    if None in names:
        raise KeyError("the master needs the columns DISTRICT and POLICE STATION")
    out = df.select(*([F.col(row_no).cast("long").alias("row_no")] if row_no else []), standard(F.col(f"`{names[0]}`")).alias("district"), standard(F.col(f"`{names[1]}`")).alias("station"))
    out = out.where("district != '' and station != ''")
    if row_no:
        return out
    # sorted by ranges and saved, so that numbers are given within parts and no task sorts the whole table
    part = save(out.repartitionByRange("district", "station").sortWithinPartitions("district", "station").withColumn("at", F.monotonically_increasing_id()))
    before = part.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each part
    return part.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(before), "part").select((F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("row_no"), "district", "station")


def standard_coordinates(df: DataFrame) -> DataFrame:
    """One row for each key: of repeated keys the last row by row_no. lat and lng are both there or both null."""
    lat, lng = (F.expr(f"try_cast({c} as double)") for c in ("lat", "lng"))
    both = lat.isNotNull() & lng.isNotNull()
    rows = df.select(standard("district").alias("district"), standard("station").alias("station"), F.struct(F.when(both, lat).alias("lat"), F.when(both, lng).alias("lng")).alias("at"), "row_no")
    best = rows.groupBy("district", "station").agg(F.max_by("at", "row_no").alias("at"))
    return best.select("district", "station", "at.lat", "at.lng")


def one_each(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row for each key: of repeated ones the last by `row_no`, where there is such a column, and the greatest of equals."""
    picked = F.struct(*[c for c in ("row_no",) if c in df.columns and c not in values], *values)
    return df.groupBy(*keys).agg(F.max(picked).alias("_picked")).select(*keys, *[F.col("_picked")[v].alias(v) for v in values])


def missing_coordinates(master: DataFrame, coordinates: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """(district, station, query): keys of the master without coordinates, and what to ask a geocoder."""
    known = coordinates.where("lat is not null").select("district", "station")
    query = F.concat(F.col("station"), F.lit(" Police Station, "), F.col("district"), F.lit(f", {config.geocode_suffix}"))
    return master.select("district", "station").distinct().join(known, ["district", "station"], "left_anti").withColumn("query", query)


def upserted(coordinates: DataFrame, updates: DataFrame) -> DataFrame:
    """Coordinates with the updates in their place; updates without coordinates change nothing. Of repeated updates see `one_each`."""
    new = one_each(updates.where("lat is not null and lng is not null"), ["district", "station"], ["lat", "lng"])
    return coordinates.select("district", "station", "lat", "lng").join(new, ["district", "station"], "left_anti").unionByName(new)


def filled(master: DataFrame, coordinates: DataFrame, geocodes: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """Coordinates after the missing ones have been looked up in geocodes (query, lat, lng); filled ones are never replaced."""
    known = one_each(geocodes.where("lat is not null and lng is not null"), ["query"], ["lat", "lng"])
    return upserted(coordinates, missing_coordinates(master, coordinates, config).join(shuffled(known), "query"))


def warmed(master: DataFrame, coordinates: DataFrame, geocoder: Callable[[str], tuple[float, float, str] | None], path: str, config: LinkConfig = LinkConfig(), ask: AskConfig = AskConfig()) -> DataFrame:
    """Look up all missing coordinates, put them into the table at `path`, and return (district, station, query, reason) of failures.

    Answers are kept beside the table, so that a query is paid for once; see `answers.answered`. A table that is not there yet starts with `coordinates`.
    """
    spark = master.sparkSession
    missing = save(missing_coordinates(master, coordinates, config))
    replies = save(answered(missing, geocoder, f"{path}/answers", ask))
    if read_version(spark, path) is None:
        write_coordinates(coordinates, path)
    upsert_coordinates(missing.join(replies.where("reason is null").select("query", "lat", "lng"), "query"), path)
    return missing.join(replies.where("reason is not null").select("query", "reason"), "query").select("district", "station", "query", "reason")


#: Buckets of the table of coordinates. An upsert rewrites those that it has rows for.
BUCKETS = 64
_COORDINATES = "district string, station string, lat double, lng double"


def _bucket() -> Column:
    return F.pmod(F.xxhash64("district", "station"), F.lit(BUCKETS)).cast("int").alias("bucket")


def read_version(spark: SparkSession, path: str) -> dict | None:
    """The last version: its number, the buckets it changed, and the folder of each bucket that has rows; None where there is none."""
    found = commits.names(spark, f"{path}/versions")
    return commits.content(spark, f"{path}/versions/{found[-1]}") if found else None


def _rows_of(spark: SparkSession, path: str, version: dict | None, buckets: list[int] | None = None) -> DataFrame:
    folders = (version or {"folders": {}})["folders"]
    parts = [f"{path}/data/{folder}/bucket={k}" for k, folder in folders.items() if buckets is None or int(k) in buckets]
    return spark.read.schema(_COORDINATES).parquet(*parts) if parts else spark.createDataFrame([], _COORDINATES)


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """The last version of the table of coordinates; empty where there is none."""
    return _rows_of(spark, path, read_version(spark, path))


def _written(spark: SparkSession, rows: DataFrame, path: str) -> dict[str, str]:
    """Write rows by bucket and return the folder of each bucket that has rows."""
    folder = uuid.uuid4().hex
    rows.select("district", "station", "lat", "lng", _bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
    return {n.split("=")[1]: folder for n in commits.names(spark, f"{path}/data/{folder}") if n.startswith("bucket=")}


def _committed(spark: SparkSession, path: str, base: dict | None, folders: dict[str, str], changed: list[int], whole: bool = False) -> bool:
    """Add a version with the new folders of the changed buckets; False if a version after `base` changed one of them too."""
    while True:
        now = read_version(spark, path)
        number = now["version"] if now else 0
        for n in range(base["version"] + 1 if base else 1, number + 1):
            if set(commits.content(spark, f"{path}/versions/{n:09d}.json")["changed"]) & set(changed):
                return False
        kept = {} if whole or not now else {k: f for k, f in now["folders"].items() if int(k) not in changed}
        if commits.create(spark, f"{path}/versions/{number + 1:09d}.json", {"version": number + 1, "changed": changed, "folders": kept | folders}):
            return True


def write_coordinates(coordinates: DataFrame, path: str) -> None:
    """A new version that holds these rows alone. Another writer that commits meanwhile is an error, since its rows would be lost."""
    spark = coordinates.sparkSession
    base = read_version(spark, path)
    if not _committed(spark, path, base, _written(spark, coordinates, path), list(range(BUCKETS)), whole=True):
        raise RuntimeError(f"another writer has changed {path} meanwhile")


def upsert_coordinates(updates: DataFrame, path: str, attempts: int = 5) -> None:
    """A new version with the updates in place of older rows of their keys; see `upserted`. Only buckets that have updates are rewritten.

    If another writer changes one of them meanwhile, they are merged again with its rows. Readers see all of the updates or none.
    """
    spark = updates.sparkSession
    new = save(one_each(updates.where("lat is not null and lng is not null"), ["district", "station"], ["lat", "lng"]))
    touched = sorted(r.bucket for r in new.select(_bucket()).distinct().collect())  # BUCKETS rows at most
    if not touched:
        return
    for _ in range(attempts):
        base = read_version(spark, path)
        if _committed(spark, path, base, _written(spark, upserted(_rows_of(spark, path, base, touched), new), path), touched):
            return
    raise RuntimeError(f"other writers kept changing {path}")


def log_rows(requests: DataFrame, answers: DataFrame, selections: DataFrame | None = None) -> DataFrame:
    """Log rows of answers that have results, with all nine columns; those kept by hand are null.

    Without `selections` (request_id, rank) rank 1 is logged. With it, a request whose rank is null or not there
    is logged with blank predictions, unless it has one result alone, which needs no selection.
    """
    rows = answers.where((F.col("case") > 0) & (F.size("results") > 0)).join(requests.select("request_id", "address"), "request_id")
    if selections is None:
        rows = rows.withColumn("rank", F.lit(1))
    else:
        rows = rows.join(selections.select("request_id", "rank"), "request_id", "left").withColumn("rank", F.when(F.size("results") == 1, F.lit(1)).otherwise(F.col("rank")))
    one = F.expr("filter(results, x -> x.rank = rank)")
    rows = rows.withColumn("picked", F.when(F.size(one) > 0, one[0]))
    label = F.create_map(*[F.lit(x) for kv in SURETY.items() for x in kv])
    lookup = F.create_map(*[F.lit(x) for kv in LOOKUPS.items() for x in kv])
    made = {
        "ADDRESS": trimmed("address"),
        "PREDICTED PS": F.coalesce("picked.station", F.lit("")),
        "PREDICTED DISTRICT": F.coalesce("picked.district", F.lit("")),
        "RESULT LOOKUP": lookup[F.col("case")],
        "RESULT MATCH": F.when(F.col("picked").isNull(), F.lit("")).otherwise(F.coalesce(label[F.col("picked.confidence")], F.lit("Unknown"))),
    }
    return rows.select("request_id", *[(made[c] if c in made else F.lit(None).cast("string")).alias(c) for c in LOG_COLUMNS])


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The log: Parquet that lay at `path` before, if any, and all batches that were appended; None where there is neither."""
    parts = [f"{path}/_data/{commits.content(spark, f'{path}/_batches/{n}')['folder']}" for n in commits.names(spark, f"{path}/_batches")]
    if any(not n.startswith("_") for n in commits.names(spark, path)):
        parts.insert(0, path)
    tables = [spark.read.parquet(p) for p in parts[:1]] + ([spark.read.parquet(*parts[1:])] if len(parts) > 1 else [])
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables) if tables else None


def append_log(rows: DataFrame, path: str, batch: str | None = None) -> bool:
    """Append log rows, columns by name. A log that lacks a written column is an error, and nothing is written.

    `batch` names the rows: what is appended under a name that the log has already is left out, and the answer is False, so that a
    job can be run again. Without a name rows are always appended. Rows are in the log when all of them are, and not before.
    """
    spark = rows.sparkSession
    marker = f"{path}/_batches/{hashlib.sha256((batch if batch is not None else uuid.uuid4().hex).encode()).hexdigest()}.json"
    if commits.exists(spark, marker):
        return False
    log = read_log(spark, path)
    present = log.columns if log is not None else LOG_COLUMNS
    lacking = [c for c in LOG_WRITTEN if c not in present]
    if lacking:
        raise KeyError(f"the log lacks the columns {', '.join(lacking)}")
    folder = uuid.uuid4().hex
    rows.select(*[F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in present]).write.parquet(f"{path}/_data/{folder}")
    return commits.create(spark, marker, {"batch": batch, "folder": folder})
