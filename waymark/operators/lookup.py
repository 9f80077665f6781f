"""Lookups of typed names, which are meant as names: the lenient score, over distinct names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LinkConfig
from .similar import similar
from ..functions.text import is_blank, normal, standard
from ..scratch import shuffled


def _typed(requests: DataFrame, column: str) -> DataFrame:
    return requests.where(~is_blank(column)).select("request_id", F.col(column).alias("typed"))


def name_hits(requests: DataFrame, master: DataFrame, known: str = "known_station", within: str | None = None, config: LinkConfig = LinkConfig()) -> DataFrame:
    """(request_id, station, district, score, place): every key whose station is like the typed one, ordered by score,
    district, then row. `within` names a column of requests with a district that restricts the keys."""
    typed = _typed(requests, known)
    keys = master.groupBy("district", "station").agg(F.min("row_no").alias("row_no"))
    found = similar(typed.select(F.col("typed").alias("token"), normal("typed").alias("normal")), keys.select(F.col("station").alias("name"), normal("station").alias("normal")), "lenient", config.name_cutoff)
    # a left join, of which Spark can only broadcast what is found; requests without a hit are left out at the end
    hits = typed.join(found.join(keys, keys.station == F.col("name")), typed.typed == F.col("token"), "left")
    if within:
        wanted = requests.select("request_id", normal(within).alias("wanted"))
        hits = hits.join(shuffled(wanted), "request_id").where((F.col("wanted") == "") | (normal("district") == F.col("wanted")))
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "district", "row_no")
    return hits.select("request_id", "station", "district", F.bround("score", 1).alias("score"), "row_no").withColumn("place", F.row_number().over(order)).drop("row_no").where("station is not null")


def resolved_names(requests: DataFrame, master: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """(request_id, status, rank, station, district, score): the keys with the best hit's name.

    status is unique, resolved_by_district (the stated district is that of just one key) or ambiguous (all are returned).
    """
    hits = name_hits(requests, master, config=config)
    by_request = Window.partitionBy("request_id")
    top = hits.withColumn("top", F.first("station").over(by_request.orderBy("place"))).where("station = top")
    top = top.join(shuffled(requests.select("request_id", normal("known_district").alias("wanted"))), "request_id")
    top = top.withColumn("same", (F.col("wanted") != "") & (normal("district") == F.col("wanted"))).withColumn("n", F.count("*").over(by_request)).withColumn("n_same", F.count_if(F.col("same")).over(by_request))
    status = F.when(F.col("n") == 1, "unique").when(F.col("n_same") == 1, "resolved_by_district").otherwise("ambiguous")
    kept = top.withColumn("status", status).where((F.col("status") != "resolved_by_district") | F.col("same"))
    rank = F.row_number().over(by_request.orderBy("place"))
    return kept.select("request_id", "status", rank.alias("rank"), "station", "district", "score")


def district_hits(requests: DataFrame, master: DataFrame, known: str = "known_district", config: LinkConfig = LinkConfig()) -> DataFrame:
    """(request_id, district, score, place): the district typed exactly, or else all that are like it, the best and first one first."""
    typed = _typed(requests, known)
    districts = master.groupBy("district").agg(F.min("row_no").alias("row_no"))
    exact = typed.withColumn("district", standard("typed")).join(districts.select("district"), "district", "left_semi").select("request_id", "district", F.lit(100.0).alias("score"), F.lit(1).alias("place"))
    rest = typed.join(shuffled(exact.select("request_id")), "request_id", "left_anti")
    found = similar(rest.select(F.col("typed").alias("token"), normal("typed").alias("normal")), districts.select(F.col("district").alias("name"), normal("district").alias("normal")), "lenient", config.name_cutoff)
    hits = rest.join(found.join(districts, F.col("name") == districts.district), rest.typed == F.col("token"), "left").select("request_id", "district", F.bround("score", 1).alias("score"), "row_no")
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "row_no")
    return exact.unionByName(hits.withColumn("place", F.row_number().over(order)).drop("row_no").where("district is not null"))
