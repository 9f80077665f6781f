"""Stations of a district by their distance from an address."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import geodesic, shown_km
from ..functions.text import trimmed
from ..scratch import shuffled
from ..sources.tables import one_each
from .nearest import nearest, ranked_by_distance


def distance_ranked(requests: DataFrame, master: DataFrame, coordinates: DataFrame, geocodes: DataFrame, district: str = "district", most: int | None = None) -> DataFrame:
    """(request_id, district, rank, station, distance, distance_km, resolved_address): nearest first; all of them, or the first `most`, which are found by a grid.

    `requests` has request_id, address and the district to rank in; geocodes has query, lat and lng, and an address
    without one gets no rows. Stations without coordinates are left out; `excluded` names them. Equal distances keep row order, see `ranked_by_distance`, and of repeated geocodes see `one_each`.
    """
    origin = one_each(geocodes.where("lat is not null and lng is not null").withColumn("query", trimmed("query")), ["query"], ["lat", "lng"]).withColumnsRenamed({"lat": "lat0", "lng": "lng0"})
    asked = requests.select("request_id", trimmed("address").alias("query"), F.col(district).alias("district")).join(shuffled(origin), "query")
    stations = master.join(coordinates.where("lat is not null"), ["district", "station"])
    if most is not None:
        ranked = nearest(asked.select("request_id", "district", "lat0", "lng0"), stations, most)
    else:
        ranked = ranked_by_distance(asked.join(stations, "district").withColumn("distance_km", geodesic("lat0", "lng0", "lat", "lng")), "request_id", "district")
    return ranked.select("request_id", "district", "rank", "station", shown_km("distance_km").alias("distance"), "distance_km", F.lit("").alias("resolved_address"))


def excluded(master: DataFrame, coordinates: DataFrame) -> DataFrame:
    """(district, n_excluded, excluded): stations of each district that have no coordinates, in row order."""
    bare = master.join(coordinates.where("lat is not null").select("district", "station"), ["district", "station"], "left_anti")
    return bare.groupBy("district").agg(F.count("*").alias("n_excluded"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "station"))), lambda x: x.station), ", ").alias("excluded"))


def far_warning(ranked: DataFrame, warn_km: float) -> DataFrame:
    """(request_id, district, nearest_km): where even the nearest station is beyond the distance."""
    return ranked.where((F.col("rank") == 1) & (F.col("distance_km") > warn_km)).select("request_id", "district", F.bround("distance_km", 1).alias("nearest_km"))


def estimate_ranked(requests: DataFrame, master: DataFrame, replies: DataFrame, top_n: int, district: str = "district") -> DataFrame:
    """(request_id, district, rank, station, distance): stations as an estimator's replies order them.

    `replies` has address, district and reply. Only stations of the district count, in the order of the reply; where
    a district has at most `top_n` stations, or the reply names none, its first stations are returned without distances.
    """
    from ..functions.replies import estimates

    asked = requests.select("request_id", trimmed("address").alias("address"), F.col(district).alias("district"))
    stations = master.select("district", "station", "row_no")
    sizes = stations.groupBy("district").agg(F.count("*").alias("n"))
    said = asked.join(shuffled(one_each(replies.withColumn("address", trimmed("address")), ["address", "district"], ["reply"])), ["address", "district"]).join(sizes.where(F.col("n") > top_n), "district")
    items = said.select("request_id", "district", F.posexplode(estimates("reply")).alias("i", "x")).select("request_id", "district", "i", F.col("x.name").alias("station"), F.col("x.dist_km").alias("km"))
    items = items.join(stations.select("district", "station").distinct(), ["district", "station"], "left_semi")
    shown = items.select("request_id", "district", "station", F.col("i").cast("long").alias("row_no"), shown_km("km", 0).alias("distance"))
    by_row = F.row_number().over(Window.partitionBy("district").orderBy("row_no"))
    firsts = stations.withColumn("place", by_row).where(F.col("place") <= top_n).drop("place")
    # a left join, of which Spark can only broadcast the stations; requests in districts that are not there are left out at the end
    plain = asked.join(shuffled(shown.select("request_id", "district").distinct()), ["request_id", "district"], "left_anti").join(firsts, "district", "left").select("request_id", "district", "station", "row_no", F.lit("N/A").alias("distance"))
    order = Window.partitionBy("request_id", "district").orderBy("row_no")
    return shown.union(plain).withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= top_n) & F.col("station").isNotNull()).select("request_id", "district", "rank", "station", "distance")
