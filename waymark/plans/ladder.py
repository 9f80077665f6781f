"""The ladder of rungs that answers requests, cheapest evidence first; the first rung that answers is the last one tried.

requests: request_id, address, known_station, known_district (null counts as blank).
Answers: one row for each request, ANSWER as schema. Every station and district returned is in the master.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..functions.replies import districts
from ..functions.text import is_blank, trimmed
from ..operators.lookup import district_hits, resolved_names
from ..operators.ranking import distance_ranked, estimate_ranked, excluded, far_warning
from ..operators.scan import Evidence, district_scan, evidence, station_answers, station_scan
from ..scratch import save, shuffled
from ..sources.tables import filled, one_each

ITEM = "struct<rank:int,station:string,district:string,confidence:string,match_score:double,distance:string,distance_km:double,resolved_address:string>"
ANSWER = ["request_id", "case", "rung", "confidence", "method", "note", "warning", "results"]
_FIELDS = ["rank", "station", "district", "confidence", "match_score", "distance", "distance_km", "resolved_address"]


def _packed(items: DataFrame) -> DataFrame:
    """(request_id, results) of rows that have rank, station, district and confidence, and maybe the other fields."""
    have = set(items.columns)
    blank = {"match_score": F.lit(None), "distance": F.lit("N/A"), "distance_km": F.lit(None), "resolved_address": F.lit("")}
    item = F.struct(*[(F.col(f) if f in have else blank[f]).alias(f) for f in _FIELDS]).cast(ITEM)
    return items.groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("results"))


def _answers(rows: DataFrame, case: int, rung: str, confidence: Column, method: Column, note: Column | None = None, warning: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select("request_id", F.lit(case).alias("case"), F.lit(rung).alias("rung"), confidence.alias("confidence"), method.alias("method"), (none if note is None else note).alias("note"), (none if warning is None else warning).alias("warning"), "results")


def _high(score: str, config: LinkConfig) -> Column:
    return F.when(F.col(score) >= config.high_score, "HIGH").otherwise("MEDIUM")


def _text(*parts) -> Column:
    """Columns and strings one after the other; null if one is."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _excluded_note(where: Column | str) -> Column:
    """Null where nothing is excluded."""
    return F.when(F.col("n_excluded") > 0, _text("no coordinates for ", F.col("n_excluded"), " of ", where, ": ", F.col("excluded")))


def by_station(requests: DataFrame, master: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """Rung 1: the stated station, one answer with all records that stay possible."""
    found = resolved_names(requests, master, config)
    best = F.first("score").over(Window.partitionBy("request_id").orderBy("rank"))
    found = save(found.withColumn("best", best))
    surety = F.when(F.col("status") == "ambiguous", "MEDIUM").when(F.col("best") == 100, "VERY HIGH").otherwise("HIGH")
    items = _packed(found.select("request_id", "rank", "station", "district", surety.alias("confidence"), F.col("score").alias("match_score")))
    rows = found.where("rank = 1").select("request_id", "status", "best", surety.alias("confidence")).join(shuffled(items), "request_id")
    first, n = F.col("results")[0], F.size("results")
    method = _text(F.when(F.col("best") == 100, "same").otherwise("similar"), " station name, score ", F.col("best"))
    method = F.when(F.col("status") == "unique", method).when(F.col("status") == "ambiguous", _text(method, "; ", n, " districts have it")).otherwise(_text(method, "; told apart by district"))
    note = F.when(F.col("status") == "resolved_by_district", _text("several districts have this station, ", first.district, " was stated")).when(
        F.col("status") == "ambiguous", _text(first.station, " is in ", n, " districts, choose one: ", F.array_join(F.transform("results", lambda x: x.district), ", "))
    )
    return _answers(rows, 1, "1", F.col("confidence"), method, note)


def by_district(requests: DataFrame, master: DataFrame, coordinates: DataFrame, geocodes: DataFrame, config: LinkConfig = LinkConfig(), known: Evidence | None = None) -> DataFrame:
    """Rung 2, measured: stations of the stated district; one that the address names is pinned first, the rest follow by distance."""
    hit = district_hits(requests, master, config=config).where("place = 1").select("request_id", "district", F.col("score").alias("d_score"))
    asked = save(requests.select("request_id", "address", (~is_blank("address")).alias("addressed")).join(shuffled(hit), "request_id"))
    pins = station_scan(asked.where("addressed"), master, within="district", config=config, known=known).where("rank = 1").select("request_id", F.col("station").alias("pin"), F.col("score").alias("pin_score"))
    ranked = save(distance_ranked(asked.where("addressed"), master, coordinates, geocodes))
    reach = ranked.select("request_id", "station", "distance", "distance_km", F.col("rank").alias("near"))
    rows = asked.join(shuffled(pins), "request_id", "left").join(master, "district").join(shuffled(reach), ["request_id", "station"], "left")
    by_request = Window.partitionBy("request_id")
    rows = rows.withColumn("measured", F.count("distance_km").over(by_request) > 0).withColumn("pinned", F.coalesce(F.col("station") == F.col("pin"), F.lit(False)))
    rows = rows.where(~F.col("measured") | F.col("distance_km").isNotNull() | F.col("pinned"))
    order = by_request.orderBy(F.desc("pinned"), F.asc_nulls_last("near"), "row_no")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.top_n)
    surety = F.when(F.col("pinned"), _high("pin_score", config)).when(F.col("addressed") & ~F.col("measured"), "LOW").when(F.col("rank") == 1, "HIGH").otherwise("MEDIUM")
    items = _packed(rows.select("request_id", "rank", "station", "district", surety.alias("confidence"), F.when(F.col("pinned"), F.col("pin_score")).alias("match_score"), F.coalesce("distance", F.lit("N/A")).alias("distance"), "distance_km"))
    reached = ranked.select("request_id").distinct().withColumn("measured", F.lit(True))
    state = asked.join(shuffled(pins), "request_id", "left").join(shuffled(reached), "request_id", "left").join(shuffled(items), "request_id")
    state = state.join(excluded(master, coordinates), "district", "left").join(shuffled(far_warning(ranked, config.warn_km).drop("district")), "request_id", "left")
    lost = F.col("addressed") & F.col("measured").isNull()
    pin = F.when(F.col("pin").isNotNull(), _text("; ", F.col("pin"), " first, as the address names it")).otherwise("")
    order = F.when(lost, "no distances, in order of rows").when(F.col("addressed"), "nearest first").otherwise("no address, in order of rows")
    method = _text("district ", F.col("district"), ", score ", F.col("d_score"), "; ", order, pin)
    note = F.when(F.col("addressed"), _excluded_note(F.col("district")))
    far = F.when(F.col("nearest_km").isNotNull(), _text("the nearest station of ", F.col("district"), " is ", F.col("nearest_km"), " km away; is it the right district?"))
    return _answers(state, 2, "2", F.when(lost, "LOW").otherwise("HIGH"), method, note, far)


def by_named_station(requests: DataFrame, master: DataFrame, config: LinkConfig = LinkConfig(), known: Evidence | None = None) -> DataFrame:
    """Rung 3a: keys whose station the address names. Answers are made for what is asked, and joined to the requests once."""
    own, found, _ = station_answers(requests, master, config=config, known=known)
    found = found.where(F.col("rank") <= config.top_n).withColumnRenamed("asked", "request_id")
    items = _packed(found.select("request_id", "rank", "station", "district", _high("score", config).alias("confidence"), F.col("score").alias("match_score")))
    rows = found.where("rank = 1").join(shuffled(items), "request_id")
    method = _text("the address names a station: ", F.col("locality"), ", score ", F.col("score"))
    made = save(_answers(rows, 3, "3a", _high("score", config), method)).withColumnRenamed("request_id", "asked")
    return own.join(made, "asked").drop("asked").select(*ANSWER)


def by_named_district(requests: DataFrame, master: DataFrame, rank_in, tail: str, bare: DataFrame | None, config: LinkConfig = LinkConfig(), known: Evidence | None = None) -> DataFrame:
    """Rung 3b: stations of a district that the address names, as `rank_in` ranks them."""
    hit = district_scan(requests, master, config, known).where("rank = 1").select("request_id", "district", "score", "locality").join(shuffled(requests.select("request_id", "address")), "request_id")
    hit = save(hit)
    ranked = rank_in(hit, config.top_n)
    items = _packed(ranked.withColumn("confidence", F.when(F.col("rank") == 1, "HIGH").otherwise("MEDIUM")))
    rows = hit.join(shuffled(items), "request_id")
    rows = rows.join(bare, "district", "left") if bare is not None else rows
    method = _text("the address names district ", F.col("district"), ": ", F.col("locality"), ", score ", F.col("score"), f"; {tail}")
    return _answers(rows, 3, "3b", F.lit("MEDIUM"), method, _excluded_note(F.col("district")) if bare is not None else None)


def inferred_districts(requests: DataFrame, master: DataFrame, inferences: DataFrame, most: int = 2, config: LinkConfig = LinkConfig()) -> DataFrame:
    """(request_id, address, district, turn): districts that an inferrer's reply (address, reply) names, in its order; only ones
    of the master, by exact name or else by the best like one."""
    said = requests.select("request_id", "address", trimmed("address").alias("key")).join(shuffled(one_each(inferences.withColumn("key", trimmed("address")), ["key"], ["reply"])), "key")
    named = said.select("request_id", "address", F.posexplode(districts("reply")).alias("i", "typed"))
    typed = named.select("typed").distinct().select(F.col("typed").alias("request_id"), F.col("typed").alias("known_district"))
    snapped = district_hits(typed, master, config=config).where("place = 1").select(F.col("request_id").alias("typed"), "district")
    first = named.join(snapped, "typed").groupBy("request_id", "address", "district").agg(F.min("i").alias("i"))
    turn = F.row_number().over(Window.partitionBy("request_id").orderBy("i"))
    return first.withColumn("turn", turn).where(F.col("turn") <= most).select("request_id", "address", "district", "turn")


def by_inference(requests: DataFrame, master: DataFrame, inferences: DataFrame, rank_in, tail: str, bare: DataFrame | None, config: LinkConfig = LinkConfig()) -> DataFrame:
    """Rung 3c: at most two stations of each of at most two inferred districts, in the order of inference."""
    inferred = save(inferred_districts(requests, master, inferences, config=config))
    ranked = rank_in(inferred, 2).withColumn("confidence", F.when(F.col("rank") == 1, "MEDIUM").otherwise("LOW"))
    ranked = ranked.join(shuffled(inferred.select("request_id", "district", "turn")), ["request_id", "district"])
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("turn", "rank"))
    items = _packed(ranked.withColumn("place", place).where(F.col("place") <= config.top_n).withColumn("rank", F.col("place")))
    if bare is not None:
        # a left join, of which Spark can only broadcast the districts; those without a row add nothing
        lists = inferred.join(bare, "district", "left").groupBy("request_id").agg(F.sum("n_excluded").alias("n_excluded"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "excluded"))), lambda x: x.excluded), ", ").alias("excluded"))
        items = items.join(shuffled(lists), "request_id", "left")
    return _answers(items, 3, "3c", F.lit("MEDIUM"), F.lit(f"inferred districts; {tail}"), _excluded_note("inferred districts") if bare is not None else None)


def resolve(
    requests: DataFrame,
    master: DataFrame,
    coordinates: DataFrame | None = None,
    geocodes: DataFrame | None = None,
    inferences: DataFrame | None = None,
    estimates: DataFrame | None = None,
    mode: str = "measured",
    config: LinkConfig = LinkConfig(),
) -> DataFrame:
    """Answers of all requests. `mode` measured ranks by distance (coordinates, geocodes), estimated by replies (estimates).

    Providers are tables: geocodes (query, lat, lng), inferences (address, reply), estimates (address, district, reply).
    Geocodes also fill the coordinates that stations lack. A rung sees only what earlier rungs left. What addresses name is
    found once for all rungs that need it. Exact repeats of a master row count once; of repeated rows of a provider see `one_each`.
    """
    spark = requests.sparkSession
    empty = lambda schema: spark.createDataFrame([], schema)
    coordinates = empty("district string, station string, lat double, lng double") if coordinates is None else coordinates
    geocodes = empty("query string, lat double, lng double") if geocodes is None else geocodes
    inferences = empty("address string, reply string") if inferences is None else inferences
    estimates = empty("address string, district string, reply string") if estimates is None else estimates
    master = save(master.groupBy("district", "station").agg(F.min("row_no").alias("row_no")))
    measured = mode == "measured"
    coordinates = save(filled(master, coordinates, geocodes, config)) if measured else coordinates

    def rank_in(asked: DataFrame, n: int) -> DataFrame:
        if measured:
            return distance_ranked(asked, master, coordinates, geocodes, most=n)
        return estimate_ranked(asked, master, estimates, config.top_n).where(F.col("rank") <= n)

    def stated(left: DataFrame) -> DataFrame:
        if measured:
            return by_district(left, master, coordinates, geocodes, config, known)
        hit = district_hits(left, master, config=config).where("place = 1").select("request_id", "district", F.col("score").alias("d_score"))
        asked = save(left.select("request_id", "address", (~is_blank("address")).alias("addressed")).join(shuffled(hit), "request_id"))
        by_row = F.row_number().over(Window.partitionBy("district").orderBy("row_no"))
        firsts = master.withColumn("rank", by_row).where(F.col("rank") <= config.top_n)
        plain = asked.where("not addressed").join(firsts, "district", "left").select("request_id", "district", "rank", "station", F.lit("N/A").alias("distance"))
        ranked = rank_in(asked.where("addressed"), config.top_n).unionByName(plain)
        items = _packed(ranked.withColumn("confidence", F.when(F.col("rank") == 1, "HIGH").otherwise("MEDIUM")))
        method = _text("district ", F.col("district"), ", score ", F.col("d_score"), "; ", F.when(F.col("addressed"), "nearest first, as estimated").otherwise("no address, in order of rows"))
        return _answers(asked.join(shuffled(items), "request_id"), 2, "2", F.lit("HIGH"), method)

    bare = excluded(master, coordinates) if measured else None
    tail = "nearest first" if measured else "nearest first, as estimated"
    left = save(requests.select("request_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("address", "known_station", "known_district")]))
    typed = ~is_blank("known_station")
    answered = [save(by_station(left.where(typed), master, config))]
    left = save(left.where(~typed).unionByName(left.where(typed).join(shuffled(answered[0].select("request_id")), "request_id", "left_anti")))
    known = evidence(left.where(~is_blank("address")), master, config)
    typed = ~is_blank("known_district")
    answered.append(save(stated(left.where(typed))))
    left = left.where(~typed).unionByName(left.where(typed).join(shuffled(answered[-1].select("request_id")), "request_id", "left_anti"))
    rungs = [
        lambda left: by_named_station(left, master, config, known),
        lambda left: by_named_district(left, master, rank_in, tail, bare, config, known),
        lambda left: by_inference(left.where(~is_blank("address")), master, inferences, rank_in, tail, bare, config),
    ]
    for rung in rungs:
        answered.append(save(rung(left)))
        left = save(left.join(shuffled(answered[-1].select("request_id")), "request_id", "left_anti"))
    nothing = left.select("request_id", F.array().cast(f"array<{ITEM}>").alias("results"))
    answered.append(_answers(nothing, 0, "0", F.lit("NONE"), F.lit("no answer")))
    return reduce(DataFrame.unionByName, answered)
