"""The engine on a small master: functions, the checks of single requests, and properties of the scan."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import plain_similarity as one_by_one
from waymark.config import STOPWORDS
from waymark.functions import similarity as sim
from waymark.functions.geo import ellipsoid_km, geodesic, shown_km
from waymark.functions.replies import districts, estimates
from waymark.functions.text import localities, normal, without_noise
from waymark.operators.scan import station_scan
from waymark.operators.similar import similar
from waymark.plans.ladder import resolve
from waymark.report import accuracy, shown
from waymark.sources import tables
from waymark.sources.answers import AskConfig, answered

MASTER = [
    ("GACHIBOWLI", "CYBERABAD-RANGAREDDY"), ("NAWABPET", "MAHABUBNAGAR"), ("NAWABPET", "VIKARABAD"),
    ("BALANAGAR", "CYBERABAD-MEDCHAL"), ("BALANAGAR", "MAHABUBNAGAR"), ("LB NAGAR", "MALKAJGIRI-RANGAREDDY"),
    ("MALKAJGIRI", "MALKAJGIRI-RANGAREDDY"), ("BOWENPALLY", "MALKAJGIRI-HYDERABAD"), ("ADILABAD I TOWN", "ADILABAD"),
    ("BORABANDA", "DIST_A"), ("SANTOSH NAGAR", "DIST_B"), ("ALWAL", "DIST_C"), ("JAKRANPALLY", "DIST_D"), ("SANATHNAGAR", "DIST_E"),
    ("SUJATHANAGAR", "DIST_F"), ("CHANDANAGAR", "DIST_F"), ("GUNDALA", "DIST_A"), ("GUNDALA", "DIST_B"), ("GUNDALA", "DIST_C"),
    ("MATTEWADA", "WARANGAL"), ("HANAMKONDA", "WARANGAL-HANUMAKONDA"),
]
ADDRESSES = {
    1: ("1-2-3, SAI BABA NAGAR, BORABANDA, TELANGANA, 500018", "BORABANDA"),
    2: ("1-2 SAIBABA TEMPLE LANE, SANTOSH NAGAR / HYDERABAD, TELANGANA 500059", "SANTOSH NAGAR"),
    3: ("1-2 GOUTHAM NAGAR, FEROZGUDA, BALANAGAR, TELANGANA, 500011", "SANATHNAGAR"),
    4: ("1-2 F NO 9 SVR HOMES, CITIZEN COLONY, ALWAL, TELANGANA 500010", "ALWAL"),
    5: ("1-2, NAWABPET, POMAL, MAHABUBNAGAR, TELANGANA 509340", "NAWABPET"),
    6: ("1-2 NARAYANAPET, JAKRANPALLY, nizamabad, telangana 503175", "JAKRANPALLY"),
    7: ("NEW BAHAR 9, SAHARA ESTATE, LB NAGAR, MALKAJGIRI-RANGAREDDY, TELANGANA 500074", "LB NAGAR"),
    8: ("H NO 9, VENKATESHWARA COLONY, KOMPALLY, TELANGANA 500014", None),
}


@pytest.fixture(scope="module")
def master(spark):
    return spark.createDataFrame([(i, d, s) for i, (s, d) in enumerate(MASTER)], "row_no long, district string, station string")


@pytest.fixture(scope="module")
def coordinates(spark):
    rows = [(d, s, 17.0 + i / 50, 78.0 + i / 40) for i, (s, d) in enumerate(MASTER) if s != "MALKAJGIRI"]
    return spark.createDataFrame(rows, "district string, station string, lat double, lng double")


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "request_id long, address string, known_station string, known_district string")


def test_text(spark):
    row = spark.createDataFrame([(" PS SADAR\t", "GACHIBOWLI POLICE STATION", "MADHAPUR", "MALKAJGIRI-RANGAREDDY", None)], "a string, b string, c string, d string, e string")
    got = row.select(without_noise("a"), without_noise("b"), without_noise("c"), normal("d"), normal("e")).first()
    assert tuple(got) == ("SADAR", "GACHIBOWLI", "MADHAPUR", "MALKAJGIRI RANGAREDDY", "")
    got = spark.createDataFrame([("6-31-1,FLAT NO:101,AKHILA ENCLAVE,OLD BOWENPALLY,SECUNDERABAD,pin:500011",), (None,), ("",)], "a string").select(localities("a").alias("x")).collect()
    assert [r.x for r in got] == [["AKHILA", "BOWENPALLY", "SECUNDERABAD"], [], []]
    assert spark.createDataFrame([("SAI BABA NAGAR",)], "a string").select(localities("a").alias("x")).first().x == ["SAI BABA NAGAR", "BABA", "NAGAR"]


def test_scores():
    assert round(one_by_one.token_sort_ratio("NAGAR", "SUJATHANAGAR"), 2) == 58.82
    assert round(one_by_one.scaled_partial_ratio("NAGAR", "SUJATHANAGAR"), 2) == 41.67
    assert round(one_by_one.partial_ratio("ABCDEFGH", "BCDEFGHI"), 1) == 93.3
    assert one_by_one.weighted_ratio("", "X") == 0 and one_by_one.lenient("GACHIBOWLI", "GACHIBOWLI") == 100
    assert one_by_one.token_set_ratio("A B", "A B C") == 100 and one_by_one.token_sort_ratio("B A", "A B") == 100


def test_scores_are_those_of_single_pairs_to_the_last_bit():
    dice, made = np.random.default_rng(3), made_names(3)
    a, b = ([made[k] for k in dice.integers(0, len(made), 4000)] for _ in range(2))
    for name, plain in one_by_one.SCORERS.items():
        assert sim.scores(name, a, b).tolist() == [plain(x, y) for x, y in zip(a, b, strict=True)]
    assert len(sim.scores("strict", [], [])) == 0


def test_common_subsequence():
    made = sim.Strings(made_names(2)[::9])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(made.values)), np.arange(len(made.values))))
    got = sim.common(made, i, made.at[j], made.size[j])
    for a, b, n in zip(i, j, got.tolist(), strict=True):
        row = [0] * (made.size[b] + 1)
        for x in made.values[a]:
            row = list(itertools.accumulate(range(1, len(row)), lambda last, k: row[k - 1] + 1 if made.values[b][k - 1] == x else max(last, row[k]), initial=0))  # noqa: B023
        assert n == row[-1]


def made_names(seed):
    """Names of few letters, words and lengths, empty ones and very long ones among them."""
    dice = random.Random(seed)
    parts = ["NAGAR", "SANTOSH", "LB", "BALANAGAR", "BALA", "A", "B", "I", "TOWN", "ADILABAD", "ABCDE", "ABCXE"]
    kinds = [lambda: " ".join(dice.choice(parts) for _ in range(dice.randint(0, 4))), lambda: "".join(dice.choice("AB C") for _ in range(dice.randint(0, 9))), lambda: "".join(dice.choice("ABCDEFG") for _ in range(dice.randint(1, 20)))]
    made = {" ".join(kinds[k % 3]().split()) for k in range(330)} | {"".join(dice.choice("ABÉ日") for _ in range(n)) for n in (50, 63, 64, 65, 90, 140)}
    for x in sorted(made)[:150]:  # near names
        k = dice.randint(0, len(x))
        made.add(" ".join((x[:k] + dice.choice("ABX ") + x[k:]).split()))
        made.add(" ".join((x[:k] + x[k + 1 :]).split()))
    return sorted(made)


@pytest.mark.parametrize(("scorer", "cutoff"), [("strict", 86.0), ("lenient", 80.0), ("strict", 70.0), ("lenient", 92.0)])
def test_similarity_join_finds_all_pairs(spark, scorer, cutoff):
    tokens, names = made_names(4)[::2], made_names(5)
    frame = lambda xs, name: spark.createDataFrame([(x, x) for x in [*xs, xs[3]]], f"{name} string, normal string")
    got = sorted(map(tuple, similar(frame(tokens, "token"), frame(names, "name"), scorer, cutoff).collect()))
    a, b = [x for x in tokens for _ in names], names * len(tokens)
    want = [(x, y, s) for x, y, s in zip(a, b, sim.scores(scorer, a, b).tolist(), strict=True) if s >= cutoff]
    assert got == sorted(want) and len(want) > 100
    empty = spark.createDataFrame([], "token string, normal string")
    assert similar(empty, frame(names, "name"), scorer, cutoff).count() == 0
    with pytest.raises(ValueError, match="cutoff"):
        similar(frame(tokens, "token"), frame(names, "name"), scorer, 20.0)


def test_similarity_join_shuffles(spark):
    """Without broadcasts the plan joins by keys alone and gives the same rows."""
    tokens = spark.createDataFrame([(x, x) for x in made_names(6)], "token string, normal string")
    names = tokens.withColumnRenamed("token", "name")
    want = sorted(map(tuple, similar(tokens, names, "strict", 86.0).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = similar(tokens, names, "strict", 86.0)
        plan = made._jdf.queryExecution().toString()
        assert "BroadcastNestedLoop" not in plan and "CartesianProduct" not in plan and sorted(map(tuple, made.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_distance(spark):
    # Flinders Peak to Buninyong, a published test of geodesy
    km = ellipsoid_km(np.array([-37.95103342, 1.0]), np.array([144.42486789, 2.0]), np.array([-37.65282114, 1.0]), np.array([143.92649554, 2.0]))
    assert abs(km[0] - 54.972271) < 1e-5 and km[1] == 0
    # nearly antipodal points, of which the first is published as well
    km = ellipsoid_km(np.array([0.0, 0.0, 90.0, np.nan]), np.array([0.0, 0.0, 0.0, 0.0]), np.array([0.5, 0.5, -90.0, 0.0]), np.array([179.5, 179.7, 0.0, 0.0]))
    assert abs(km[0] - 19936.288579) < 1e-6 and abs(km[1] - 19944.127421) < 1e-5 and abs(km[2] - 20003.931459) < 1e-5 and np.isnan(km[3])
    row = spark.createDataFrame([(17.0, 78.0, 17.1, 78.1), (17.0, 78.0, None, 1.0)], "a double, b double, c double, d double")
    got = row.select(geodesic("a", "b", "c", "d").alias("km"), geodesic("a", "b", "c", "d", "m").alias("m")).collect()
    assert abs(got[0].m - 1000 * got[0].km) < 1e-6 and got[1].km is None
    with pytest.raises(ValueError):
        geodesic("a", "b", "c", "d", "furlong")
    assert [r[0] for r in spark.createDataFrame([(12.25,), (None,)], "k double").select(shown_km("k")).collect()] == ["~12.2 km", "N/A"]


def test_replies(spark):
    row = spark.createDataFrame([('so:\n{"districts": [" a ", "B",\n"a"]} ok', 'x [{"name":"p ", "dist_km": 4}, {"name":"q","dist_km":"far"}] [1]'), ("none", "none"), (None, None)], "d string, e string")
    got = row.select(districts("d").alias("d"), estimates("e").alias("e")).collect()
    assert got[0].d == ["A", "B"] and [tuple(x) for x in got[0].e] == [("P", 4.0), ("Q", None)]
    assert got[1].d == [] and got[1].e == [] and got[2].d == [] and got[2].e == []


@pytest.mark.parametrize("mode", ["measured", "estimated"])
def test_addresses(spark, master, mode):
    rows = [(k, a, "", None) for k, (a, _) in ADDRESSES.items()]
    answers = resolve(asked(spark, *rows), master, mode=mode)
    first = {r.request_id: (r.results[0].station if r.results else None) for r in answers.collect()}
    assert [k for k, (_, want) in ADDRESSES.items() if first[k] != want] == [3]
    assert first[3] == "BALANAGAR"
    expected = spark.createDataFrame([(k, w) for k, (_, w) in ADDRESSES.items()], "request_id long, station string")
    assert tuple(accuracy(answers, expected).first())[:2] == (8, 7)


def test_pin(spark, master, coordinates):
    geocodes = spark.createDataFrame([(ADDRESSES[7][0], 17.2, 78.2)], "query string, lat double, lng double")
    got = resolve(asked(spark, (1, ADDRESSES[7][0], "", "MALKAJGIRI-RANGAREDDY")), master, coordinates, geocodes).first()
    assert (got.case, got.results[0].station, got.results[0].match_score) == (2, "LB NAGAR", 100.0)
    assert [r.station for r in got.results].count("LB NAGAR") == 1 and got.results[0].distance != "N/A"
    assert "MALKAJGIRI" in got.note and got.warning is None


def test_typed_names(spark, master):
    rows = [(1, "", "GACHIBOWLI", ""), (2, "", "NAWABPET", "VIKARABAD"), (3, "", "NAWABPET", "HYDERABAD"), (4, "", "", "warangal"), (5, None, None, None), (6, "", "ZZZZZZ", "QQQQQ")]
    got = {r.request_id: r for r in resolve(asked(spark, *rows), master).collect()}
    assert (got[1].confidence, len(got[1].results)) == ("VERY HIGH", 1)
    assert [r.district for r in got[2].results] == ["VIKARABAD"] and "was stated" in got[2].note
    assert [r.district for r in got[3].results] == ["MAHABUBNAGAR", "VIKARABAD"] and got[3].confidence == "MEDIUM" and "choose" in got[3].note
    assert got[4].case == 2 and [r.station for r in got[4].results] == ["MATTEWADA"]
    assert got[5].case == 0 and got[6].case == 0 and got[6].results == []


def test_rungs_3b_3c_and_fallback(spark, master, coordinates):
    geocodes = spark.createDataFrame([("9, WARANGAL", 17.3, 78.4), ("NOWHERE 12", 17.1, 78.3)], "query string, lat double, lng double")
    inferences = spark.createDataFrame([("NOWHERE 12", '{"districts": ["DIST_F", "DIST_A", "DIST_B"]}')], "address string, reply string")
    rows = [(1, "9, WARANGAL", "", ""), (2, "NOWHERE 12", "", ""), (3, "CHANDANAGAR, LOST", "", "DIST_F")]
    got = {r.request_id: r for r in resolve(asked(spark, *rows), master, coordinates, geocodes, inferences).collect()}
    assert got[1].rung == "3b" and got[1].results[0].station == "MATTEWADA" and got[1].results[0].distance_km > 0
    assert got[2].rung == "3c" and [r.confidence for r in got[2].results] == ["MEDIUM", "LOW", "MEDIUM"]
    assert [r.district for r in got[2].results] == ["DIST_F", "DIST_F", "DIST_A"]
    assert got[3].confidence == "LOW" and [r.station for r in got[3].results] == ["CHANDANAGAR", "SUJATHANAGAR"] and "no distances" in got[3].method


def test_estimates(spark, master):
    more = master.union(spark.createDataFrame([(100 + i, "DIST_F", f"TOWN {c}") for i, c in enumerate("ABC")], master.schema))
    replies = spark.createDataFrame([("X 1", "DIST_F", '[{"name": "Town B", "dist_km": 3}, {"name": "Unknown"}, {"name": "SUJATHANAGAR", "dist_km": 9.6}]')], "address string, district string, reply string")
    got = {r.request_id: r for r in resolve(asked(spark, (1, "X 1", "", "DIST_F"), (2, "Y 2", "", "DIST_F")), more, estimates=replies, mode="estimated").collect()}
    assert [(r.station, r.distance) for r in got[1].results] == [("TOWN B", "~3 km"), ("SUJATHANAGAR", "~10 km")]
    assert [r.station for r in got[2].results] == ["SUJATHANAGAR", "CHANDANAGAR", "TOWN A"]


def test_scan_properties(spark, master):
    requests = asked(spark, *[(k, a, "", "") for k, (a, _) in ADDRESSES.items()])
    one = sorted(map(tuple, station_scan(requests, master).collect()))
    assert [r[2:4] for r in one if r[0] == 3][:2] == [("BALANAGAR", "CYBERABAD-MEDCHAL"), ("BALANAGAR", "MAHABUBNAGAR")]
    assert [r[2:4] for r in one if r[0] == 5] == [("NAWABPET", "MAHABUBNAGAR")]
    turned = master.withColumn("row_no", 100 - F.col("row_no")).orderBy(F.desc("station"))
    assert sorted(map(tuple, station_scan(requests, turned).collect())) == one
    alone = station_scan(requests.where("request_id = 5"), master).collect()
    assert [tuple(r) for r in alone] == [r for r in one if r[0] == 5]
    wide = master.union(spark.createDataFrame([(50 + i, f"D{i}", "SAMEPLACE") for i in range(6)], master.schema))
    assert station_scan(asked(spark, (1, "SAMEPLACE", "", "")), wide).count() == 0
    assert station_scan(asked(spark, (1, "H NO", "", ""), (2, None, "", "")), master).count() == 0


def test_tables(spark, tmp_path):
    raw = spark.createDataFrame([(3, " b ", "y\t"), (1, "a", " x"), (2, None, "z"), (4, " ", "w")], "n long, ` District ` string, `police station` string")
    master = tables.standard_master(raw, "n")
    assert sorted(map(tuple, master.collect())) == [(1, "A", "X"), (3, "B", "Y")]
    assert {r.row_no for r in tables.standard_master(raw.drop("n")).collect()} == {1, 2}
    with pytest.raises(KeyError):
        tables.standard_master(raw.select("n"))
    coordinates = tables.standard_coordinates(spark.createDataFrame([("a", "x", "1.5", "2", 1), ("a", "x", "3", "4", 2), ("b", "y", "bad", "2", 3)], "district string, station string, lat string, lng string, row_no long"))
    assert sorted(map(tuple, coordinates.collect()), key=str) == [("A", "X", 3.0, 4.0), ("B", "Y", None, None)]
    missing = tables.missing_coordinates(master, coordinates).collect()
    assert [(r.district, r.query) for r in missing] == [("B", "Y Police Station, B, Telangana, India")]
    found = spark.createDataFrame([(missing[0].query, 5.0, 6.0)], "query string, lat double, lng double")
    assert sorted(map(tuple, tables.filled(master, coordinates, found).collect())) == [("A", "X", 3.0, 4.0), ("B", "Y", 5.0, 6.0)]


def test_repeated_rows_of_providers(spark):
    coordinates = spark.createDataFrame([("A", "X", 1.0, 2.0)], "district string, station string, lat double, lng double")
    updates = spark.createDataFrame([("A", "X", 5.0, 6.0, 2), ("A", "X", 7.0, 8.0, 1), ("A", "X", None, 9.0, 3), ("B", "Y", 1.0, 1.0, 1)], "district string, station string, lat double, lng double, row_no int")
    for rows in (updates, updates.orderBy("row_no")):
        assert sorted(map(tuple, tables.upserted(coordinates, rows).collect())) == [("A", "X", 5.0, 6.0), ("B", "Y", 1.0, 1.0)]
    assert sorted(map(tuple, tables.upserted(coordinates, updates.drop("row_no")).collect())) == [("A", "X", 7.0, 8.0), ("B", "Y", 1.0, 1.0)]


def test_versions_of_coordinates(spark, master, tmp_path):
    path = str(tmp_path / "coordinates")
    assert tables.read_coordinates(spark, path).count() == 0
    fails = lambda q: None if q.startswith("GUNDALA") else (1.0, 2.0, q)
    failed = tables.warmed(master, tables.read_coordinates(spark, path), fails, path).collect()
    assert sorted((r.district, r.station, r.reason) for r in failed) == [(d, "GUNDALA", "no answer") for d in ("DIST_A", "DIST_B", "DIST_C")]
    assert tables.read_coordinates(spark, path).count() == master.count() - 3
    assert tables.warmed(master, tables.read_coordinates(spark, path), lambda q: (3.0, 4.0, q), path).count() == 0
    now = {r.station: r.lat for r in tables.read_coordinates(spark, path).collect()}
    assert now["GUNDALA"] == 3.0 and now["ALWAL"] == 1.0
    (tmp_path / "coordinates/data/left").mkdir()  # a writer that did not end
    assert tables.read_coordinates(spark, path).count() == master.count()


def moved(spark, *rows):
    return spark.createDataFrame(list(rows), "district string, station string, lat double, lng double")


def test_two_writers(spark, tmp_path, monkeypatch):
    """The second commits while the first has written but not committed: both rows of one bucket stay, and the loser merges again."""
    path, real, calls = str(tmp_path / "two"), tables.commits.create, []
    tables.write_coordinates(moved(spark, ("D", "OLD", 1.0, 1.0), ("D", "KEPT", 1.0, 1.0)), path)
    monkeypatch.setattr(tables, "_bucket", lambda: F.lit(7).alias("bucket"))

    def create(session, at, content):
        calls.append(at)
        if len(calls) == 1:
            tables.upsert_coordinates(moved(spark, ("D", "OTHER", 2.0, 2.0), ("D", "OLD", 5.0, 5.0)), path)
        return real(session, at, content)

    tables.write_coordinates(moved(spark, ("D", "OLD", 1.0, 1.0), ("D", "KEPT", 1.0, 1.0)), path)
    monkeypatch.setattr(tables.commits, "create", create)
    tables.upsert_coordinates(moved(spark, ("D", "MINE", 3.0, 3.0), ("D", "NONE", None, 3.0)), path)
    assert {r.station: r.lat for r in tables.read_coordinates(spark, path).collect()} == {"OLD": 5.0, "KEPT": 1.0, "OTHER": 2.0, "MINE": 3.0}
    assert len(calls) == 3 and tables.read_version(spark, path)["version"] == 4
    calls.clear()
    with pytest.raises(RuntimeError):
        tables.write_coordinates(moved(spark, ("D", "ALL", 1.0, 1.0)), path)


def test_untouched_buckets_are_not_rewritten(spark, tmp_path):
    path = str(tmp_path / "buckets")
    tables.write_coordinates(moved(spark, *[("D", f"S{i}", 1.0, 1.0) for i in range(300)]), path)
    before = tables.read_version(spark, path)["folders"]
    tables.upsert_coordinates(moved(spark, ("D", "S7", 2.0, 2.0)), path)
    after = tables.read_version(spark, path)
    assert sum(before[k] != after["folders"][k] for k in before) == 1 == len(after["changed"]) and len(before) > 40
    assert {r.lat for r in tables.read_coordinates(spark, path).where("station = 'S7'").collect()} == {2.0} and tables.read_coordinates(spark, path).count() == 300


def test_answers_are_asked_for_once(spark, tmp_path):
    path, asked_for = str(tmp_path / "answers"), tmp_path / "asked"
    asked_for.mkdir()

    async def ask(query):
        (asked_for / f"{query}-{len(list(asked_for.glob(query + '-*')))}").touch()
        if query == "down" or query == "shaky" and len(list(asked_for.glob("shaky-*"))) < 2:
            raise TimeoutError("too slow")
        return None if query == "nowhere" else (1.0, 2.0, query.title())

    queries = spark.createDataFrame([(q,) for q in ("here", "here", "nowhere", "down", "shaky", None)], "query string")
    config = AskConfig(repeats=2, pause_s=0.01)
    for turn in (1, 2):
        got = {r.query: (r.lat, r.formatted, r.reason) for r in answered(queries, ask, path, config).collect()}
        assert got == {"here": (1.0, "Here", None), "shaky": (1.0, "Shaky", None), "nowhere": (None, None, "no answer"), "down": (None, None, "TimeoutError: too slow")}
        assert {q: len(list(asked_for.glob(f"{q}-*"))) for q in got} == {"here": 1, "shaky": 2, "nowhere": turn, "down": 3 * turn}
    answered(queries, ask, path, AskConfig(repeats=0, keep_days=0.0)).count()  # what is too old is asked again
    assert len(list(asked_for.glob("here-*"))) == 2
    with pytest.raises(Exception, match="division"):
        answered(queries, lambda q: 1 / 0, str(tmp_path / "wrong")).collect()


def test_scan_of_a_master(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(" district ,Police Station,ROW NO\na,x,1\nA ,X,2\n,y,3\nb,,4\nb,z,five\nb,z,6,more\nb\nB,w,8\n")
    good, bad = tables.scan_master(spark, [str(tmp_path / "absent.csv"), str(path)], "Row No")
    assert sorted(map(tuple, good.collect())) == [(1, "A", "X"), (8, "B", "W")]
    assert sorted((r.reason, r.line) for r in bad.collect()) == [("malformed line", "b"), ("malformed line", "b,z,6,more"), ("no district", None), ("no row number", None), ("no station", None), ("repeats row 1", None)]
    spark.createDataFrame([("a", "x"), (None, "y")], "DISTRICT string, STATION string").write.parquet(str(tmp_path / "m.parquet"))
    good, bad = tables.scan_master(spark, [str(tmp_path / "m.parquet")])
    assert [r.station for r in good.collect()] == ["X"] and [r.reason for r in bad.collect()] == ["no district"]
    with pytest.raises(KeyError):
        tables.scan_master(spark, [str(path)], "nothing")


def test_order_of_a_master_without_row_numbers(spark):
    rows = spark.createDataFrame([(f"D{i % 7}", f"S{i * 37 % 101}") for i in range(300)], "district string, station string").repartition(5)
    got = sorted((r.row_no, r.district, r.station) for r in tables.standard_master(rows).collect())
    assert [r[0] for r in got] == list(range(1, 301)) and [r[1:] for r in got] == sorted(r[1:] for r in got)


def test_read_and_command_line(spark, master, tmp_path, monkeypatch):
    from waymark import cli

    path = lambda n: str(tmp_path / n)
    raw = master.selectExpr("row_no as n", "district as DISTRICT", "station as `POLICE STATION`").coalesce(1)
    raw.write.csv(path("m.csv"), header=True)
    raw.write.json(path("m.json"))
    raw.write.orc(path("m.orc"))
    raw.write.parquet(path("m.parquet"))
    want = sorted(map(tuple, tables.standard_master(raw, "n").collect()))
    assert all(sorted(map(tuple, tables.standard_master(tables.read(spark, path(f"m.{e}")), "n").collect())) == want for e in ("csv", "json", "orc", "parquet"))
    asked(spark, (1, ADDRESSES[1][0], None, None), (2, None, "gachibowli", None)).write.parquet(path("r.parquet"))
    cli.main(["--master", path("none.csv"), "--master", path("m.csv"), "--row-no", "n", "--requests", path("r.parquet"), "--out", path("out"), "--log", path("log")])
    assert {r.request_id: r.results[0].station for r in spark.read.parquet(path("out")).collect()} == {1: "BORABANDA", 2: "GACHIBOWLI"}
    assert tables.read_log(spark, path("log")).count() == 2
    with pytest.raises(FileNotFoundError):
        tables.first_there(spark, [path("none")])


def test_log(spark, master, tmp_path):
    requests = asked(spark, (1, " ", "GACHIBOWLI", ""), (2, "", "NAWABPET", ""), (3, "", "ZZZ", ""), (4, "", "BALANAGAR", ""))
    answers = resolve(requests, master)
    picks = spark.createDataFrame([(2, 2), (4, None)], "request_id long, rank int")
    rows = {r.request_id: r for r in tables.log_rows(requests, answers, picks).collect()}
    assert set(rows) == {1, 2, 4} and rows[1]["RESULT MATCH"] == "Guaranteed" and rows[1]["RESULT LOOKUP"] == "DISTRICT"
    assert rows[2]["PREDICTED DISTRICT"] == "VIKARABAD" and rows[4]["PREDICTED PS"] == "" and rows[4]["RESULT MATCH"] == ""
    path = str(tmp_path / "log")
    assert tables.read_log(spark, path) is None
    added = [tables.append_log(tables.log_rows(requests, answers), path, batch) for batch in ("one", "one", "two", None, None)]
    assert added == [True, False, True, True, True] and tables.read_log(spark, path).count() == 12
    older = str(tmp_path / "older")  # a table of its own columns
    spark.createDataFrame([tuple("abcdef")], ", ".join(f"`{c}` string" for c in [*tables.LOG_WRITTEN, "OWN"])).write.parquet(older)
    assert tables.append_log(tables.log_rows(requests, answers), older, "one") and tables.read_log(spark, older).columns[-1] == "OWN" and tables.read_log(spark, older).count() == 4
    bad = str(tmp_path / "bad")
    spark.createDataFrame([("x",)], "ADDRESS string").write.parquet(bad)
    with pytest.raises(KeyError):
        tables.append_log(tables.log_rows(requests, answers), bad)
    assert {r.surety for r in shown(answers).collect()} == {"Guaranteed", "Likely"}


def test_stream_equals_batch(spark, master, tmp_path):
    from waymark.streaming.requests import answer_stream

    requests = asked(spark, *[(k, a, "", "") for k, (a, _) in ADDRESSES.items()])
    requests.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    answer_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), lambda: {"master": master}).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = resolve(requests, master)
    key = lambda df: sorted((r.request_id, r.rung, str(r.results)) for r in df.collect())
    assert key(got) == key(want)


def test_stream_keeps_answers(spark, master, tmp_path):
    from waymark.streaming import requests as stream

    out, refer = str(tmp_path / "out"), lambda: {"master": master}
    stream.answer_batch(asked(spark, (1, "", "GACHIBOWLI", ""), (2, "", " GACHIBOWLI ", None), (3, "", "ALWAL", "")), 0, out, refer)
    none = lambda: {"master": master.where("false")}
    for number, keep, n in ((1, "36500 days", 0), (1, "36500 days", 0), (2, "0 seconds", 1)):  # the second one again, as after a failure
        stream.answer_batch(asked(spark, (7, "", "GACHIBOWLI", "")), number, out, none if n == 0 else refer, keep)
        assert spark.read.parquet(f"{out}/_answers/batch={number}").count() == n
    got = sorted((r.request_id, r.batch, r.results[0].station) for r in spark.read.parquet(out).collect())
    assert got == [(1, 0, "GACHIBOWLI"), (2, 0, "GACHIBOWLI"), (3, 0, "ALWAL"), (7, 1, "GACHIBOWLI"), (7, 2, "GACHIBOWLI")]


def test_documents_scan(spark, tmp_path):
    """Long texts in several languages, word by word against every name."""
    dice, parts = random.Random(8), ["gachibowli", "größenordnung", "GACHIBOWLY", "the", "élève", "malkajgri", "balanagar x", "secunderabad", "main road", "gachi", "bowli,", "\n", ";"]
    texts = [" ".join(dice.choice(parts) for _ in range(n)) for n in (0, 1, 5, 20, 3000)] + [None, "x" * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "Gachibowli malkajgiri, secunderabad größenordnungen balanagar-"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["GACHIBOWLI", "MALKAJGIRI", "SECUNDERABAD", "SSENORDNUNGEN", "BALANAGAR"]
    want = set()
    for doc, text in enumerate(texts):
        places = []
        for segment in re.split(r"[,\n;|/]+", (text or "").upper()):
            words = [w for w in re.split("[^A-Z]+", segment) if w and w not in STOPWORDS]
            places += [" ".join(words), *words]
        places = [p for p in dict.fromkeys(places) if len(p.replace(" ", "")) >= 4]
        for name in names:
            score, _, place = max(((one_by_one.strict(p, name), -i, p) for i, p in enumerate(places)), default=(0, 0, ""))
            if score >= 86:
                want.add((doc, name, round(score, 1), place))
    from waymark.queries import documents_scan

    got = {(r.request_id, r.station, r.score, r.locality) for r in documents_scan(spark, str(tmp_path)).collect()}
    assert got == want and len(want) > 5


def test_addresses_with_the_same_letters_are_scanned_once(spark):
    from waymark.operators.scan import asked, places

    requests = spark.createDataFrame([(1, "H NO 1-2, red anvil, PIN 5001"), (2, "h no 77-3, Red Anvil, pin 9"), (3, None), (4, "Straße 5; ABC")], "request_id long, address string")
    assert sorted(r.places for r in places(requests).collect()) == [["RED ANVIL", "ANVIL"], ["STRASSE"]]
    keys = {r.request_id: bytes(r.a) for r in requests.select("request_id", asked().alias("a")).collect()}
    assert keys[1] == keys[2] and len({keys[1], keys[3], keys[4]}) == 3
    master = spark.createDataFrame([(1, "D", "RED ANVIL")], "row_no long, district string, station string")
    assert sorted((r.request_id, r.station, r.score, r.locality) for r in station_scan(requests, master).collect()) == [(1, "RED ANVIL", 100.0, "RED ANVIL"), (2, "RED ANVIL", 100.0, "RED ANVIL")]


def test_letters_and_lengths_rule_out_only_what_the_strict_score_does(spark):
    """Of pairs that share a key few are scored, and none is lost, with noise words, odd white space and other scripts among them."""
    from waymark.functions.similarity import scores
    from waymark.operators.similar import allowed, lengths, proposed, similar

    dice = random.Random(5)
    word = lambda: "".join(dice.choice("ABCDEFGHIKLMNOPRSTU") for _ in range(dice.randint(4, 9)))
    names = [" ".join(word() for _ in range(dice.randint(1, 2))) for _ in range(300)] + ["\u00c9L\u00c8VE \u0416\u0416", "NB\u00a0SP\u00a0", ""]
    change = lambda x: "".join(c for c in x if dice.random() > 0.07) if dice.random() < 0.6 else " ".join(reversed(x.split(" ")))
    tokens = [change(x) for x in names for _ in range(3)] + [word() for _ in range(300)] + ["NB SP", "", "A" * 70]
    for cutoff in (86.0, 60.0):
        a, b = (spark.createDataFrame([(x, x) for x in xs], f"{n} string, normal string") for xs, n in ((tokens, "token"), (names, "name")))
        pairs = [(x, y) for x in dict.fromkeys(tokens) for y in dict.fromkeys(names)]
        want = {(x, y, z) for (x, y), z in zip(pairs, scores("strict", *map(list, zip(*pairs))).tolist()) if z >= cutoff}
        assert {tuple(r) for r in similar(a, b, "strict", cutoff).collect()} == want and len(want) > 300
        least, most = lengths(cutoff, min(len(y) for y in names if y), max(map(len, names)))
        assert all(least <= len(x) <= most for x, y, _ in want if x and y)
    assert proposed(a, b, "strict", 86.0).count() < 0.02 * len(pairs)


def test_places_too_long_or_short_for_any_name_are_not_scored(spark, monkeypatch):
    from waymark.operators import scan

    seen, own = [], scan.similar
    monkeypatch.setattr(scan, "similar", lambda tokens, *more: (seen.extend(r.token for r in tokens.collect()), own(tokens, *more))[1])
    requests = spark.createDataFrame([(1, "police station red anvil thana, a very long segment that no name is like, tiny, red anvil")], "request_id long, address string")
    master = spark.createDataFrame([(1, "DISTRICTS", "RED ANVIL")], "row_no long, district string, station string")
    got = [(r.request_id, r.station, r.score, r.locality) for r in scan.station_scan(requests, master).collect()]
    assert got == [(1, "RED ANVIL", 100.0, "POLICE STATION RED ANVIL THANA")]
    assert sorted(seen) == ["POLICE STATION RED ANVIL THANA", "RED ANVIL", "SEGMENT", "STATION"]


def test_the_ladder_broadcasts_nothing_that_grows_with_the_requests(spark, master, coordinates, monkeypatch):
    """By the compressed size of a scratch table Spark would send the keys of all requests through the driver."""
    from waymark.operators import ranking, scan
    from waymark.plans import ladder
    from waymark.scratch import save

    plans, plan_of = [], lambda df: df._jdf.queryExecution().sparkPlan().toString()
    for module in (ladder, scan):
        monkeypatch.setattr(module, "save", lambda df: (plans.append(plan_of(df)), save(df))[1])
    requests = asked(spark, (1, "9, BORABANDA", None, None), (2, "9, QQQQQ", None, "DIST_F"), (3, "9", "GUNDALA", "dist_b"), (4, "9, vikarabad", None, None), (5, "5, nowhere", None, "WARANGA"), (6, "6", "nothing like it", None), (7, None, None, "DIST_B"))
    geocodes = spark.createDataFrame([("9, QQQQQ", 17.2, 78.2), ("9, vikarabad", 17.2, 78.2), ("5, nowhere", 17.2, 78.2), ("6", 17.2, 78.2)], "query string, lat double, lng double")
    inferences = spark.createDataFrame([("6", '{"districts": ["DIST_F", "DIST_A"]}')], "address string, reply string")
    answers = resolve(requests, master, coordinates, geocodes, inferences)
    assert {r.request_id: r.rung for r in answers.collect()} == {1: "3a", 2: "2", 3: "1", 4: "3b", 5: "2", 6: "3c", 7: "2"}
    residents, replies = save(requests.withColumn("district", F.lit("DIST_F"))), save(inferences.withColumn("district", F.lit("DIST_F")))
    plans += [plan_of(answers), plan_of(ranking.estimate_ranked(residents, save(master), replies, 3))]
    joins = [line for plan in plans for line in plan.splitlines() if "Join [" in line]
    broadcast = [line for line in joins if "BroadcastHashJoin" in line]
    assert any("SortMergeJoin [request_id" in line for line in joins)
    assert not [line for line in broadcast if re.search(r"Join \[[^\]]*\b(request_id|query)#", line)]
    assert not [line for line in broadcast if "Join [typed#" in line and "BuildLeft" in line]
