"""The grid of the nearest stations against all distances, and published lengths of geodesics."""

import numpy as np
import pytest

from waymark.functions.geo import ellipsoid_km
from waymark.operators.nearest import nearest

# Published lengths in metres.
LENGTHS = [
    (-30, 0, 29.9, 179.8, 19989832.827610), (40, 0, 41.79331020506, 137.84490004377, 10000000.0), (0, 0, 0.5, 179.5, 19936288.578965), (0, 0, 0.5, 179.7, 19944127.420749),
    (0, 0, 0, 180, 20003931.458625), (0, 0, 90, 0, 10001965.729313), (0, 0, 0, 179, 19926188.851996), (90, 5, -90, 7, 20003931.458625), (45, 0, -45, 180, 20003931.458625),
]


def test_published_lengths():
    lat1, lng1, lat2, lng2, metres = np.array(LENGTHS).T
    for a, b in (((lat1, lng1), (lat2, lng2)), ((lat2, lng2 + 360), (lat1, lng1)), ((-lat1, -lng1), (-lat2, -lng2))):
        assert np.abs(ellipsoid_km(*a, *b) * 1000 - metres).max() < 1e-4


def test_lengths_are_a_metric():
    dice = np.random.default_rng(1)
    p = [(dice.uniform(-90, 90, 300), dice.uniform(-200, 200, 300)) for _ in range(3)]
    p[1][0][:100], p[1][1][:100] = -p[0][0][:100] + dice.uniform(-1, 1, 100).clip(-90, 90), p[0][1][:100] + 180 + dice.uniform(-1, 1, 100)  # near the antipodes
    ab, bc, ac = ellipsoid_km(*p[0], *p[1]), ellipsoid_km(*p[1], *p[2]), ellipsoid_km(*p[0], *p[2])
    assert np.abs(ab - ellipsoid_km(*p[1], *p[0])).max() < 1e-7 and (ac <= ab + bc + 1e-7).all() and (ab < 20003.932).all()
    assert ellipsoid_km(p[0][0], p[0][1], p[0][0], p[0][1] + 720).tolist() == [0.0] * 300
    assert np.isnan(ellipsoid_km(np.array([np.nan, np.inf]), np.zeros(2), np.zeros(2), np.zeros(2))).all()


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_against_all_distances(spark, k):
    dice = np.random.default_rng(k)
    centres = [(17, 78, 0.5), (0, 179.9, 1.5), (89, 10, 1), (-89.5, -100, 0.5), (45, 0, 40)]
    place = lambda: (lambda c: (float(np.degrees(np.arcsin(np.sin(np.radians(dice.normal(c[0], c[2])))))), float(dice.normal(c[1], c[2] * 3))))(centres[dice.integers(0, 5)])
    stations = [(f"D{i % 3}", f"S{i}", i, *place()) for i in range(400)] + [("D3", "ONE", 1, 1.0, 1.0)]
    stations += [("D0", "TWIN", 5000, *stations[0][3:]), ("D1", "NOWHERE", 5001, None, 1.0)]
    points = [(i, f"D{i % 4}", *place()) for i in range(150)] + [(900, "D0", *stations[0][3:]), (901, "D9", 1.0, 1.0), (902, "D0", 90.0, 0.0), (903, "D0", -90.0, 5.0), (904, "D1", None, 1.0), (905, "D2", 0.0, -180.0)]
    got = nearest(spark.createDataFrame([*points, points[0]], "request_id long, district string, lat0 double, lng0 double"), spark.createDataFrame(stations, "district string, station string, row_no long, lat double, lng double"), k)
    want = []
    for r, d, lat, lng in points:
        own = [s for s in stations if s[0] == d and s[3] is not None and lat is not None]
        if own:
            km = ellipsoid_km(np.full(len(own), lat), np.full(len(own), lng), np.array([s[3] for s in own]), np.array([s[4] for s in own]))
            want += [(r, d, i + 1, own[j][1]) for i, j in enumerate(sorted(range(len(own)), key=lambda j: (round(km[j], 9), own[j][2]))[:k])]
    assert sorted((r.request_id, r.district, r.rank, r.station) for r in got.collect()) == sorted(want)


def test_almost_equal_distances_are_told_apart_by_series(spark):
    """At 5.533474210450 km both, to a nanometre: the plain series, as in the SQL, puts the one of the later row first; equal places keep row order."""
    from waymark.operators.ranking import distance_ranked

    places = [("D", "WEST", 200, 16.5, 78.02), ("D", "EAST", 960, 16.5, 78.096), ("D", "NEAR", 3000, 16.5, 78.053), ("D", "EAST AGAIN", 961, 16.5, 78.096)]
    stations = spark.createDataFrame(places, "district string, station string, row_no long, lat double, lng double")
    want = ["NEAR", "EAST", "EAST AGAIN", "WEST"]
    got = nearest(spark.createDataFrame([(1, "D", 16.466, 78.058)], "request_id long, district string, lat0 double, lng0 double"), stations, 4)
    assert [r.station for r in got.orderBy("rank").collect()] == want
    requests = spark.createDataFrame([(1, "A", "D")], "request_id long, address string, district string")
    geocodes = spark.createDataFrame([("A", 16.466, 78.058)], "query string, lat double, lng double")
    ranked = distance_ranked(requests, stations.select("district", "station", "row_no"), stations.drop("row_no"), geocodes)
    assert [r.station for r in ranked.orderBy("rank").collect()] == want
