"""Distances on the WGS-84 ellipsoid."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ellipsoid in km, and units by km.
AXIS, FLAT = 6378.137, 1 / 298.257223563
UNITS = {"km": 1.0, "m": 1000.0, "mi": 1 / 1.609344, "nmi": 1 / 1.852}
#: Nodes and weights of the integrals along a geodesic. The ellipsoid is so round that these are exact to the last digits over half a turn.
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(16)
#: Steps at most. Nearly all pairs need four; those near the antipodes, where a step may leave its bracket and halves it instead, some dozens.
STEPS = 80


class _Lines:
    """Geodesics from latitude one to latitude two by their first azimuth, on the auxiliary sphere (C. F. F. Karney, Algorithms for geodesics, 2013).

    The first latitude is not north of the equator and not nearer to it than the second.
    """

    def __init__(self, s1: np.ndarray, c1: np.ndarray, s2: np.ndarray, c2: np.ndarray):
        self.s1, self.c1, self.s2, self.c2 = s1, c1, s2, c2

    def only(self, some: np.ndarray) -> _Lines:
        return _Lines(self.s1[some], self.c1[some], self.s2[some], self.c2[some])

    def at(self, azimuth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(difference of longitude, its derivative by the azimuth, length in axes)."""
        sin, cos = np.sin(azimuth), np.cos(azimuth)
        top = sin * self.c1  # sine of the azimuth at the equator
        end = np.sqrt((cos * self.c1) ** 2 + np.maximum((self.s1 - self.s2) * (self.s1 + self.s2), 0.0))  # cosines of the second azimuth and latitude
        a, b = np.arctan2(self.s1, cos * self.c1), np.arctan2(self.s2, end)
        turn = np.arctan2(top * self.s2, end) - np.arctan2(top * self.s1, cos * self.c1)
        bend = FLAT * (2 - FLAT) / (1 - FLAT) ** 2 * (cos**2 + (sin * self.s1) ** 2)
        half = (b - a) / 2
        root = np.sqrt(1 + bend[:, None] * np.sin(half[:, None] * _NODES + ((a + b) / 2)[:, None]) ** 2)
        length, slant, rest = (half * (f @ _WEIGHTS) for f in (root, (2 - FLAT) / (1 + (1 - FLAT) * root), root - 1 / root))
        width = np.sqrt(1 + bend * np.sin(b) ** 2) * np.cos(a) * np.sin(b) - np.sqrt(1 + bend * np.sin(a) ** 2) * np.sin(a) * np.cos(b) - np.cos(a) * np.cos(b) * rest
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = (1 - FLAT) * width / end
        return turn - FLAT * top * slant, slope, (1 - FLAT) * length


def ellipsoid_km(lat1: np.ndarray, lng1: np.ndarray, lat2: np.ndarray, lng2: np.ndarray) -> np.ndarray:
    """Lengths of the shortest lines on the ellipsoid, by Newton steps on the first azimuth within a bracket, also between antipodes.

    0 for equal points; NaN where a coordinate is no finite number. Longitudes may have any number of turns; latitudes beyond a pole count as the pole.
    """
    lat1, lng1, lat2, lng2 = (np.asarray(x, float) for x in (lat1, lng1, lat2, lng2))
    out = np.full(lat1.shape, np.nan)
    fine = np.flatnonzero(np.isfinite(lat1) & np.isfinite(lng1) & np.isfinite(lat2) & np.isfinite(lng2))
    lat1, lat2 = np.clip(lat1[fine], -90, 90), np.clip(lat2[fine], -90, 90)
    turn = np.radians(np.abs(np.remainder(lng2[fine] - lng1[fine] + 180.0, 360.0) - 180.0))
    swap = np.abs(lat1) < np.abs(lat2)
    lat1, lat2 = np.where(swap, lat2, lat1), np.where(swap, lat1, lat2)
    flip = np.where(lat1 > 0, -1.0, 1.0)

    def reduced(lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, c = (1 - FLAT) * np.sin(np.radians(lat)), np.maximum(np.cos(np.radians(lat)), 1e-15)
        return s / np.hypot(s, c), c / np.hypot(s, c)

    (s1, c1), (s2, c2) = reduced(lat1 * flip), reduced(lat2 * flip)
    s1 = np.where(s1 == 0, -1e-200, s1)
    lines = _Lines(s1, c1, s2, c2)
    azimuth = np.arctan2(c2 * np.sin(turn), c1 * s2 - s1 * c2 * np.cos(turn))  # as on a sphere
    low, high = np.zeros_like(turn), np.full_like(turn, np.pi)
    equator = (np.abs(lat1) == 0) & (np.abs(lat2) == 0)
    low[equator] = np.pi / 2
    azimuth = np.where(turn == 0, np.arctan2(0.0, c1 * s2 - s1 * c2), np.clip(azimuth, low, high))
    live = np.flatnonzero((turn > 0) & ~(equator & (turn <= np.pi * (1 - FLAT))))
    for _ in range(STEPS):
        if not len(live):
            break
        found, slope, _ = lines.only(live).at(azimuth[live])
        over = found - turn[live]
        high[live] = np.where(over > 0, azimuth[live], high[live])
        low[live] = np.where(over > 0, low[live], azimuth[live])
        with np.errstate(divide="ignore", invalid="ignore"):
            step = azimuth[live] - over / slope
        fits = np.isfinite(step) & (step > low[live]) & (step < high[live])
        step = np.where(fits, step, (low[live] + high[live]) / 2)
        step = np.where(np.abs(over) > 1e-15, step, azimuth[live])
        azimuth[live], before = step, azimuth[live]
        live = live[np.abs(step - before) > 1e-15]
    length = lines.at(azimuth)[2]
    length = np.where(equator & (turn <= np.pi * (1 - FLAT)), turn, length)
    out[fine] = AXIS * np.where((lat1 == lat2) & (turn == 0), 0.0, length)
    return out


@F.pandas_udf(T.DoubleType())
def _km(lat1: pd.Series, lng1: pd.Series, lat2: pd.Series, lng2: pd.Series) -> pd.Series:
    return pd.Series(ellipsoid_km(lat1, lng1, lat2, lng2))


def geodesic(lat1: Column | str, lng1: Column | str, lat2: Column | str, lng2: Column | str, unit: str = "km") -> Column:
    """Distance of two points; null if a coordinate is. An unknown unit is an error."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}; known are {', '.join(UNITS)}")
    made = _km(lat1, lng1, lat2, lng2) * UNITS[unit]
    known = F.lit(True)
    for c in (lat1, lng1, lat2, lng2):
        known = known & (F.col(c) if isinstance(c, str) else c).isNotNull()
    return F.when(known, made)


def series_km(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    """The length by T. Vincenty's series, eight rounds in plain doubles of the C library; it settles within a region. It tells apart what `ellipsoid_km` leaves equal."""
    if lat1 == lat2 and lng1 == lng2:
        return 0.0
    u1, u2 = math.atan((1 - FLAT) * math.tan(math.radians(lat1))), math.atan((1 - FLAT) * math.tan(math.radians(lat2)))
    s1, c1, s2, c2 = math.sin(u1), math.cos(u1), math.sin(u2), math.cos(u2)
    turn = lam = math.radians(lng2 - lng1)
    for i in range(8):
        if i:
            k = FLAT / 16 * sq * (4 + FLAT * (4 - 3 * sq))
            lam = turn + (1 - k) * FLAT * alpha * (sigma + k * s * (m + k * c * (2 * m * m - 1)))
        s = math.sqrt((c2 * math.sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * math.cos(lam)) ** 2)
        c = s1 * s2 + c1 * c2 * math.cos(lam)
        sigma = math.atan2(s, c)
        alpha = 0.0 if s == 0 else c1 * c2 * math.sin(lam) / s
        sq = 1 - alpha * alpha
        m = 0.0 if sq == 0 else c - 2 * s1 * s2 / sq
    semi = AXIS * (1 - FLAT)
    u = sq * (40680631.590769 - semi * semi) / (semi * semi)  # the square of AXIS, as a decimal number
    big, small = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))), u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    less = small * s * (m + small / 4 * (c * (2 * m * m - 1) - small / 6 * m * (4 * s * s - 3) * (4 * m * m - 3)))
    return semi * big * (sigma - less)


@F.pandas_udf(T.DoubleType())
def series(lat1: pd.Series, lng1: pd.Series, lat2: pd.Series, lng2: pd.Series) -> pd.Series:
    """`series_km` of each row, each distinct one once; null if a coordinate is."""
    rows = list(zip(lat1.tolist(), lng1.tolist(), lat2.tolist(), lng2.tolist(), strict=True))
    made = {x: series_km(*x) for x in set(rows) if all(map(math.isfinite, x))}
    return pd.Series([made.get(x) for x in rows], dtype="float64")


def shown_km(km: Column | str, places: int = 1) -> Column:
    """'~12.3 km', rounded to even; 'N/A' for null."""
    c = F.col(km) if isinstance(km, str) else km
    number = F.format_string(f"~%.{places}f km", F.bround(c, places).cast("double"))
    return F.when(c.isNull(), F.lit("N/A")).otherwise(number)
