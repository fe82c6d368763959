"""Universal transverse Mercator coordinates as column expressions, both ways, zone and hemisphere as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: WGS84 ellipsoid, UTM scale and false origins
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
FALSE_EASTING = 500_000.0
SOUTH_FALSE_NORTHING = 10_000_000.0

_N = WGS84_F / (2 - WGS84_F)
RADIUS = UTM_K0 * WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ECCENTRICITY = 2 * math.sqrt(_N) / (1 + _N)
# fixed values: Krueger series in the third flattening (to the sphere, from the sphere, conformal to geographic latitude)
FORWARD = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
]
BACKWARD = [
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
]
LATITUDE = [
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
]


def utm_zone(lon: Column) -> Column:
    """Zone 1 to 60 of a longitude; 180 degrees east belongs to the first."""
    return (F.floor((lon + 180.0) / 6.0).cast("int") % 60) + 1


def central_meridian(zone: Column) -> Column:
    return zone * 6.0 - 183.0


def on_earth(lon: Column, lat: Column) -> Column:
    """Whether both are present, finite and within 180 and 90 degrees."""
    return F.coalesce(lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0) & ~F.isnan(lon) & ~F.isnan(lat), F.lit(False))


def to_utm(df: DataFrame, zone: Column, south: Column, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    """``df`` with easting and northing in metres; NULL off the earth.

    Each step is a projection of its own, as the series use the values before them many times.
    """
    usable = on_earth(F.col(lon), F.col(lat))
    # the meridian is crossed the short way, so 179 and -179 degrees are two degrees apart
    turn = F.pmod(F.col(lon) - central_meridian(zone) + 180.0, F.lit(360.0)) - 180.0
    out = df.withColumn("_lam", F.when(usable, F.radians(turn))).withColumn("_s", F.when(usable, F.sin(F.radians(F.col(lat)))))
    out = out.withColumn("_t", F.sinh(F.atanh("_s") - F.lit(ECCENTRICITY) * F.atanh(F.lit(ECCENTRICITY) * F.col("_s"))))
    out = out.withColumn("_xi", F.atan2("_t", F.cos("_lam"))).withColumn("_eta", F.atanh(F.sin("_lam") / F.sqrt(1.0 + F.col("_t") * F.col("_t"))))
    east, north = F.col("_eta"), F.col("_xi")
    for j, a in enumerate(FORWARD, start=1):
        east = east + F.lit(a) * F.cos(F.col("_xi") * (2 * j)) * F.sinh(F.col("_eta") * (2 * j))
        north = north + F.lit(a) * F.sin(F.col("_xi") * (2 * j)) * F.cosh(F.col("_eta") * (2 * j))
    out = out.withColumn(x, F.lit(FALSE_EASTING) + F.lit(RADIUS) * east)
    return out.withColumn(y, F.when(south, F.lit(SOUTH_FALSE_NORTHING)).otherwise(0.0) + F.lit(RADIUS) * north).drop("_lam", "_s", "_t", "_xi", "_eta")


def from_utm(df: DataFrame, zone: Column, south: Column, x: str = "x", y: str = "y", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``df`` with longitude and latitude in degrees of an easting and northing."""
    xi = (F.col(y) - F.when(south, F.lit(SOUTH_FALSE_NORTHING)).otherwise(0.0)) / F.lit(RADIUS)
    out = df.withColumn("_xi", xi).withColumn("_eta", (F.col(x) - F.lit(FALSE_EASTING)) / F.lit(RADIUS))
    a, b = F.col("_xi"), F.col("_eta")
    for j, c in enumerate(BACKWARD, start=1):
        a = a - F.lit(c) * F.sin(F.col("_xi") * (2 * j)) * F.cosh(F.col("_eta") * (2 * j))
        b = b - F.lit(c) * F.cos(F.col("_xi") * (2 * j)) * F.sinh(F.col("_eta") * (2 * j))
    out = out.withColumn("_a", a).withColumn("_b", b).withColumn("_chi", F.asin(F.sin("_a") / F.cosh("_b")))
    phi = F.col("_chi")
    for j, c in enumerate(LATITUDE, start=1):
        phi = phi + F.lit(c) * F.sin(F.col("_chi") * (2 * j))
    turn = central_meridian(zone) + F.degrees(F.atan2(F.sinh("_b"), F.cos("_a")))
    return out.withColumn(lon, F.pmod(turn + 180.0, F.lit(360.0)) - 180.0).withColumn(lat, F.degrees(phi)).drop("_xi", "_eta", "_a", "_b", "_chi")


def projected(df: DataFrame, zone: Column, south: Column, lon: str = "lon", lat: str = "lat", valid: str = "geo_valid") -> DataFrame:
    """``df`` with ``x, y`` in metres and ``valid``: whether the position is on the earth and its projection finite."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in ("x", "y")]
    return to_utm(df, zone, south, lon, lat).withColumn(valid, F.coalesce(finite[0] & finite[1], F.lit(False)))
