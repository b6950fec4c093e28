"""Projection, cell keys and areas as column formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS 84 ellipsoid, UTM scale and the radius of the equal-area sphere.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING_SOUTH = 10000000.0
SPHERE_RADIUS = 6371000.0


def krueger_constants() -> dict[str, float]:
    """Constants of the third-order Krüger series, from the ellipsoid's flattening."""
    n = WGS84_F / (2 - WGS84_F)
    return {
        "A": WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64),
        "a1": n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        "a2": 13 * n**2 / 48 - 3 * n**3 / 5,
        "a3": 61 * n**3 / 240,
        "e": 2 * math.sqrt(n) / (1 + n),
    }


def valid_point(lon: Column, lat: Column) -> Column:
    """Whether a coordinate pair is finite and in range (false for nulls and NaN)."""
    return F.coalesce(lon.between(-180, 180) & lat.between(-90, 90), F.lit(False))


def utm_zone(lon: Column) -> Column:
    """Zone 1 to 60 as an integer."""
    return (F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG number of the zone holding a point: 326xx north, 327xx south."""
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def _atanh(x: Column) -> Column:
    return 0.5 * F.log((1 + x) / (1 - x))


def with_utm(df: DataFrame, zone: Column, south: Column, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """`df` with `x` and `y`, easting and northing in metres in a given zone.

    The series is built in steps, each a column: written as one expression, every later
    term would repeat the earlier ones.
    """
    k = krueger_constants()
    steps = df.withColumns({"_sin": F.sin(F.radians(lat)), "_lam": F.radians(F.col(lon) - (zone * 6 - 183))})
    sin = F.col("_sin")
    steps = steps.withColumn("_t", F.sinh(_atanh(sin) - k["e"] * _atanh(k["e"] * sin)))
    t = F.col("_t")
    steps = steps.withColumns({
        "_xi": F.atan2(t, F.cos("_lam")), "_eta": _atanh(F.sin("_lam") / F.sqrt(1 + t * t))})
    terms = range(1, 4)
    east = "_eta + " + " + ".join(f"{k[f'a{j}']!r}D * cos({2 * j} * _xi) * sinh({2 * j} * _eta)" for j in terms)
    north = "_xi + " + " + ".join(f"{k[f'a{j}']!r}D * sin({2 * j} * _xi) * cosh({2 * j} * _eta)" for j in terms)
    scale = F.lit(UTM_SCALE * k["A"])
    return steps.withColumns({
        "x": FALSE_EASTING + scale * F.expr(east),
        "y": scale * F.expr(north) + F.when(south, FALSE_NORTHING_SOUTH).otherwise(0.0),
    }).drop("_sin", "_lam", "_t", "_xi", "_eta")


def wrap_longitude(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def cell_index(value: Column, origin: float | Column, size: float | Column) -> Column:
    """Integer cell number along one axis."""
    return F.floor((value - origin) / size).cast("bigint")


def cell_key(ix: Column, iy: Column) -> Column:
    """One BIGINT for a pair of signed 32-bit cell numbers."""
    return F.shiftleft(ix.cast("bigint"), 32) + (iy.cast("bigint") + F.lit(2147483648))


def cell_key_x(key: Column) -> Column:
    return F.shiftright(key, 32)


def cell_key_y(key: Column) -> Column:
    return key.bitwiseAND(F.lit(4294967295)) - F.lit(2147483648)


def spherical_cell_area(lat_low: Column, size: float) -> Column:
    """Area in m² of a square-degree cell on the sphere."""
    band = F.sin(F.radians(lat_low + size)) - F.sin(F.radians(lat_low))
    return F.lit(SPHERE_RADIUS**2 * math.radians(size)) * band


def _spread_bits(value: Column) -> Column:
    """Put the low 31 bits of a number on the even bit positions."""
    out = value.cast("bigint")
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
    return out


def global_cell(lon: Column, lat: Column, resolution: int) -> Column:
    """Discrete global cell number: bit-interleaved longitude and latitude, `resolution` (1 to 31) bits each."""
    if not 1 <= resolution <= 31:
        raise ValueError(f"resolution must be 1 to 31, not {resolution}")
    n = 2**resolution
    x = F.least(F.floor((wrap_longitude(lon) + 180) / 360 * n), F.lit(n - 1))
    y = F.least(F.floor((lat + 90) / 180 * n), F.lit(n - 1))
    return _spread_bits(x).bitwiseOR(F.shiftleft(_spread_bits(y), 1))
