"""Gridded climate and density jobs over the stand-in cube and grids, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geodesy import wrap_longitude
from ..functions import suitability
from ..operators import grids
from ..plans import climate
from ..sources import proxy
from ..sources.proxy import with_views
from .kpi_queries import rounded


def _cells(spark, d):
    """One row per day and cell, the warmest and wettest line."""
    return proxy.climate(spark, d).groupBy("time", "ix", "iy").agg(
        F.max("temperature").alias("temperature"), F.max("rainfall").alias("rainfall"))


def _suitability(spark, d):
    c = proxy.climate(spark, d)
    per = _cells(spark, d)
    people = c.groupBy("ix", "iy").agg(F.max("human_density").alias("human_density"))
    return rounded(climate.suitability(per.select("time", "ix", "iy", "temperature"),
                                       per.select("time", "ix", "iy", "rainfall"), people))


def _traits(spark, d):
    c = proxy.climate(spark, d)
    t = F.col("temperature")
    return rounded(c.select("line_key", "line_no",
                            suitability.trait("aegypti", "biting", t).alias("briere"),
                            suitability.trait("albopictus", "survival", t).alias("quad"),
                            suitability.trait("aegypti", "egg_mortality", t).alias("poly"),
                            suitability.trait("albopictus", "development", t).alias("development"),
                            suitability.hatching_rate(F.col("human_density"), F.col("rainfall")).alias("hatch")))


def _weather(spark, d):
    return rounded(climate.weather(proxy.climate(spark, d)).select("line_key", "line_no", "mwi"))


def _weather_parts(spark, d):
    c = proxy.climate(spark, d)
    t, dew = suitability.celsius(F.col("t2m")), suitability.celsius(F.col("d2m"))
    return rounded(c.select("line_key", "line_no", suitability.wind_speed(F.col("u10"), F.col("v10")).alias("wind"),
                            t.alias("celsius"), suitability.relative_humidity(t, dew).alias("humidity")))


def _masked(spark, d):
    index = climate.weather(proxy.climate(spark, d)).groupBy("time", "ix", "iy").agg(F.max("mwi").alias("mwi")).select(
        "time", F.round(wrap_longitude(F.col("ix") * 36.0), 6).alias("longitude"), F.col("iy").cast("double").alias("latitude"), "mwi")
    s = F.col("s_suppkey")
    mask = proxy.table(spark, d, "supplier", "s_suppkey").select(
        (s % 10 * 36.0).alias("longitude"), F.floor(s / 10).cast("double").alias("latitude"), (s % 3 != 0).alias("mask_land"))
    return rounded(climate.masked(index, mask))


def _exceedance(spark, d):
    c = proxy.climate(spark, d).withColumn(
        "temperature", F.when((F.col("ix") != 3) | (F.col("line_key") % 50 != 0), F.col("temperature")))
    return climate.exceedance(c, "temperature", 25.0)


def _decisions(spark, d):
    c = proxy.climate(spark, d)
    suitable = c.groupBy("ix", "iy").agg(
        (F.count(F.when(F.col("temperature") > 25, 1)) / F.count("*")).alias("msi"))
    density = c.groupBy("ix", "iy").agg((F.count(F.when(F.col("rainfall") < 5, 1)) / F.count("*")).alias("rd"))
    return rounded(climate.decisions(suitable, density))


LON0, DLON, NLON, LAT0, DLAT, NLAT = -180.0, 6.0, 60, -60.0, 5.0, 25


def _points(spark, d):
    return proxy.points(spark, d).select("point_id", "lon", "lat")


def _source(spark, d):
    return proxy.pixels(spark, d).select("ix", "iy", "human_presence")


def _regrid(spark, d):
    out = grids.regrid_nearest(_source(spark, d), _points(spark, d), 0.0, DLON, NLON, LAT0, DLAT, NLAT)
    return rounded(out.select("point_id", "human_presence"))


def _regrid_difference(spark, d):
    """The values of a second grid against the regridded ones."""
    out = grids.regrid_nearest(_source(spark, d), _points(spark, d), 0.0, DLON, NLON, LAT0, DLAT, NLAT)
    out = grids.regrid_difference(out, _source(spark, d), "human_presence", LON0, DLON, LAT0, DLAT)
    return rounded(out.select("point_id", "difference"))


def _interpolate(spark, d):
    return rounded(grids.interpolate(_source(spark, d), _points(spark, d), "point_id", "human_presence",
                                     LON0, DLON, LAT0, DLAT))


def _extract(spark, d):
    out = grids.extract_at(_source(spark, d), _points(spark, d), LON0, DLON, LAT0, DLAT)
    return rounded(out.select("point_id", "human_presence"))


def _fill(spark, d):
    hole = ((F.floor(F.col("ix") / 6) + F.floor(F.col("iy") / 5)) % 3 == 0) | (F.col("human_presence") < 0)
    cells = _source(spark, d).select("ix", "iy", F.when(~hole, F.col("human_presence")).alias("value"))
    return rounded(grids.fill_nearest(cells))


QUERIES = {
    "grid_suitability": _suitability,
    "fn_thermal_traits": _traits,
    "grid_weather_index": _weather,
    "fn_weather_parts": _weather_parts,
    "grid_masked_index": _masked,
    "grid_exceedance": _exceedance,
    "grid_decision_index": _decisions,
    "grid_regrid_nearest": _regrid,
    "grid_regrid_difference": _regrid_difference,
    "grid_interpolate": _interpolate,
    "grid_extract_at_points": _extract,
    "grid_fill_nearest": _fill,
}


def _floored(e: str) -> str:
    return f"(CASE WHEN {e} < 0 THEN 0 ELSE {e} END)"


def _trait_sql(species: str, name: str) -> str:
    response, a, b, c = suitability.SPECIES_TRAITS[species][name]
    t = "temperature"
    if response is suitability.briere:
        return _floored(f"({a!r}::DOUBLE * {t} * ({t} - {b!r}::DOUBLE) * sqrt({_floored(f'({c!r}::DOUBLE - {t})')}))")
    if response is suitability.quadratic:
        return _floored(f"(-{a!r}::DOUBLE * ({t} - {b!r}::DOUBLE) * ({t} - {c!r}::DOUBLE))")
    return _floored(f"({a!r}::DOUBLE * {t} * {t} + ({b!r}::DOUBLE) * {t} + {c!r}::DOUBLE)")


_HATCH = """(0.5::DOUBLE * (2.5::DOUBLE * exp(-0.05::DOUBLE * (rainfall - 8) * (rainfall - 8)))
            / (exp(-0.05::DOUBLE * (rainfall - 8) * (rainfall - 8)) + 1.5::DOUBLE)
            + 0.5::DOUBLE * (0.01::DOUBLE / (0.01::DOUBLE + exp(-0.01::DOUBLE * human_density))))"""


def _r0_sql(species: str) -> str:
    tr = {n: _trait_sql(species, n) for n in ("biting", "fecundity", "lifespan", "survival", "egg_development", "egg_mortality")}
    eggs = f"0.5::DOUBLE * {tr['fecundity']} * {tr['biting']}" if species == "albopictus" else tr["fecundity"]
    hatched = f"({_HATCH} * {tr['egg_development']})"
    return (f"round(pow({eggs} * {tr['lifespan']} * {tr['survival']} * ({hatched} / ({hatched} + {tr['egg_mortality']})), "
            f"1.0::DOUBLE / 3), 6)")


_T, _D = "(t2m - 273.15::DOUBLE)", "(d2m - 273.15::DOUBLE)"
_RH = f"(100 * pow(10::DOUBLE, 7.59138::DOUBLE * ({_D} / ({_D} + 240.726::DOUBLE) - {_T} / ({_T} + 240.726::DOUBLE))))"
_MWI = f"""(CASE WHEN sqrt(u10 * u10 + v10 * v10) <= 6 THEN 1 ELSE 0 END
    * CASE WHEN {_RH} >= 40 AND {_RH} <= 95 THEN {_RH} / 55 - 40 / 55 ELSE 0 END
    * CASE WHEN {_T} > 15 AND {_T} <= 20 THEN 0.2::DOUBLE * {_T} - 3 WHEN {_T} > 20 AND {_T} <= 25 THEN 1
           WHEN {_T} > 25 AND {_T} <= 30 THEN -0.2::DOUBLE * {_T} + 6 ELSE 0 END)"""
_CELL_SQL = """SELECT time, ix, iy, max(temperature) AS temperature, max(rainfall) AS rainfall FROM v_climate GROUP BY 1, 2, 3"""


def _near(value: str, origin: float, step: float) -> str:
    return f"ceil(({value} - ({origin})) / {step}::DOUBLE - 0.5::DOUBLE)::BIGINT"


_SIG = "1 / (1 + exp(-({x})))"

ORACLE = {
    "grid_suitability": with_views(f"""
        SELECT time, ix, iy, {_r0_sql('albopictus')} AS r0_albopictus, {_r0_sql('aegypti')} AS r0_aegypti
        FROM c JOIN (SELECT ix, iy, max(human_density) AS human_density FROM v_climate GROUP BY 1, 2) USING (ix, iy)""",
        "v_climate", extra={"c": _CELL_SQL}),
    "fn_thermal_traits": with_views(f"""
        SELECT line_key, line_no, round({_trait_sql('aegypti', 'biting')}, 6) AS briere,
               round({_trait_sql('albopictus', 'survival')}, 6) AS quad, round({_trait_sql('aegypti', 'egg_mortality')}, 6) AS poly,
               round({_trait_sql('albopictus', 'development')}, 6) AS development, round({_HATCH}, 6) AS hatch
        FROM v_climate""", "v_climate"),
    "grid_weather_index": with_views(f"SELECT line_key, line_no, round({_MWI}, 6) AS mwi FROM v_climate", "v_climate"),
    "fn_weather_parts": with_views(f"""
        SELECT line_key, line_no, round(sqrt(u10 * u10 + v10 * v10), 6) AS wind, round({_T}, 6) AS celsius,
               round({_RH}, 6) AS humidity FROM v_climate""", "v_climate"),
    "grid_masked_index": with_views(f"""
        SELECT time, longitude, latitude, CASE WHEN s_suppkey % 3 <> 0 THEN round(mwi, 6) END AS mwi
        FROM (SELECT time, CASE WHEN ix * 36 >= 180 THEN ix * 36 - 360 ELSE ix * 36 END::DOUBLE AS longitude,
                     iy::DOUBLE AS latitude, ix, iy, max({_MWI}) AS mwi FROM v_climate GROUP BY time, ix, iy)
        LEFT JOIN supplier ON s_suppkey = iy * 10 + ix""", "v_climate"),
    "grid_exceedance": with_views("""
        SELECT ix, iy, CASE WHEN count(t) = count(*) THEN sum(CASE WHEN t > 25 THEN 1 ELSE 0 END)::BIGINT END AS n_above
        FROM (SELECT ix, iy, CASE WHEN ix <> 3 OR line_key % 50 <> 0 THEN temperature END AS t FROM v_climate) GROUP BY 1, 2""",
        "v_climate"),
    "grid_decision_index": with_views(f"""
        SELECT ix, iy, round(msi, 6) AS msi, round(rd, 6) AS rd,
               round(s1 * s2 + 0.5::DOUBLE * (1 - s1) * s2, 6) AS p
        FROM (SELECT *, {_SIG.format(x='30 * (msi - 0.5::DOUBLE)')} AS s1, {_SIG.format(x='-30 * (rd - 0.5::DOUBLE)')} AS s2
              FROM (SELECT ix, iy, count(*) FILTER (temperature > 25) / count(*) AS msi,
                           count(*) FILTER (rainfall < 5) / count(*) AS rd FROM v_climate GROUP BY 1, 2))""", "v_climate"),
    "grid_regrid_nearest": with_views(f"""
        SELECT point_id, round(human_presence, 6) AS human_presence FROM (
            SELECT point_id, (({_near('lon', 0.0, DLON)} % {NLON}) + {NLON}) % {NLON} AS ix,
                   least(greatest({_near('lat', LAT0, DLAT)}, 0), {NLAT - 1}) AS iy FROM v_points)
        LEFT JOIN v_pixels USING (ix, iy)""", "v_points", "v_pixels"),
    "grid_regrid_difference": with_views(f"""
        SELECT point_id, round(b.human_presence - a.human_presence, 6) AS difference FROM (
            SELECT point_id, (({_near('lon', 0.0, DLON)} % {NLON}) + {NLON}) % {NLON} AS ix,
                   least(greatest({_near('lat', LAT0, DLAT)}, 0), {NLAT - 1}) AS iy,
                   {_near('lon', LON0, DLON)} AS jx, {_near('lat', LAT0, DLAT)} AS jy FROM v_points) p
        LEFT JOIN v_pixels a ON a.ix = p.ix AND a.iy = p.iy LEFT JOIN v_pixels b ON b.ix = p.jx AND b.iy = p.jy""",
        "v_points", "v_pixels"),
    "grid_extract_at_points": with_views(f"""
        SELECT point_id, round(human_presence, 6) AS human_presence FROM v_points
        LEFT JOIN v_pixels ON ix = {_near('lon', LON0, DLON)} AND iy = {_near('lat', LAT0, DLAT)}""", "v_points", "v_pixels"),
    "grid_interpolate": with_views(f"""
        SELECT point_id, CASE WHEN count(human_presence) = 4 OR min(CASE WHEN w > 0 AND human_presence IS NULL THEN 0 ELSE 1 END) = 1
                              THEN round(sum(w * human_presence), 6) END AS human_presence
        FROM (SELECT point_id, floor(fx)::BIGINT + i AS ix, floor(fy)::BIGINT + j AS iy,
                     (CASE WHEN i = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END)
                     * (CASE WHEN j = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) AS w
              FROM (SELECT point_id, (lon - ({LON0})) / {DLON}::DOUBLE AS fx, (lat - ({LAT0})) / {DLAT}::DOUBLE AS fy FROM v_points),
                   (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(i, j))
        LEFT JOIN v_pixels USING (ix, iy) WHERE w > 0 GROUP BY 1""", "v_points", "v_pixels"),
    "grid_fill_nearest": with_views("""
        SELECT ix, iy, round(value, 6) AS value FROM cells WHERE value IS NOT NULL
        UNION ALL SELECT ix, iy, round(near, 6) FROM (
            SELECT h.ix, h.iy, k.value AS near, row_number() OVER (PARTITION BY h.ix, h.iy ORDER BY
                   (h.ix - k.ix) * (h.ix - k.ix) + (h.iy - k.iy) * (h.iy - k.iy), k.ix, k.iy) AS rn
            FROM cells h JOIN cells k ON h.value IS NULL AND k.value IS NOT NULL) WHERE rn = 1""", "v_pixels",
        extra={"cells": """SELECT ix, iy, CASE WHEN NOT ((ix // 6 + iy // 5) % 3 = 0 OR human_presence < 0)
                                               THEN human_presence END AS value FROM v_pixels"""}),
}
