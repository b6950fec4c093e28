"""Spatial joins and grids over the stand-in points and polygons, each with its SQL twin."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geodesy
from ..operators import filters, grids, spatial
from ..plans import etl
from ..sources import layers, proxy
from ..sources.proxy import with_views
from .kpi_queries import GRID_SIZE, GRID_X0, GRID_Y0, rounded

# SQL fragments: a ray to the right crosses an edge; a point lies on an edge.
_SIDE = "((x2 - x1) * (py - y1) - (px - x1) * (y2 - y1))"
_CROSS = f"(((y1 <= py AND y2 > py) AND {_SIDE} > 0) OR ((y2 <= py AND y1 > py) AND {_SIDE} < 0))"
_TOUCH = f"({_SIDE} = 0 AND px BETWEEN least(x1, x2) AND greatest(x1, x2) AND py BETWEEN least(y1, y2) AND greatest(y1, y2))"
_T = """least(greatest(coalesce(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1))
        / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0), 0), 1)"""
_DIST = f"""sqrt((px - (x1 + {_T} * (x2 - x1))) * (px - (x1 + {_T} * (x2 - x1)))
          + (py - (y1 + {_T} * (y2 - y1))) * (py - (y1 + {_T} * (y2 - y1))))"""


def inside_cte(points: str = "SELECT point_id AS id, lon AS px, lat AS py FROM v_points") -> str:
    return f"""SELECT id, code FROM ({points}) p JOIN v_edges ON TRUE GROUP BY id, code
               HAVING count(*) FILTER ({_CROSS}) % 2 = 1 OR bool_or({_TOUCH})"""


def nearest_cte(points: str, limit: str = "") -> str:
    return f"""SELECT id, code, d FROM (
                 SELECT id, code, round({_DIST}, 9) AS d,
                        row_number() OVER (PARTITION BY id ORDER BY round({_DIST}, 9), code) AS rn
                 FROM ({points}) p JOIN v_edges ON TRUE) WHERE rn = 1 {limit}"""


_POINTS = "SELECT point_id AS id, lon AS px, lat AS py FROM v_points"
_OUTSIDE = f"{_POINTS} WHERE point_id NOT IN (SELECT id FROM inside)"
_CODED = "SELECT id, min(code) AS code FROM inside GROUP BY id"


def _containing(spark, d):
    return spatial.containing(proxy.points(spark, d), proxy.polygons(spark, d), "point_id")


def _nearest(limit):
    def run(spark, d):
        edges = spatial.edge_rows(proxy.polygons(spark, d))
        near = spatial.nearest(proxy.points(spark, d), edges, "point_id", limit)
        return rounded(near)
    return run


def _nearest_beyond(spark, d):
    """Points and edges far beyond the range of degrees."""
    edges = spatial.edge_rows(proxy.polygons(spark, d)).withColumns({"x1": F.col("x1") - 150, "x2": F.col("x2") - 150})
    points = proxy.points(spark, d).select("point_id", (F.col("lon") * 2).alias("lon"), (F.col("lat") * 2).alias("lat"))
    return rounded(spatial.nearest(points, edges, "point_id"))


def _assign(limit, attributes=()):
    def run(spark, d):
        return spatial.assign_areas(proxy.points(spark, d), proxy.polygons(spark, d), "point_id", limit,
                                    attributes=attributes)
    return run


def _report_codes(spark, d):
    eco = proxy.polygons(spark, d, 5).withColumn("level_name", F.concat(F.lit("level "), F.col("level").cast("string")))
    return etl.report_codes(proxy.points(spark, d), proxy.polygons(spark, d), proxy.polygons(spark, d, 3), eco, key="point_id")


def _sample(spark, d):
    effort = etl.extract_sampling_effort(proxy.fixes(spark, d)).select("lonlat_id", "lon", "lat").distinct()
    out = spatial.sample_pixels(effort, proxy.pixels(spark, d), GRID_X0, GRID_Y0, GRID_SIZE,
                                F.col("lon").cast("double"), F.col("lat").cast("double"))
    return rounded(out.select("lonlat_id", "human_presence", "code_gadm"))


def _utm(spark, d):
    p = proxy.points(spark, d)
    placed = geodesy.with_utm(p, geodesy.utm_zone(F.col("lon")), F.col("lat") < 0)
    return placed.select("point_id", geodesy.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"),
                         F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def _valid(spark, d):
    p = proxy.points(spark, d).withColumn("lon", F.when(F.col("point_id") % 9 == 0, F.col("lon") * 3).otherwise(F.col("lon")))
    ok = geodesy.valid_point(F.col("lon"), F.col("lat"))
    return p.groupBy("user_id").agg(F.count(F.when(ok, 1)).alias("n_points"), F.count(F.when(~ok, 1)).alias("n_invalid"))


LAT, LON, CELL = (-60.0, 60.0), (-180.0, 180.0), 0.5
MASK_W, MASK_H, MASK_SIZE = 360, 120, 1.0


def _grid(spark, d):
    g = grids.make_grid(spark, LAT, LON, CELL, proxy.polygons(spark, d))
    return rounded(g, 3)


def _counted(spark, d):
    return grids.counted_cells(proxy.points(spark, d), LAT, LON, CELL)


def _density(spark, d):
    g = grids.make_grid(spark, LAT, LON, CELL, proxy.polygons(spark, d))
    out = grids.point_density(g, grids.counted_cells(proxy.points(spark, d), LAT, LON, CELL))
    return rounded(out.select("id_cell", "point_ct", "point_density"))


def _land(spark, d):
    return grids.land_mask(proxy.polygons(spark, d), -180.25, 60.25, MASK_W, MASK_H, MASK_SIZE)


def _boxed(spark, d):
    return filters.in_box(proxy.points(spark, d), -10, 50, -30, 45).select("point_id")


def _wrap(spark, d):
    return rounded(proxy.points(spark, d).select(
        "point_id", geodesy.wrap_longitude(F.col("lon") * 2 + 360).alias("lon")))


def _cell_ratio(spark, d):
    return rounded(grids.distinct_cell_ratio(proxy.points(spark, d), 10))


def _cells(spark, d):
    return grids.global_cells(proxy.points(spark, d), 8).select("point_id", "cell")


def _fine_cells(spark, d):
    return grids.global_cells(proxy.points(spark, d), 20).select("point_id", "cell")


def _layer(spark, d):
    """A raw layer with missing geometries and empty names, through the layer loader."""
    raw = proxy.polygons(spark, d).select(
        F.col("code").cast("int").alias("DN"), F.when(F.col("code").cast("int") % 7 != 0, F.col("rings")).alias("geometry"))
    legend = proxy.table(spark, d, "supplier").select(
        F.when(F.col("s_suppkey") % 5 == 0, -1 - F.col("s_suppkey")).otherwise(F.col("s_suppkey")).cast("int").alias("code"),
        F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("name"))
    layer = layers.polygon_layer(raw, "climate_regions", legend)
    return layer.select("code", "name", F.size("rings").alias("n_rings"))


def _dropped(spark, d):
    raw = proxy.polygons(spark, d).select(
        "code", F.when(F.col("code").cast("int") % 7 != 0, F.col("rings")).alias("geometry"))
    return layers.missing_geometries(raw)


QUERIES = {
    "join_point_in_polygon": _containing,
    "join_nearest_polygon": _nearest(None),
    "join_nearest_polygon_beyond": _nearest_beyond,
    "join_nearest_polygon_within": _nearest(4.0),
    "join_area_of_point": _assign(None, ("name",)),
    "join_area_of_point_inside_only": _assign(0),
    "etl_report_codes": _report_codes,
    "join_pixel_sample": _sample,
    "fn_utm": _utm,
    "filter_valid_points": _valid,
    "filter_bounding_box": _boxed,
    "fn_wrap_longitude": _wrap,
    "grid_make_masked": _grid,
    "grid_counted_cells": _counted,
    "grid_point_density": _density,
    "grid_land_mask": _land,
    "grid_global_cells": _cells,
    "grid_global_cells_fine": _fine_cells,
    "grid_distinct_cell_ratio": _cell_ratio,
    "src_polygon_layer": _layer,
    "src_layer_missing_geometries": _dropped,
}

K = geodesy.krueger_constants()


def utm_sql(source: str, keep: str, zone: str, south: str) -> str:
    """`source` has lon, lat; `zone` and `south` are expressions over it; adds x and y in metres."""
    atanh = "0.5 * ln((1 + ({v})) / (1 - ({v})))"
    east = " + ".join(f"{K[f'a{j}']!r} * cos({2 * j} * xi) * ((exp({2 * j} * eta) - exp(-{2 * j} * eta)) / 2)" for j in (1, 2, 3))
    north = " + ".join(f"{K[f'a{j}']!r} * sin({2 * j} * xi) * ((exp({2 * j} * eta) + exp(-{2 * j} * eta)) / 2)" for j in (1, 2, 3))
    scale = geodesy.UTM_SCALE * K["A"]
    return f"""
      SELECT {keep}, 500000.0::DOUBLE + {scale!r}::DOUBLE * (eta + {east}) AS x,
             {scale!r}::DOUBLE * (xi + {north}) + CASE WHEN south THEN 10000000.0::DOUBLE ELSE 0 END AS y
      FROM (SELECT *, atan2(t, cos(lam)) AS xi, {atanh.format(v='sin(lam) / sqrt(1 + t * t)')} AS eta
            FROM (SELECT *, (exp(q) - exp(-q)) / 2 AS t FROM (
                    SELECT *, {atanh.format(v='sin(radians(lat))')}
                              - {K['e']!r} * ({atanh.format(v=f"{K['e']!r} * sin(radians(lat))")}) AS q,
                           radians(lon - (zone * 6 - 183)) AS lam
                    FROM (SELECT *, {zone} AS zone, {south} AS south FROM {source}))))"""


ZONE = "((floor((lon + 180) / 6) % 60) + 1)::INTEGER"

_AREA = repr(geodesy.SPHERE_RADIUS ** 2 * math.radians(CELL))
_GRID_SQL = f"""
    SELECT i * 240 + j AS id_cell, -180 + i * 0.5::DOUBLE AS lon, -60 + j * 0.5::DOUBLE AS lat,
           -180 + i * 0.5::DOUBLE + 0.25::DOUBLE AS c_lon, -60 + j * 0.5::DOUBLE + 0.25::DOUBLE AS c_lat,
           {_AREA}::DOUBLE * (sin(radians(-60 + j * 0.5::DOUBLE + 0.5::DOUBLE)) - sin(radians(-60 + j * 0.5::DOUBLE))) AS area
    FROM range(720) a(i), range(240) b(j)"""
_GRID_CTES = {
    "g": _GRID_SQL,
    # crossings of each row of centres, then an equi join on the row; a centre on an edge is not within
    "hits": """SELECT code, j, x1 + (-60 + j * 0.5::DOUBLE + 0.25::DOUBLE - y1) * (x2 - x1) / (y2 - y1) AS x
               FROM (SELECT *, unnest(range(floor((least(y1, y2) + 60) / 0.5::DOUBLE)::BIGINT - 1,
                                            ceil((greatest(y1, y2) + 60) / 0.5::DOUBLE)::BIGINT + 1)) AS j FROM v_edges)
               WHERE (y1 <= -60 + j * 0.5::DOUBLE + 0.25::DOUBLE) <> (y2 <= -60 + j * 0.5::DOUBLE + 0.25::DOUBLE)""",
    "kept": """SELECT DISTINCT id_cell FROM (
                 SELECT id_cell, code FROM g JOIN hits ON id_cell % 240 = j GROUP BY id_cell, code
                 HAVING count(*) FILTER (x > c_lon) % 2 = 1 AND NOT bool_or(x = c_lon))""",
    "cts": """SELECT floor((lon + 180) / 0.5::DOUBLE)::BIGINT * 240 + floor((lat + 60) / 0.5::DOUBLE)::BIGINT AS id_cell,
                     count(*) AS point_ct FROM v_points
              WHERE lon >= -180 AND lon < 180 AND lat >= -60 AND lat < 60 GROUP BY 1""",
}
# interval of an edge's parameter within a unit range, by axis
_UNIT = {
    a: (f"CASE WHEN {a}2 = {a}1 THEN CASE WHEN {a}1 > i{a} AND {a}1 < i{a} + 1 THEN 0 ELSE 2 END "
        f"ELSE least((i{a} - {a}1) / ({a}2 - {a}1), (i{a} + 1 - {a}1) / ({a}2 - {a}1)) END",
        f"CASE WHEN {a}2 = {a}1 THEN CASE WHEN {a}1 > i{a} AND {a}1 < i{a} + 1 THEN 1 ELSE -1 END "
        f"ELSE greatest((i{a} - {a}1) / ({a}2 - {a}1), (i{a} + 1 - {a}1) / ({a}2 - {a}1)) END") for a in "xy"}
_BITS = " + ".join(f"((xi >> {i}) & 1) * {4 ** i} + ((yi >> {i}) & 1) * {2 * 4 ** i}" for i in range(31))


def _cells_sql(bits: int) -> str:
    n = 2 ** bits
    return f"""SELECT point_id, {_BITS} AS cell FROM (
        SELECT point_id, least(floor((((lon + 180) - 360 * floor((lon + 180) / 360)) - 180 + 180) / 360 * {n}), {n - 1})::BIGINT AS xi,
               least(floor((lat + 90) / 180 * {n}), {n - 1})::BIGINT AS yi FROM v_points)"""


ORACLE = {
    "join_point_in_polygon": with_views("SELECT id AS point_id, code FROM inside", "v_points", "v_edges",
                                        extra={"inside": inside_cte()}),
    "join_nearest_polygon": with_views("SELECT id AS point_id, code, round(d, 6) AS distance FROM near", "v_points",
                                       "v_edges", extra={"near": nearest_cte(_POINTS)}),
    "join_nearest_polygon_beyond": with_views(
        "SELECT id AS point_id, code, round(d, 6) AS distance FROM near", "v_points", "v_edges", extra={
            "moved": "SELECT * REPLACE (x1 - 150 AS x1, x2 - 150 AS x2) FROM v_edges",
            "near": nearest_cte("SELECT point_id AS id, lon * 2 AS px, lat * 2 AS py FROM v_points").replace(
                "v_edges", "moved")}),
    "join_nearest_polygon_within": with_views(
        "SELECT id AS point_id, code, round(d, 6) AS distance FROM near", "v_points", "v_edges",
        extra={"near": nearest_cte(_POINTS, "AND d <= 4.0")}),
    "join_area_of_point": with_views("""
        SELECT id AS point_id, code, 'area ' || code AS name FROM (SELECT * FROM coded UNION ALL SELECT id, code FROM near)""",
        "v_points", "v_edges", extra={"inside": inside_cte(), "coded": _CODED, "near": nearest_cte(_OUTSIDE)}),
    "join_area_of_point_inside_only": with_views(
        "SELECT point_id, code FROM v_points LEFT JOIN coded ON point_id = id", "v_points", "v_edges",
        extra={"inside": inside_cte(), "coded": _CODED}),
    "etl_report_codes": with_views(f"""
        SELECT point_id, code_gadm, code_climate_regions, 'area ' || code_climate_regions AS name_climate_regions,
               code_ecoregions, 'area ' || code_ecoregions AS name_ecoregions, s_nationkey AS code_biome,
               'level ' || s_nationkey AS name_biome
        FROM v_points JOIN a ON a.id = point_id JOIN b ON b.id = point_id JOIN c ON c.id = point_id
        JOIN supplier ON s_suppkey = code_ecoregions::BIGINT""", "v_points", "v_edges", extra={
            "edges3": "SELECT * REPLACE (y1 + 3 AS y1, y2 + 3 AS y2) FROM v_edges",
            "edges5": "SELECT * REPLACE (y1 + 5 AS y1, y2 + 5 AS y2) FROM v_edges",
            **{n: f"""SELECT id, code AS {name} FROM (
                        SELECT id, code, round(min({_DIST}), 9) AS d,
                               count(*) FILTER ({_CROSS}) % 2 = 1 OR bool_or({_TOUCH}) AS covered
                        FROM ({_POINTS}) p JOIN {edges} ON TRUE GROUP BY 1, 2)
                      QUALIFY row_number() OVER (
                        PARTITION BY id ORDER BY covered DESC, CASE WHEN covered THEN 0 ELSE d END, code) = 1"""
               for n, name, edges in (("a", "code_gadm", "v_edges"), ("b", "code_climate_regions", "edges3"),
                                      ("c", "code_ecoregions", "edges5"))}}),
    "join_pixel_sample": with_views(f"""
        SELECT lonlat_id, round(human_presence, 6) AS human_presence, code_gadm
        FROM (SELECT DISTINCT lon || '_' || lat AS lonlat_id, lon, lat FROM (
                SELECT round(masked_lon::DECIMAL(18, 9), 3)::DECIMAL(18, 3)::VARCHAR AS lon,
                       round(masked_lat::DECIMAL(18, 9), 3)::DECIMAL(18, 3)::VARCHAR AS lat FROM v_fixes)) r
        JOIN v_pixels v ON v.ix = floor((r.lon::DOUBLE - ({GRID_X0}::DOUBLE)) / {GRID_SIZE}::DOUBLE)
                       AND v.iy = floor(({GRID_Y0}::DOUBLE - r.lat::DOUBLE) / {GRID_SIZE}::DOUBLE)""",
        "v_fixes", "v_pixels"),
    "fn_utm": with_views(
        "SELECT point_id, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + zone AS epsg, round(x, 3) AS x, round(y, 3) AS y FROM u",
        "v_points", extra={"u": utm_sql("v_points", "point_id, lat, zone", ZONE, "lat < 0")}),
    "filter_valid_points": with_views("""
        SELECT user_id, count(*) FILTER (ok) AS n_points, count(*) FILTER (NOT ok) AS n_invalid FROM (
            SELECT user_id, CASE WHEN point_id % 9 = 0 THEN lon * 3 ELSE lon END BETWEEN -180 AND 180
                            AND lat BETWEEN -90 AND 90 AS ok FROM v_points) GROUP BY 1""", "v_points"),
    "filter_bounding_box": with_views(
        "SELECT point_id FROM v_points WHERE lon BETWEEN -10 AND 50 AND lat BETWEEN -30 AND 45", "v_points"),
    "fn_wrap_longitude": with_views("""
        SELECT point_id, round((lon * 2 + 360 + 180) - 360 * floor((lon * 2 + 360 + 180) / 360) - 180, 6) AS lon
        FROM v_points""", "v_points"),
    "grid_make_masked": with_views("""
        SELECT id_cell, round(lon, 3) AS lon, round(lat, 3) AS lat, round(c_lon, 3) AS c_lon, round(c_lat, 3) AS c_lat,
               round(area, 3) AS area FROM g JOIN kept USING (id_cell)""", "v_edges",
        extra={k: _GRID_CTES[k] for k in ("g", "hits", "kept")}),
    "grid_counted_cells": with_views("SELECT * FROM cts", "v_points", extra={"cts": _GRID_CTES["cts"]}),
    "grid_point_density": with_views("""
        SELECT id_cell, point_ct, round(point_ct / (area / 1e6), 6) AS point_density
        FROM g JOIN kept USING (id_cell) LEFT JOIN cts USING (id_cell)""", "v_points", "v_edges", extra=_GRID_CTES),
    "grid_land_mask": with_views(f"""
        SELECT a.ix, b.iy, (t.ix IS NOT NULL)::INT AS mask_land FROM range({MASK_W}) a(ix) CROSS JOIN range({MASK_H}) b(iy)
        LEFT JOIN (SELECT DISTINCT ix, iy FROM (
            SELECT ix, iy, code, ix + 0.5::DOUBLE AS px, iy + 0.5::DOUBLE AS py, x1, y1, x2, y2
            FROM range({MASK_W}) a(ix), range({MASK_H}) b(iy), e
            WHERE ix BETWEEN xa - 1 AND xb + 1 AND iy BETWEEN ya - 1 AND yb + 1)
        GROUP BY ix, iy, code
        HAVING count(*) FILTER ({_CROSS}) % 2 = 1 OR bool_or({_TOUCH})
            OR bool_or(greatest({_UNIT['x'][0]}, {_UNIT['y'][0]}, 0) < least({_UNIT['x'][1]}, {_UNIT['y'][1]}, 1))) t
          ON t.ix = a.ix AND t.iy = b.iy""",
        "v_edges", extra={"e": """
            SELECT *, min(least(x1, x2)) OVER w AS xa, max(greatest(x1, x2)) OVER w AS xb,
                   min(least(y1, y2)) OVER w AS ya, max(greatest(y1, y2)) OVER w AS yb
            FROM (SELECT code, x1 + 180.25::DOUBLE AS x1, 60.25::DOUBLE - y1 AS y1, x2 + 180.25::DOUBLE AS x2,
                         60.25::DOUBLE - y2 AS y2 FROM v_edges) WINDOW w AS (PARTITION BY code)"""}),
    "grid_global_cells": with_views(_cells_sql(8), "v_points"),
    "grid_global_cells_fine": with_views(_cells_sql(20), "v_points"),
    "grid_distinct_cell_ratio": with_views(
        f"SELECT round(count(DISTINCT cell)::DOUBLE / count(*), 6) AS cell_ratio FROM ({_cells_sql(10)})", "v_points"),
    "src_polygon_layer": with_views("""
        SELECT c.s_suppkey::VARCHAR AS code, CASE WHEN l.s_suppkey % 3 <> 0 THEN s_name WHEN l.s_suppkey % 3 = 0 THEN '' END AS name,
               CASE WHEN kind = 2 THEN 2 ELSE 1 END AS n_rings
        FROM v_corner c LEFT JOIN (SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 5 <> 0) l USING (s_suppkey)
        WHERE c.s_suppkey % 7 <> 0""", "v_corner"),
    "src_layer_missing_geometries": "SELECT count(*) AS n_missing FROM supplier WHERE s_suppkey % 7 = 0",
}
