"""Regular grids: making, masking, counting, resampling and filling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geodesy import cell_index, global_cell, spherical_cell_area
from ..functions.numeric import ratio
from .spatial import _Frame, _layer_edges, containing, flips, nearest, polygon_cells, touched


def make_grid(spark: SparkSession, lat_range: tuple[float, float] = (-90, 90),
              lon_range: tuple[float, float] = (-180.0, 180.0), size: float = 0.25,
              mask: DataFrame | None = None) -> DataFrame:
    """Cells of a grid: `(id_cell, lon, lat, c_lon, c_lat, area)`, corner and centroid in degrees, area in m².

    Cells are numbered column by column from the south-west. With a polygon mask only
    cells whose centroid lies inside, not on the border, are kept; ids do not change.
    """
    n_lat = _steps(lat_range, size)
    cells = spark.range(_steps(lon_range, size) * n_lat).select(
        F.col("id").alias("id_cell"),
        (F.lit(float(lon_range[0])) + F.floor(F.col("id") / n_lat) * size).alias("lon"),
        (F.lit(float(lat_range[0])) + F.col("id") % n_lat * size).alias("lat"))
    grid = cells.select("*", (F.col("lon") + size / 2).alias("c_lon"), (F.col("lat") + size / 2).alias("c_lat"),
                        spherical_cell_area(F.col("lat"), size).alias("area"))
    if mask is None:
        return grid
    inside = containing(grid, mask, "id_cell", border=False, lon="c_lon", lat="c_lat").select("id_cell").distinct()
    return grid.join(inside, "id_cell", "left_semi")


def _steps(bounds: tuple[float, float], size: float) -> int:
    """Number of values from the first bound up to, not including, the second."""
    return max(0, math.ceil((bounds[1] - bounds[0]) / size - 1e-9))


def counted_cells(points: DataFrame, lat_range: tuple[float, float], lon_range: tuple[float, float],
                  size: float) -> DataFrame:
    """Points per grid cell, for cells with any: the cell number is arithmetic, no join is needed."""
    n_lat = _steps(lat_range, size)
    inside = points.filter(
        (F.col("lon") >= lon_range[0]) & (F.col("lon") < lon_range[1])
        & (F.col("lat") >= lat_range[0]) & (F.col("lat") < lat_range[1]))
    ix, iy = cell_index(F.col("lon"), float(lon_range[0]), size), cell_index(F.col("lat"), float(lat_range[0]), size)
    return inside.groupBy((ix * n_lat + iy).alias("id_cell")).agg(F.count("*").alias("point_ct"))


def point_density(grid: DataFrame, counts: DataFrame) -> DataFrame:
    """Points per km² of each cell; null where there are none."""
    return grid.join(counts, "id_cell", "left").withColumn("point_density", F.col("point_ct") / (F.col("area") / 1e6))


def land_mask(polygons: DataFrame, lon_min: float, lat_max: float, width: int, height: int, size: float) -> DataFrame:
    """Every cell `(ix, iy)` of a north-up grid with `mask_land`: 1 where a polygon touches it, else 0.

    Cells are listed by arithmetic per row of each polygon. A cell is touched when its centre is covered or an
    edge crosses it.
    """
    # the same cells as for point lookups, in a frame with y growing downwards
    local = polygons.select("code", F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct(
        ((p["lon"] - lon_min) / size).alias("lon"), ((lat_max - p["lat"]) / size).alias("lat")))).alias("rings"))
    frame = _Frame(0.0, 0.0, 1.0, width, height)
    cells = polygon_cells(_layer_edges({"": local}), frame).filter(F.col("ix").between(0, width - 1) & F.col("iy").between(0, height - 1))
    centre = ("(ix + 0.5D)", "(iy + 0.5D)")
    changes = flips(*centre, frame.left("ix"), frame.bottom("iy")) + F.expr("int(inside)")
    crossed = F.exists("edges", lambda e: _crosses_unit_cell(e, F.col("ix"), F.col("iy")))
    cells = cells.withColumns({"changes": changes, "crossed": touched(*centre) | crossed}).groupBy(
        "layer", "code", "shape", "ix", "iy").agg(F.max("crossed").alias("crossed"), F.sum("changes").alias("changes"))
    hit = F.col("crossed") | (F.col("changes") % 2 == 1)
    land = cells.filter(hit).select("ix", "iy").distinct().withColumn("mask_land", F.lit(1))
    number = F.col("id")
    grid = polygons.sparkSession.range(width * height).select(
        F.pmod(number, F.lit(width)).alias("ix"), F.floor(number / width).alias("iy"))
    return grid.join(land, ["ix", "iy"], "left").fillna(0, ["mask_land"])


def _crosses_unit_cell(e: Column, ix: Column, iy: Column) -> Column:
    """Whether an edge meets the interior of the unit cell: the parts of it within both ranges overlap."""
    def span(a: Column, b: Column, low: Column) -> tuple[Column, Column]:
        d = b - a
        t0, t1 = F.try_divide(low - a, d), F.try_divide(low + 1 - a, d)
        flat_in = (a > low) & (a < low + 1)
        start = F.when(d == 0, F.when(flat_in, 0.0).otherwise(2.0)).otherwise(F.least(t0, t1))
        end = F.when(d == 0, F.when(flat_in, 1.0).otherwise(-1.0)).otherwise(F.greatest(t0, t1))
        return start, end

    sx, ex = span(e["x1"], e["x2"], ix.cast("double"))
    sy, ey = span(e["y1"], e["y2"], iy.cast("double"))
    return F.greatest(sx, sy, F.lit(0.0)) < F.least(ex, ey, F.lit(1.0))


def nearest_index(target: Column, origin: float, spacing: float, count: int, periodic: bool = False) -> Column:
    """Index of the source line closest to a coordinate; the lower one when two are equally close."""
    i = F.ceil((target - origin) / spacing - 0.5).cast("bigint")
    if periodic:
        return F.pmod(i, F.lit(count))
    return F.least(F.greatest(i, F.lit(0)), F.lit(count - 1))


def regrid_nearest(source: DataFrame, target: DataFrame, lon0: float, dlon: float, n_lon: int,
                   lat0: float, dlat: float, n_lat: int) -> DataFrame:
    """Values of the nearest source cell for each target cell `(lon, lat)`; longitudes wrap around.

    `source` is keyed by `(ix, iy)` (and any other columns, e.g. time). A target without a source cell has null values.
    """
    keyed = target.withColumn("ix", nearest_index(F.col("lon"), lon0, dlon, n_lon, periodic=True)).withColumn(
        "iy", nearest_index(F.col("lat"), lat0, dlat, n_lat))
    return keyed.join(source, ["ix", "iy"], "left").drop("ix", "iy")


def regrid_difference(regridded: DataFrame, native: DataFrame, value: str, lon0: float, dlon: float, lat0: float,
                      dlat: float) -> DataFrame:
    """`regridded(lon, lat, value)` plus `difference`: the native grid's value at that place less the regridded one.

    Null where either is missing.
    """
    there = extract_at(native.select("ix", "iy", F.col(value).alias("_native")), regridded, lon0, dlon, lat0, dlat)
    return there.withColumn("difference", F.col("_native") - F.col(value)).drop("_native")


def interpolate(source: DataFrame, points: DataFrame, key: str, value: str, lon0: float, dlon: float,
                lat0: float, dlat: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Bilinear value at each point from its four surrounding cells; null when one that counts is missing.

    `source` holds `(ix, iy, by…, value)`. The small grid is folded first: one row per cell with the values of
    its four corners, so that every point meets one row. A point with no cell at all stays, with null in `by` and value.
    """
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    shifted = source.select("ix", "iy", *by, value, corner.alias("c")).select(
        (F.col("ix") - F.col("c.i")).alias("bx"), (F.col("iy") - F.col("c.j")).alias("by_"), *by, value,
        (2 * F.col("c.i") + F.col("c.j")).alias("c"))
    folded = shifted.groupBy("bx", "by_", *by).agg(
        *[F.max(F.when(F.col("c") == k, F.col(value))).alias(f"v{k}") for k in range(4)])
    fx, fy = (F.col("lon") - lon0) / dlon, (F.col("lat") - lat0) / dlat
    placed = points.select(key, F.floor(fx).alias("bx"), F.floor(fy).alias("by_"), (fx - F.floor(fx)).alias("wx"),
                           (fy - F.floor(fy)).alias("wy"))
    weights = [(F.col("wx") if i else 1 - F.col("wx")) * (F.col("wy") if j else 1 - F.col("wy"))
               for i in (0, 1) for j in (0, 1)]
    # corners without weight need no source cell; null in any other one makes the sum null
    total = sum((F.when(w > 0, w * F.col(f"v{k}")).otherwise(F.lit(0.0)) for k, w in enumerate(weights)), F.lit(0.0))
    return placed.join(folded, ["bx", "by_"], "left").select(key, *by, total.alias(value))


def extract_at(source: DataFrame, points: DataFrame, lon0: float, dlon: float, lat0: float, dlat: float) -> DataFrame:
    """Values of the cell whose centre is nearest to each point; points off the grid have none."""
    i, j = F.ceil((F.col("lon") - lon0) / dlon - 0.5).cast("bigint"), F.ceil((F.col("lat") - lat0) / dlat - 0.5).cast("bigint")
    keyed = points.withColumn("ix", i).withColumn("iy", j)
    return keyed.join(source, ["ix", "iy"], "left").drop("ix", "iy")


def global_cells(points: DataFrame, resolution: int) -> DataFrame:
    """Points with the number of their discrete global cell."""
    return points.withColumn("cell", global_cell(F.col("lon"), F.col("lat"), resolution))


def distinct_cell_ratio(points: DataFrame, resolution: int) -> DataFrame:
    """Distinct global cells per point."""
    return global_cells(points, resolution).agg(ratio(F.count_distinct("cell"), F.count("*")).alias("cell_ratio"))


def fill_nearest(cells: DataFrame, value: str = "value") -> DataFrame:
    """Missing values of a grid `(ix, iy, value)` replaced by the nearest known one.

    The nearest known cell always has an unknown or absent neighbour: one step from it
    toward the hole leads closer. Only such rim cells are searched. Ties go to the
    smaller (ix, iy).
    """
    known = cells.filter(F.col(value).isNotNull())
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                      for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)])
    touching = known.select((F.col("ix")).alias("x"), (F.col("iy")).alias("y"), F.explode(steps).alias("s")).select(
        (F.col("x") + F.col("s.i")).alias("ix"), (F.col("y") + F.col("s.j")).alias("iy"))
    inner = touching.groupBy("ix", "iy").agg(F.count("*").alias("n")).filter("n = 8").select("ix", "iy")
    rim = known.join(inner, ["ix", "iy"], "left_anti")
    x, y = F.col("ix").cast("double"), F.col("iy").cast("double")
    shapes = rim.select(F.struct("ix", "iy", value).alias("code"), x.alias("x1"), y.alias("y1"), x.alias("x2"), y.alias("y2"))
    holes = cells.filter(F.col(value).isNull()).select(
        F.struct("ix", "iy").alias("cell"), x.alias("lon"), y.alias("lat"))
    found = nearest(holes, shapes, "cell")
    filled = found.select(F.col("cell.ix").alias("ix"), F.col("cell.iy").alias("iy"), F.col(f"code.{value}").alias("_near"))
    return cells.join(filled, ["ix", "iy"], "left").withColumn(value, F.coalesce(value, "_near")).drop("_near")
