"""Gridded suitability tables: one row per cell and time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import wrap_longitude
from ..functions.numeric import decision_index
from ..functions.suitability import exceeds, reproduction_number, weather_index

CELL = ("ix", "iy")


def suitability(temperature: DataFrame, rainfall: DataFrame, density: DataFrame,
                species: Sequence[str] = ("albopictus", "aegypti"), time: str = "time") -> DataFrame:
    """R0 per cell and time of each species.

    The grids share cells and times; a density without times holds for all of them.
    """
    grid = temperature.join(rainfall, [time, *CELL])
    grid = grid.join(density, [time, *CELL] if time in density.columns else list(CELL))
    return grid.select(time, *CELL, *[
        reproduction_number(s, F.col("temperature"), F.col("rainfall"), F.col("human_density")).alias(f"r0_{s}")
        for s in species])


def weather(cube: DataFrame) -> DataFrame:
    """Weather index of each row of a cube with wind, temperature and dew point."""
    return cube.withColumn("mwi", weather_index(F.col("u10"), F.col("v10"), F.col("t2m"), F.col("d2m")))


def masked(index: DataFrame, mask: DataFrame, value: str = "mwi") -> DataFrame:
    """Index on land only, null at sea and where the mask says nothing; no row is lost.

    Longitudes of either convention are wrapped to -180…180; cells meet by whole millionths of a degree.
    """
    def cell(frame: DataFrame) -> list[Column]:
        return [F.round(wrap_longitude(frame["longitude"]) * 1e6).cast("long").alias("_x"),
                F.round(frame["latitude"] * 1e6).cast("long").alias("_y")]

    land = mask.select(*cell(mask), F.col("mask_land").cast("boolean").alias("_land")).groupBy("_x", "_y").agg(
        F.max("_land").alias("_land"))
    return index.select("*", *cell(index)).join(land, ["_x", "_y"], "left").withColumn(
        value, F.when(F.col("_land"), F.col(value))).drop("_x", "_y", "_land")


def exceedance(cube: DataFrame, value: str, threshold: float, keys: Sequence[str] = CELL) -> DataFrame:
    """How often a cell exceeds a threshold; null if any of its values is missing."""
    hits = F.sum(exceeds(F.col(value), threshold))
    return cube.groupBy(*keys).agg(F.when(F.count(value) == F.count("*"), hits).alias("n_above"))


def decisions(suitable: DataFrame, density: DataFrame, r: float = 0.5, k: float = 30.0,
              msi: str = "msi", rd: str = "rd") -> DataFrame:
    """Decision index of each cell from its suitability and report density."""
    return suitable.join(density, list(CELL)).withColumn("p", decision_index(F.col(msi), F.col(rd), r, k))
