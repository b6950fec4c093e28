"""Polygon layers as tables: one row per polygon, rings as arrays of coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
RINGS = T.ArrayType(T.ArrayType(POINT))
LAYER_SCHEMA = T.StructType([
    T.StructField("code", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("level", T.IntegerType()), T.StructField("level_name", T.StringType()),
    T.StructField("rings", RINGS),
])

# Attributes of each layer and the names they get.
LAYER_COLUMNS = {
    "gadm": {"UID": "code"},
    "climate_regions": {"DN": "code"},
    "ecoregions": {"ECO_ID": "code", "ECO_NAME": "name", "BIOME": "level", "biomes_lab": "level_name"},
}


def missing_geometries(layer: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Number of rows a load would drop for want of a geometry."""
    return layer.agg(F.count(F.when(F.col(geometry).isNull(), 1)).alias("n_missing"))


def polygon_layer(raw: DataFrame, layer: str, legend: DataFrame | None = None, geometry: str = "geometry") -> DataFrame:
    """A raw layer under the common schema.

    Rows without geometry are dropped (see :func:`missing_geometries`), empty texts
    of the administrative layer become null, climate regions get their names from the legend, and every column
    gets the type `LAYER_SCHEMA` declares.
    """
    renames = LAYER_COLUMNS[layer]
    out = raw.filter(F.col(geometry).isNotNull()).select(
        *[F.col(a).alias(b) for a, b in renames.items()], F.col(geometry).alias("rings"))
    if layer == "climate_regions":
        if legend is None:
            raise ValueError("climate regions need their legend")
        out = out.join(legend.select("code", "name"), "code", "left")
    texts = [f.name for f in out.schema.fields if isinstance(f.dataType, T.StringType) and layer == "gadm"]
    out = out.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in texts})
    return out.select(*[
        F.col(f.name).cast(f.dataType).alias(f.name) for f in LAYER_SCHEMA.fields if f.name in out.columns])


def read_geojson(spark: SparkSession, path: str, properties: T.StructType) -> DataFrame:
    """Polygons and multipolygons of GeoJSON text, one feature per line, with the named properties.

    All rings of a multipolygon go into one list: the even-odd rule needs no grouping.
    """
    position = T.ArrayType(T.DoubleType())
    flat = T.ArrayType(T.ArrayType(position))

    def parsed(shape: T.DataType):
        geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", shape)])
        return F.from_json("value", T.StructType([
            T.StructField("properties", properties), T.StructField("geometry", geometry)]))

    rows = spark.read.text(path).select(parsed(flat).alias("one"), parsed(T.ArrayType(flat)).alias("many"))
    rings = F.when(F.col("one.geometry.type") == "Polygon", F.col("one.geometry.coordinates")).when(
        F.col("one.geometry.type") == "MultiPolygon", F.flatten(F.col("many.geometry.coordinates")))
    as_points = F.transform(rings, lambda ring: F.transform(
        ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    names = [f.name for f in properties.fields]
    return rows.select(*[F.coalesce(F.col(f"one.properties.{n}"), F.col(f"many.properties.{n}")).alias(n) for n in names],
                       as_points.alias("geometry"))
