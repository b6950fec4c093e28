"""Scans and sinks. Formats are Spark's own; only the shapes are ours."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.periods import iso_day

# Tables we know the shape of; anything else is read by its own footer.
CLIMATE_LEGEND_SCHEMA = T.StructType([T.StructField("code", T.IntegerType()), T.StructField("name", T.StringType())])
MUNICIPALITY_SCHEMA = T.StructType([
    T.StructField("provincia", T.StringType()), T.StructField("municipio_v2", T.StringType()),
    T.StructField("comarca", T.StringType()),
])


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Parquet scan of the named columns, all when none is named."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ",") -> DataFrame:
    """CSV scan with a header; types are inferred (one more pass) only without a schema."""
    reader = spark.read.option("header", True).option("sep", sep)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def climate_legend(spark: SparkSession, path: str) -> DataFrame:
    """Climate-region names, under the names the indicators use."""
    return read_csv(spark, path, CLIMATE_LEGEND_SCHEMA, sep=";").select(
        F.col("code").alias("code_climate_regions"), F.col("name").alias("name_climate_regions"))


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """Table bucketed and sorted by a join key: later joins on that key need no shuffle.

    Meant for reports and codes, which every indicator joins on the report key.
    """
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def by_day(df: DataFrame, period: str = "period") -> DataFrame:
    """Periods as `YYYY-MM-DD` text, the other columns as one JSON object each."""
    rest = [c for c in df.columns if c != period]
    return df.select(iso_day(F.col(period)).alias(period),
                     F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("record"))


def write_json_by_day(df: DataFrame, path: str, period: str = "period") -> None:
    """JSON lines `{"YYYY-MM-DD": {column: value, ...}}`, one per period."""
    line = F.concat(F.lit('{"'), F.col(period), F.lit('":'), F.col("record"), F.lit("}"))
    by_day(df, period).select(line.alias("value")).write.mode("overwrite").text(path)


def write_by_parameters(df: DataFrame, path: str, *parameters: str) -> None:
    """One job for a whole set of exports: one folder per parameter combination."""
    write_parquet(df, path, partition_by=parameters)


def entity_extract(reports: DataFrame, codes: DataFrame, legend: DataFrame, entity: str,
                   scale: str = "name_gadm_level0") -> DataFrame:
    """The reports of one entity, whole rows."""
    chosen = codes.join(legend.filter(F.col(scale) == F.lit(entity)).select("code_gadm"), "code_gadm", "left_semi")
    return reports.join(chosen.select("version_uuid"), "version_uuid", "left_semi")


def read_database(spark: SparkSession, options: Mapping[str, str], query: str, partition_column: str | None = None,
                  bounds: tuple[str, str] | None = None, partitions: int = 1) -> DataFrame:
    """Rows of a query pushed whole to a database; partitioned reads when a column and its bounds are known."""
    reader = spark.read.format("jdbc").options(**options)
    if partition_column and bounds:
        return (reader.option("dbtable", f"({query}) AS extract").option("partitionColumn", partition_column)
                .option("lowerBound", bounds[0]).option("upperBound", bounds[1])
                .option("numPartitions", str(partitions)).load())
    return reader.option("query", query).load()
