"""Row filters shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOTAL = "Total"
MISSING_NAME = "NULL"


def only_type(reports: DataFrame, report_type: str | None) -> DataFrame:
    """Keep one report type; None or '' keeps all."""
    return reports if not report_type else reports.filter(F.col("report_type") == report_type)


def only_entity(df: DataFrame, scale: str, entity: str) -> DataFrame:
    """Keep the rows of one entity of a spatial scale; 'Total' keeps all. Values are never spliced into text."""
    return df if entity == TOTAL else df.filter(F.col(scale) == F.lit(entity))


def named(df: DataFrame, scale: str) -> DataFrame:
    """Drop rows whose name is missing, as null or as the literal marker."""
    return df.filter(F.col(scale) != MISSING_NAME)


def geolocated(df: DataFrame) -> DataFrame:
    return df.filter(F.col("lat").isNotNull())


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """Drop rows with a missing value in any of the columns (all columns when none is named)."""
    return df.na.drop(subset=list(columns) or None)


def differs(column: Column, value: Column) -> Column:
    """Null-safe inequality."""
    return ~column.eqNullSafe(value)


def from_known_app(package: Column, version: Column, created: Column, record_version: Column,
                   app: str, min_version: int, since: str) -> Column:
    """Reports of the app's later versions, or of any other package since a day; deleted records left out."""
    own = (package == app) & (version > min_version)
    other = (package != app) & (created >= F.lit(since).cast("timestamp_ntz"))
    return (own | other) & (record_version != -1)


def identified_adults(reports: DataFrame) -> DataFrame:
    """Adult reports whose label is known: not unsure, not unvalidated, not missing."""
    return reports.filter(
        (F.col("report_type") == "adult") & (F.col("labels") != "not-sure") & (F.col("labels") != "unvalidated")
    )


def during(df: DataFrame, period: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Periods from `start` to `end`, both included."""
    if start is not None:
        df = df.filter(F.col(period) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col(period) <= F.lit(end).cast("timestamp_ntz"))
    return df


def at_least(df: DataFrame, column: str, minimum: float) -> DataFrame:
    return df.filter(F.col(column) >= minimum)


def name_like(df: DataFrame, column: str, fragment: str) -> DataFrame:
    """Names holding a fragment, upper and lower case alike; the fragment is taken literally."""
    return df.filter(F.contains(F.lower(F.col(column)), F.lit(fragment.lower())))


def in_box(df: DataFrame, lon_min: float, lon_max: float, lat_min: float, lat_max: float,
           lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.filter(F.col(lon).between(lon_min, lon_max) & F.col(lat).between(lat_min, lat_max))
