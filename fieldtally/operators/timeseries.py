"""Regular time axes over already aggregated periods, and windows along them.

All windows here run over one row per period (thousands at most), never over raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import step


def regular(df: DataFrame, freq: str, period: str = "period", by: Sequence[str] = (),
            fill: object = None, only: Sequence[str] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Add a row for every missing period between the first and the last one.

    Each row is repeated over the gap up to the next one, so the axis needs neither a
    second pass for its bounds nor a join. Columns of added rows get `fill` (those in
    `only`, default all), or the previous row's value (`carry`). Cells that were null
    in an existing period stay null. Rows without a period are dropped.
    """
    gap = step(freq)
    axis = Window.partitionBy(*by).orderBy(period)
    filled = (
        df.filter(F.col(period).isNotNull())
        .withColumn("_last", F.coalesce(F.lead(period).over(axis) - gap, F.col(period)))
        .withColumn("_day", F.explode(F.sequence(F.col(period).cast("date"), F.col("_last").cast("date"), gap)))
    )
    added = F.col("_day") != F.col(period).cast("date")
    out: list[Column] = []
    for c in df.columns:
        if c == period:
            out.append(F.col("_day").cast("timestamp_ntz").alias(period))
        elif c in by or c in carry:
            out.append(F.col(c))
        else:
            value = fill if only is None or c in only else None
            out.append(F.when(added, F.lit(value).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c))
    return filled.select(*out)


def spine(df: DataFrame, freq: str, column: str = "period", other: DataFrame | None = None) -> DataFrame:
    """Every period from the smallest to the largest one of `df` (and `other`), from a one-row aggregate."""
    bounds = df.select(column) if other is None else df.select(column).unionByName(other.select(column))
    edges = bounds.agg(F.min(column).cast("date").alias("a"), F.max(column).cast("date").alias("b"))
    days = edges.filter(F.col("a").isNotNull()).select(F.explode(F.sequence("a", "b", step(freq))).alias("d"))
    return days.select(F.col("d").cast("timestamp_ntz").alias(column))


def running_total(value: Column, period: str = "period", by: Sequence[str] = ()) -> Column:
    return F.sum(value).over(
        Window.partitionBy(*by).orderBy(F.asc_nulls_last(period)).rowsBetween(Window.unboundedPreceding, 0)
    )


def last_known(value: Column, period: str = "period", by: Sequence[str] = ()) -> Column:
    """Forward fill."""
    return F.last(value, ignorenulls=True).over(
        Window.partitionBy(*by).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    )


def of_all(aggregate: Column, by: Sequence[str] = ()) -> Column:
    """An aggregate over every (aggregated) row, to be used next to single rows."""
    return aggregate.over(Window.partitionBy(*by))


def after_first(df: DataFrame, period: str = "period", by: Sequence[str] = ()) -> DataFrame:
    """Drop the earliest period (of each group)."""
    first = F.min(period).over(Window.partitionBy(*by))
    return df.withColumn("_first", first).filter(F.col(period) > F.col("_first")).drop("_first")
