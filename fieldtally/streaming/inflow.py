"""Inflow of reports from an append-only stream: tumbling counts by day, kept up to date in a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.classify import REPORT_TYPES
from ..functions.periods import period_start
from ..operators.timeseries import regular

# How much later than the newest upload a report may arrive and still be counted.
LATENESS = "30 days"


def report_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Reports from Parquet files that are added to a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def daily_counts(reports: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Reports per upload day and type: day, report_type, n.

    The watermark follows `upload_date_utc`: days that lie further back than `lateness` leave the state store, and reports
    for them are dropped (Spark counts them in `numRowsDroppedByWatermark`). Reports without a date are left out.
    """
    dated = reports.select(F.col("upload_date_utc").cast("timestamp").alias("at"), "report_type").filter("at is not null")
    counts = dated.withWatermark("at", lateness).groupBy(F.window("at", "1 day").alias("day"), "report_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("day.start").alias("day"), "report_type", "n")


def keep_counts(counts: DataFrame, path: str, checkpoint: str, **trigger: bool | str) -> StreamingQuery:
    """Write every changed count under its batch; a batch that runs again replaces what it wrote before."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(
        **(trigger or {"availableNow": True})).start()


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """The newest count of each day and type."""
    return spark.read.parquet(path).groupBy("day", "report_type").agg(F.max_by("n", "batch").alias("n"))


def inflow(counts: DataFrame, freq: str = "month", types: Sequence[str] = tuple(REPORT_TYPES)) -> DataFrame:
    """Reports per upload period, one column per type, from daily counts; equals the batch indicator over the same reports."""
    dated = counts.select(period_start(F.col("day"), freq).alias("period"), "report_type", "n")
    wide = dated.groupBy("period").pivot("report_type", list(types)).agg(F.sum("n"))
    return regular(wide, freq, fill=0)
