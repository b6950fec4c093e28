import pytest
from pyspark.sql import functions as F

from fieldtally.plans import kpis
from fieldtally.sources import proxy
from fieldtally.streaming import inflow

D = "/root/testdata/sf0.001"
SCHEMA = "version_uuid long, upload_date_utc timestamp, report_type string"


@pytest.fixture(scope="module")
def reports(spark):
    rows = proxy.reports(spark, D, False).select(F.col("version_uuid").cast("long").alias("version_uuid"), F.col(
        "upload_date_utc").cast("timestamp").alias("upload_date_utc"), "report_type").orderBy("upload_date_utc", "version_uuid").collect()
    return [r for r in rows if r.upload_date_utc is not None]


def feed(spark, tmp_path, steps, lateness):
    """Feeds files one after the other, the query being stopped and started again in between."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    shown = []
    for rows in steps:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        counts = inflow.daily_counts(inflow.report_stream(spark, source, SCHEMA), lateness)
        inflow.keep_counts(counts, out, state).awaitTermination(120)
        shown.append(inflow.current_counts(spark, out))
    return shown


def test_three_steps_with_a_late_report_equal_the_batch(spark, tmp_path, reports):
    third = len(reports) // 3
    first, second, last = reports[:third], reports[third:2 * third], reports[2 * third:]
    late, second = second[-1], second[:-1]
    shown = feed(spark, tmp_path, [first, second, last + [late]], "400 days")
    frame = spark.createDataFrame(reports, SCHEMA)
    for freq in ("yearweek", "month"):
        want = sorted(map(tuple, kpis.inflow(frame, None, "code", freq=freq).collect()))
        assert sorted(map(tuple, inflow.inflow(shown[-1], freq).collect())) == want
    assert shown[-1].agg(F.sum("n")).first()[0] == len(reports)


def test_a_report_beyond_the_watermark_is_not_counted(spark, tmp_path, reports):
    third = len(reports) // 3
    early, rest = reports[0], reports[1:third]
    shown = feed(spark, tmp_path, [rest, reports[third:2 * third], reports[2 * third:] + [early]], "1 day")
    assert shown[-1].agg(F.sum("n")).first()[0] == len(reports) - 1
