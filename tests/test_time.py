import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldtally.functions import periods
from fieldtally.operators import timeseries
from fieldtally.plans import kpis, participation

T = dt.datetime


def ts(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n} timestamp_ntz" for n in names))


def reports(spark, rows):
    return spark.createDataFrame(rows, "version_uuid long, user_id long, report_type string, labels string, "
                                 "upload_date_utc timestamp_ntz, observation_date_utc timestamp_ntz, "
                                 "validation_date_utc timestamp_ntz, validated boolean")


def codes(spark, rows):
    return spark.createDataFrame(rows, "version_uuid long, name_gadm_level0 string")


SCALE = "name_gadm_level0"


def test_week_starts_on_monday(spark):
    df = ts(spark, [(T(2024, 1, 3, 10),)], ["t"])
    assert df.select(periods.period_start(F.col("t"), "yearweek")).first()[0] == T(2024, 1, 1)


def test_unknown_frequency(spark):
    with pytest.raises(ValueError):
        periods.period_start(F.col("t"), "week-ish")


def test_minutes_count_boundaries(spark):
    df = ts(spark, [(T(2024, 1, 1, 10, 0, 59), T(2024, 1, 1, 10, 1, 0))], ["a", "b"])
    row = df.select(periods.minutes_between(F.col("a"), F.col("b")), periods.minutes_between(F.col("b"), F.col("a"))).first()
    assert tuple(row) == (1, -1)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_buckets_do_not_depend_on_the_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = ts(spark, [(T(2024, 3, 10, 2, 30), T(2024, 3, 10, 3, 30))], ["a", "b"])
        row = df.select(periods.period_start(F.col("a"), "day"), periods.period_start(F.col("a"), "month"),
                        periods.minutes_between(F.col("a"), F.col("b"))).first()
        assert tuple(row) == (T(2024, 3, 10), T(2024, 3, 1), 60)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_year_apart_is_360_days(spark):
    a = T(2023, 1, 1)
    df = ts(spark, [(a, a + dt.timedelta(days=360), a + dt.timedelta(days=361))], ["a", "b", "c"])
    row = df.select(periods.within_span(F.col("a"), F.col("b"), "1 year"),
                    periods.within_span(F.col("a"), F.col("c"), "1 year")).first()
    assert tuple(row) == (True, False)


def test_calendar_year_before(spark):
    df = ts(spark, [(T(2024, 2, 29),)], ["a"])
    assert df.select(periods.calendar_before(F.col("a"), "1 year")).first()[0] == T(2023, 2, 28)


def test_retention_at_the_limit(spark):
    start = T(2020, 1, 15)
    for gap, want in ((360, 100.0), (361, 0.0)):
        again = start + dt.timedelta(days=gap)
        r = reports(spark, [(1, 7, "adult", "a", start, start, None, False), (2, 7, "adult", "a", again, again, None, False)])
        out = participation.retention(r, codes(spark, []), SCALE).orderBy(F.desc("period")).first()
        assert out["user_retention"] == want


def test_retention_within_one_day_and_unknown_users(spark):
    day = T(2020, 1, 15)
    r = reports(spark, [
        (1, 7, "adult", "a", day, day, None, False), (2, 7, "adult", "a", day + dt.timedelta(hours=3), day, None, False),
        (3, 8, "adult", "a", day, day, None, False), (4, None, "adult", "a", day, day, None, False),
        (5, None, "adult", "a", day, day, None, False)])
    assert participation.retention(r, codes(spark, []), SCALE).first()["user_retention"] == 50.0


def test_quartiles(spark):
    base = T(2020, 5, 1)
    rows = [(i, 1, "adult", "a", base, base, base + dt.timedelta(days=d) if d else None, True)
            for i, d in enumerate([1, 2, 10, None])]
    row = kpis.publication_delay(reports(spark, rows), codes(spark, []), SCALE).first()
    assert (row["perc25"], row["median"]) == (1.5, 2.0)


def test_backlog_loses_validations_outside_upload_periods_and_fills(spark):
    r = reports(spark, [
        (1, 1, "adult", "a", T(2020, 1, 5), T(2020, 1, 5), T(2020, 1, 9), True),
        (2, 1, "adult", "a", T(2020, 1, 6), T(2020, 1, 6), T(2020, 2, 9), True),
        (3, 1, "adult", "a", T(2020, 4, 6), T(2020, 4, 6), T(2020, 4, 9), False)])
    got = [tuple(x) for x in kpis.backlog(r, codes(spark, []), SCALE).orderBy("period").collect()]
    assert got == [(T(2020, 1, 1), 1), (T(2020, 2, 1), 1), (T(2020, 3, 1), 1), (T(2020, 4, 1), 2)]


def test_added_periods_are_zero_but_empty_cells_stay_null(spark):
    r = reports(spark, [(1, 1, "adult", "a", T(2020, 1, 5), T(2020, 1, 5), None, True),
                        (2, 1, "site", "a", T(2020, 3, 6), T(2020, 3, 6), None, True)])
    got = [tuple(x)[1:] for x in kpis.inflow(r, codes(spark, []), SCALE).orderBy("period").collect()]
    assert got == [(1, None, None), (0, 0, 0), (None, None, 1)]


def test_label_series_finds_labels_and_rejects_unknown_entities(spark):
    r = reports(spark, [(1, 1, "adult", "x", T(2020, 1, 5), T(2020, 1, 5), None, True),
                        (2, 1, "adult", None, T(2020, 2, 6), T(2020, 2, 6), None, True)])
    c = codes(spark, [(1, "Here"), (2, "Here")])
    out = kpis.label_series(r, c, SCALE, entity="Here")
    assert out.columns == ["period", "x"]
    assert [tuple(x)[1:] for x in out.orderBy("period").collect()] == [(1,), (None,)]
    with pytest.raises(ValueError):
        kpis.label_series(r, c, SCALE, entity="Nowhere")


def test_entity_names_with_quotes(spark):
    r = reports(spark, [(1, 1, "adult", "x", T(2020, 1, 5), T(2020, 1, 5), None, True)])
    name = "Côte d'Ivoire \"$$\""
    out = kpis.inflow(r, codes(spark, [(1, name)]), SCALE, name)
    assert out.first()["adult"] == 1


def test_unknown_reports_count_as_one_user_per_entity(spark):
    r = reports(spark, [(1, 1, "adult", "x", T(2020, 1, 5), T(2020, 1, 5), None, True)])
    c = codes(spark, [(1, "A"), (2, "A"), (3, "A"), (4, "NULL"), (5, None)])
    got = [tuple(x) for x in participation.activity_rank(r, c, SCALE, as_of="2020-06-01").collect()]
    assert got == [("A", 2, 1)]


def test_activity_drops_the_first_period_after_the_maximum(spark):
    users = spark.createDataFrame([(i, T(2019, 1, 5)) for i in range(4)] + [(10, T(2019, 3, 5)), (11, T(2019, 4, 5))],
                                  "user_UUID long, registration_time_utc timestamp_ntz")
    r = reports(spark, [(i, i, "adult", "x", T(2020, 1, 5), T(2020, 1, 5), None, True) for i in (0, 1, 2, 3, 10)])
    c = codes(spark, [(i, "A") for i in (0, 1, 2, 3, 10)])
    got = [tuple(x) for x in participation.activity(r, c, users, SCALE, as_of="2020-06-01").orderBy("period").collect()]
    assert got == [(T(2019, 3, 1), 1, 1, 1, 0, 100.0, 25.0), (T(2019, 4, 1), 1, 0, 0, 0, None, 0.0)]


def test_spine_of_two(spark):
    a = ts(spark, [(T(2020, 1, 1),)], ["period"])
    b = ts(spark, [(T(2020, 3, 1),)], ["period"])
    assert [x[0] for x in timeseries.spine(a, "month", other=b).collect()] == [T(2020, m, 1) for m in (1, 2, 3)]
