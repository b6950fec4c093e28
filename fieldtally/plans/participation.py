"""User activity, retention and the inflow of labelled users."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import or_zero, percent
from ..functions.periods import as_instant, calendar_before, period_start, within_span
from ..operators.filters import TOTAL, identified_adults, named, only_entity, only_type
from ..operators.tables import entity_tags, wide_counts, with_scale, within_entity
from ..operators.timeseries import after_first, of_all, regular

AsOf = dt.datetime | str | None


def _as_of(reports: DataFrame, as_of: AsOf) -> Column:
    """The instant activity is measured at; the last upload when none is given."""
    if as_of is not None:
        return as_instant(as_of)
    return reports.agg(F.max("upload_date_utc")).scalar()


def activity_rank(reports: DataFrame, codes: DataFrame, scale: str, span: str = "1 year",
                  as_of: AsOf = None) -> DataFrame:
    """Reporting and still active users per entity.

    Coded keys without a report form one unknown user per entity.
    """
    areas = named(codes.select("version_uuid", scale), scale)
    rows = reports.select("version_uuid", "user_id", "upload_date_utc").join(areas, "version_uuid", "right")
    users = rows.groupBy(scale, "user_id").agg(F.max("upload_date_utc").alias("last_upload"))
    since = calendar_before(_as_of(reports, as_of), span)
    out = users.groupBy(scale).agg(
        F.count("*").alias("new"),
        F.count(F.when(F.col("last_upload") >= since, 1)).alias("active"),
    )
    return out.orderBy(F.desc("new"), scale)


def _registration_counts(reports: DataFrame, codes: DataFrame, users: DataFrame, scale: str, entity: str,
                         freq: str, spans: Sequence[str], as_of: AsOf) -> DataFrame:
    """Per registration period: registered, new and, per span, active users.

    Users are kept whole and joined once with their last upload, so every span is a
    conditional count of the same pass. Users without a report count as registered only.
    """
    areas = only_entity(named(codes.select("version_uuid", scale), scale), scale, entity)
    last = (
        reports.select("version_uuid", "user_id", "upload_date_utc")
        .join(areas.select("version_uuid"), "version_uuid", "left_semi")
        .groupBy("user_id").agg(F.max("upload_date_utc").alias("last_upload"), F.lit(True).alias("reported"))
    )
    moment = _as_of(reports, as_of)
    known = users.select(F.col("user_UUID").alias("user_id"),
                         period_start(F.col("registration_time_utc"), freq).alias("period"))
    joined = known.filter(F.col("period").isNotNull()).join(last, "user_id", "left")
    actives = [
        F.count(F.when(F.col("last_upload") >= calendar_before(moment, span), 1)).alias(f"active_{i}")
        for i, span in enumerate(spans)
    ]
    return joined.groupBy("period").agg(
        F.count("*").alias("registered"), F.count("reported").alias("new"), *actives
    )


def activity(reports: DataFrame, codes: DataFrame, users: DataFrame, scale: str, entity: str = TOTAL,
             freq: str = "month", span: str = "1 year", as_of: AsOf = None) -> DataFrame:
    """Registered, new, active and inactive users by registration period.

    `registered` ignores the entity. The share of new users refers to the busiest
    period, the first one included, which itself is then left out.
    """
    counts = _registration_counts(reports, codes, users, scale, entity, freq, [span], as_of)
    table = counts.select(
        "period", "registered", "new", F.col("active_0").alias("active"),
        (F.col("new") - F.col("active_0")).alias("inactive"),
        percent(F.col("active_0"), F.col("new")).alias("active_perc"),
        percent(F.col("new"), of_all(F.max("new"))).alias("new_perc"),
    )
    return regular(after_first(table), freq, fill=0)


def active_shares(reports: DataFrame, codes: DataFrame, users: DataFrame, scale: str, spans: Sequence[str],
                  entity: str = TOTAL, freq: str = "month", as_of: AsOf = None) -> DataFrame:
    """Active share per registration period for several spans side by side, in one pass."""
    counts = _registration_counts(reports, codes, users, scale, entity, freq, spans, as_of)
    table = counts.select("period", *[
        percent(F.col(f"active_{i}"), F.col("new")).alias(f"active_perc_{span.replace(' ', '_')}")
        for i, span in enumerate(spans)
    ])
    return regular(after_first(table), freq, fill=0)


def user_days(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First and last upload of each user and day.

    The calendar bounds the rows left per user, however often that user reports, and
    the reduction happens before the shuffle.
    """
    return rows.groupBy(*keys, "user_id", F.col("upload_date_utc").cast("date").alias("day")).agg(
        F.min("upload_date_utc").alias("first"), F.max("upload_date_utc").alias("last"), F.count("*").alias("n")
    )


def _retained(days_of_users: DataFrame, keys: Sequence[str], freq: str, span: str) -> DataFrame:
    """Share of the users of each period that had reported before within `span`.

    An upload is a return when the gap to the user's previous upload is short enough.
    Two uploads of one day always are (spans count in days), the first upload of a day
    is compared with the last one of the user's previous day.
    """
    line = Window.partitionBy(*keys, "user_id").orderBy("day")
    returns = (F.col("n") > 1) | F.coalesce(within_span(F.lag("last").over(line), F.col("first"), span), F.lit(False))
    days = days_of_users.select(*keys, "user_id", period_start(F.col("day"), freq).alias("period"),
                            returns.alias("returned"))
    # uploads without a user stay as rows, but count as nobody
    users = days.groupBy(*keys, "user_id", "period").agg(F.max("returned").alias("returned"))
    return users.groupBy(*keys, "period").agg(
        percent(F.count(F.when(F.col("returned"), F.col("user_id"))), F.count("user_id")).alias("user_retention")
    )


def retention(reports: DataFrame, codes: DataFrame, scale: str, entity: str = TOTAL, freq: str = "month",
              report_type: str | None = None, span: str = "1 year") -> DataFrame:
    """Percent of the users of a period whose previous upload lies within `span`."""
    rows = within_entity(only_type(reports, report_type), codes, scale, entity)
    table = _retained(user_days(rows, []), [], freq, span)
    return regular(table, freq, fill=0)


def _merged_days(days_of_users: DataFrame, keys: Sequence[str]) -> DataFrame:
    """User days of several groups put together under new keys."""
    return days_of_users.groupBy(*keys, "user_id", "day").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))


def retention_by_entity(reports: DataFrame, codes: DataFrame, scale: str, entities: Sequence[str],
                        freq: str = "month", report_type: str | None = None, span: str = "1 year") -> DataFrame:
    """`retention` of several entities ('Total' among them) in one pass, long form."""
    per_area = user_days(with_scale(only_type(reports, report_type), codes, scale), [scale])
    tagged = _merged_days(per_area.withColumn("entity", F.explode(entity_tags(scale, entities))), ["entity"])
    return regular(_retained(tagged, ["entity"], freq, span), freq, by=["entity"], fill=0)


def retention_exports(reports: DataFrame, codes: DataFrame, scale: str, entities: Sequence[str],
                      report_types: Sequence[str], freq: str = "month", span: str = "1 year") -> DataFrame:
    """`retention` for every combination of entity and report type ('all' for any type) in one pass."""
    per_area = user_days(with_scale(reports, codes, scale), [scale, "report_type"])
    own_type = F.when(F.col("report_type").isin([t for t in report_types if t]), F.col("report_type"))
    types = F.array_compact(F.array(own_type, *([F.lit("all")] if "" in report_types else [])))
    tagged = (
        per_area.withColumn("entity", F.explode(entity_tags(scale, entities)))
        .withColumn("report_type", F.explode(types)))
    keys = ["entity", "report_type"]
    return regular(_retained(_merged_days(tagged, keys), keys, freq, span), freq, by=keys, fill=0)


def retention_columns(long: DataFrame, entities: Sequence[str]) -> DataFrame:
    """`retention_by_entity` with one column per entity, aligned on the period."""
    return long.groupBy("period").agg(*[
        F.max(F.when(F.col("entity") == e, F.col("user_retention"))).alias(e) for e in entities
    ])


def retention_stats(activity_table: DataFrame, retention_table: DataFrame) -> DataFrame:
    """Activity with the retention of the same period where there is one."""
    return activity_table.join(retention_table, "period", "left")


def labelled_inflow_long(reports: DataFrame, users: DataFrame, label: str, freq: str = "month",
                         by: Sequence[str] = ()) -> DataFrame:
    """Identified adult reports per user label and upload period.

    Reports are counted per user and period before the users are joined, so a very
    active user is one row per period in the join.
    """
    rows = identified_adults(reports).select("user_id", period_start(F.col("upload_date_utc"), freq).alias("period"))
    counts = rows.groupBy("user_id", "period").agg(F.count("*").alias("n"))
    return counts.join(users.select("user_id", label, *by), "user_id").groupBy(*by, label, "period").agg(
        F.sum("n").alias("ct")
    )


def labelled_inflow(reports: DataFrame, users: DataFrame, label: str, labels: Sequence[str],
                    entity: str = TOTAL, freq: str = "month", scale: str = "name_gadm_level0") -> DataFrame:
    """Inflow by user label, wide; the entity is the user's main country."""
    long = labelled_inflow_long(reports, only_entity(users, scale, entity), label, freq)
    wide = long.groupBy("period").agg(*wide_counts(F.col(label), labels, F.col("ct")))
    return regular(wide, freq, fill=0)


def zero_filled(table: DataFrame) -> DataFrame:
    """Missing counts as 0."""
    return table.select("period", *[or_zero(F.col(c)).alias(c) for c in table.columns if c != "period"])
