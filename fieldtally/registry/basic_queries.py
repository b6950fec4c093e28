"""Single operators over the stand-in tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import classify, numeric, periods, text
from ..operators import filters, tables, timeseries
from ..plans import kpis, participation
from ..sources import proxy
from ..sources import tables as io
from ..sources.proxy import with_views
from .kpi_queries import (
    AS_OF, BUSY, ENTITIES, LABELS, SCALE, TYPES, _coverage_sql, _retention_cte, effort_tables, rounded,
    sql_axis, sql_wide, zero_if_added,
)


def _reports(spark, d, validation=False):
    return proxy.reports(spark, d, validation)


def _named(spark, d, validation=False):
    return tables.with_scale(_reports(spark, d, validation), proxy.reports_codes(spark, d), SCALE)


def _monthly(spark, d, *keys):
    r = _reports(spark, d).select(periods.period_start(F.col("upload_date_utc"), "month").alias("period"), *keys)
    return tables.counts_by(r, "period", *keys)


# Scans, filters, projections -----------------------------------------------------

def _scan(spark, d):
    return io.read_parquet(spark, f"{d}/orders.parquet", "o_orderkey", "o_orderdate")


def _columns(spark, d):
    return proxy.table(spark, d, "customer").select("c_custkey", "c_mktsegment")


def _without(spark, d):
    return proxy.table(spark, d, "nation").drop("n_regionkey")


def _geolocated(spark, d):
    return filters.geolocated(proxy.map_records(spark, d)).select("version_uuid")


def _entity(spark, d):
    return filters.only_entity(_named(spark, d), SCALE, BUSY).select("version_uuid")


def _type(spark, d):
    return filters.only_type(_reports(spark, d), "bite").select("version_uuid")


def _named_only(spark, d):
    return filters.named(_named(spark, d), SCALE).select("version_uuid", SCALE)


def _membership(spark, d):
    return _reports(spark, d).filter(F.col("labels").isin(classify.TARGET_SPECIES)).select("version_uuid", "labels")


def _complete(spark, d):
    return filters.complete(_named(spark, d).select("version_uuid", "labels", SCALE), "labels", SCALE)


def _identified(spark, d):
    return filters.identified_adults(_reports(spark, d)).select("version_uuid", "labels")


def _threshold(spark, d):
    r = kpis.rank(_reports(spark, d), proxy.reports_codes(spark, d), "name_gadm_level1")
    return filters.name_like(filters.at_least(r, "total", 500), "name_gadm_level1", "nation_1")


def _during(spark, d):
    return filters.during(_monthly(spark, d), "period", "1996-03-01", "1998-02-01")


def _casts(spark, d):
    u = proxy.raw_users(spark, d)
    return u.select("user_UUID", F.col("registration_time").cast("timestamp_ntz").alias("registered"),
                    F.col("last_score_update").cast("timestamp_ntz").cast("date").cast("timestamp_ntz").alias("updated"),
                    (F.col("user_UUID") % 2).cast("boolean").alias("odd"),
                    text.fixed_decimals(F.col("score_v2")).alias("score_text"))


# Joins ---------------------------------------------------------------------------

def _left_scale(spark, d):
    return _named(spark, d).select("version_uuid", SCALE)


def _legend(how):
    def run(spark, d):
        return tables.with_legend(proxy.codes(spark, d), proxy.gadm_legend(spark, d), "code_gadm", how).select(
            "version_uuid", "name_gadm_level1")
    return run


def _right(spark, d):
    r = _reports(spark, d).select("version_uuid", "user_id")
    return r.join(proxy.codes(spark, d).select("version_uuid"), "version_uuid", "right")


def _inner_users(spark, d):
    return _reports(spark, d).select("version_uuid", "user_id").join(
        proxy.app_users(spark, d).select(F.col("user_UUID").alias("user_id"), "score_v2"), "user_id")


def _two_dates(spark, d):
    r = _reports(spark, d, True)
    ins = tables.counts_by(r.select(periods.period_start(F.col("upload_date_utc"), "month").alias("upload_date")),
                           "upload_date", name="ins")
    outs = tables.counts_by(r.select(periods.period_start(F.col("validation_date_utc"), "month").alias("validation_date")),
                            "validation_date", name="outs")
    return ins.join(outs, F.col("upload_date") == F.col("validation_date"), "left").select(
        "upload_date", "ins", numeric.or_zero(F.col("outs")).alias("outs"))


def _chained(spark, d):
    r, u = _reports(spark, d), proxy.app_users(spark, d)
    per = [tables.counts_by(f.select(periods.period_start(F.col(c), "quarter").alias("period")), "period", name=n)
           for f, c, n in ((u, "registration_time_utc", "registered"), (r, "upload_date_utc", "uploaded"),
                           (r, "observation_date_utc", "observed"))]
    return per[0].join(per[1], "period", "left").join(per[2], "period", "left")


def _aligned(spark, d):
    spans = {"adult": ("1996-01-01", None), "bite": (None, "1999-12-01"), "site": ("1995-06-01", "2000-06-01")}
    counts = _monthly(spark, d, "report_type")
    return tables.align([
        filters.during(filters.only_type(counts, t).select("period", F.col("ct").alias(t)), "period", *span)
        for t, span in spans.items()], "period")


def _hot(spark, d):
    labels = proxy.table(spark, d, "customer", "c_custkey", "c_mktsegment").withColumnRenamed("c_custkey", "user_id")
    j = tables.join_hot(_reports(spark, d).select("version_uuid", "user_id"), labels, ["user_id"])
    return j.select("version_uuid", "c_mktsegment")


def _unseen(spark, d):
    r = _reports(spark, d).select("version_uuid")
    return tables.unseen(r, proxy.codes(spark, d), "version_uuid")


def _overwrite(spark, d):
    c = proxy.table(spark, d, "customer", "c_custkey", "c_mktsegment")
    new = c.select(
        "c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).alias("c_mktsegment"))
    return tables.overwrite_where_known(c, new, "c_custkey", "c_mktsegment")


# Aggregates, windows, sets ---------------------------------------------------------

def _count_two(spark, d):
    return tables.counts_by(_named(spark, d), SCALE, "labels")


def _quartiles(spark, d):
    r = _reports(spark, d, True)
    return rounded(r.filter(F.col("validation_date_utc").isNotNull()).select(
        "report_type", periods.minutes_between(F.col("upload_date_utc"), F.col("validation_date_utc")).alias("m")
    ).groupBy("report_type", "m").agg(F.count("*").alias("n")).groupBy("report_type").agg(
        F.percentile("m", F.lit(0.25), F.col("n")).alias("q25"), F.percentile("m", F.lit(0.5), F.col("n")).alias("q50")))


def _distinct(spark, d):
    return _reports(spark, d).groupBy("report_type").agg(F.count_distinct("user_id").alias("users"))


def _distinct_ratio(spark, d):
    users = _reports(spark, d).groupBy("report_type", "user_id").agg(F.max(F.col("labels") == "culex").alias("hit"))
    return rounded(users.groupBy("report_type").agg(
        numeric.percent(F.count(F.when(F.col("hit"), 1)), F.count("user_id")).alias("share")))


def _latest(spark, d):
    a = proxy.annotations(spark, d).filter(F.col("validation_complete") & F.col("category_id").isNotNull())
    return a.groupBy("report_id").agg(F.max("last_modified").alias("latest"))


def _totals(spark, d):
    return _monthly(spark, d).agg(F.sum("ct").alias("ct"), F.count("*").alias("periods"))


def _dedup(spark, d):
    f = proxy.fixes(spark, d).select(F.round("masked_lon", 3).alias("lon"), F.round("masked_lat", 3).alias("lat"))
    return f.dropDuplicates(["lon", "lat"])


def _pivot(spark, d):
    r = _reports(spark, d).select(periods.period_start(F.col("upload_date_utc"), "year").alias("period"), "labels")
    return tables.pivot_counts(r, "period", "labels")


def _row_total(spark, d):
    w = tables.pivot_counts(_named(spark, d), SCALE, "report_type", TYPES)
    return w.withColumn("total", tables.row_total(TYPES))


def _shares(spark, d):
    return rounded(kpis.period_shares(_monthly(spark, d, "report_type"), "report_type"))


def _user_counts(spark, d):
    return tables.counts_by(_reports(spark, d), "user_id").groupBy("ct").agg(F.count("*").alias("users"))


def _previous_day(spark, d):
    days = participation.user_days(_reports(spark, d), [])
    line = Window.partitionBy("user_id").orderBy("day")
    return days.select("user_id", F.col("day").cast("timestamp_ntz").alias("day"), F.lag("last").over(line).alias("previous"))


def _running(spark, d):
    return _monthly(spark, d).withColumn("so_far", timeseries.running_total(F.col("ct")))


def _of_total(spark, d):
    c = tables.counts_by(_reports(spark, d), "labels")
    return rounded(c.withColumn("share", numeric.percent(F.col("ct"), timeseries.of_all(F.sum("ct"))))
                   .withColumn("of_max", numeric.percent(F.col("ct"), timeseries.of_all(F.max("ct")))))


def _fill_forward(spark, d):
    m = _monthly(spark, d).withColumn("odd", F.when(F.col("ct") % 2 == 1, F.col("ct")))
    return m.select("period", timeseries.last_known(F.col("odd")).alias("last_odd"))


def _not_first(spark, d):
    return timeseries.after_first(_monthly(spark, d, "report_type"), by=["report_type"])


def _sorted(spark, d):
    return tables.ordered(tables.counts_by(_named(spark, d), SCALE, "report_type"), ("ct", True), (SCALE, False))


def _top_label(spark, d):
    c = tables.counts_by(_reports(spark, d), "user_id", "report_type")
    return tables.top_one(c, ["user_id"], [("ct", True)], ["report_type", "ct"])


def _tagged(spark, d):
    r = _named(spark, d)
    return tables.append([tables.counts_by(filters.only_entity(r, SCALE, e), "report_type").withColumn("entity", F.lit(e))
                          for e in ENTITIES])


def _union_distinct(spark, d):
    r = _reports(spark, d)
    return r.select("user_id").union(proxy.app_users(spark, d).select("user_UUID")).distinct()


# Functions and time axes -----------------------------------------------------------

def _buckets(spark, d):
    e = proxy.table(spark, d, "events", "event_id", "ts")
    return e.select("event_id", *[periods.period_start(F.col("ts"), f).alias(f) for f in periods.FREQUENCIES])


def _week_counts(spark, d):
    e = proxy.table(spark, d, "events", "ts", "event_type")
    return tables.counts_by(e.select(periods.period_start(F.col("ts"), "yearweek").alias("period"), "event_type"),
                            "period", "event_type")


def _minutes(spark, d):
    r = _reports(spark, d, True)
    return r.select("version_uuid", periods.minutes_between(F.col("upload_date_utc"), F.col("validation_date_utc")).alias("m"))


def _calendar(spark, d):
    since = periods.calendar_before(periods.as_instant(AS_OF), "6 months")
    return _reports(spark, d).filter(F.col("upload_date_utc") >= since).select("version_uuid")


def _within(spark, d):
    r = _reports(spark, d, True)
    return r.select("version_uuid", *[
        periods.within_span(F.col("upload_date_utc"), F.col("validation_date_utc"), s).alias(n)
        for s, n in (("1 month", "a_month"), ("1 year", "a_year"), ("2 weeks", "two_weeks"))])


def _since(spark, d):
    return _monthly(spark, d).select("period", periods.months_since(
        F.col("period"), F.lit("1997-06-23").cast("timestamp_ntz")).alias("months"))


def _spine(freq):
    def run(spark, d):
        r = _reports(spark, d, True)
        a = r.select(periods.period_start(F.col("upload_date_utc"), freq).alias("period"))
        b = r.select(periods.period_start(F.col("validation_date_utc"), freq).alias("period"))
        return timeseries.spine(a, freq, other=b)
    return run


def _texts(spark, d):
    c = proxy.map_records(spark, d)
    return c.select(
        "version_uuid", periods.iso_day(F.col("observation_date")).alias("day"),
        text.path_part(F.col("expert_validation_result"), "#", 2).alias("code"),
        text.path_part(F.col("photo_url"), "/", 4).alias("file"),
        text.joined_key(F.col("bite_location"), F.col("type"), F.col("bite_time")).alias("key"))


def _missing_names(spark, d):
    return proxy.areas(spark, d).select("UID", text.not_available(F.col("NAME_3")).alias("missing"))


def _ascii(spark, d):
    a = proxy.areas(spark, d)
    return a.select("UID", *[text.to_ascii(F.col(c)).alias(c) for c in ("NAME_0", "NAME_3")])


def _numbers(spark, d):
    c = proxy.table(spark, d, "customer")
    a, b = F.abs("c_acctbal") / 10000, (F.col("c_custkey") % 10) / F.lit(10.0)
    return rounded(c.select(
        "c_custkey", numeric.harmonic_mean(a, b).alias("hmean"), numeric.clip_at_zero(F.col("c_acctbal")).alias("clipped"),
        numeric.damped_log(F.abs("c_acctbal") / 100).alias("damped"), numeric.capped(F.col("c_custkey") % 5, 2).alias("capped"),
        numeric.ratio(F.col("c_acctbal"), F.col("c_custkey") % 3).alias("ratio"),
        numeric.share_or_zero(F.col("c_acctbal"), F.col("c_custkey") % 3).alias("share"),
        numeric.decision_index(a, b).alias("p")))


def _per_user(spark, d, freq, *keys):
    return _reports(spark, d).select("user_id", periods.period_start(F.col("upload_date_utc"), freq).alias("period"), *keys)


def _typed(spark, d, freq):
    return _per_user(spark, d, freq, "report_type").groupBy("user_id", "period").agg(
        *tables.wide_counts(F.col("report_type"), TYPES))


def _zero_axis(spark, d):
    """One axis per user: added quarters are 0, empty cells of existing ones stay null."""
    return timeseries.regular(_typed(spark, d, "quarter"), "quarter", by=["user_id"], fill=0)


def _null_axis(spark, d):
    return timeseries.regular(tables.counts_by(_per_user(spark, d, "year"), "user_id", "period"), "year", by=["user_id"])


def _carried_axis(spark, d):
    counts = tables.counts_by(_per_user(spark, d, "quarter"), "user_id", "period")
    acc = counts.select("user_id", "period", timeseries.running_total(F.col("ct"), by=["user_id"]).alias("so_far"))
    return timeseries.regular(acc, "quarter", by=["user_id"], carry=["so_far"])


def _full_axis(spark, d):
    full = timeseries.regular(_typed(spark, d, "year"), "year", by=["user_id"])
    return full.select("user_id", "period", *[numeric.or_zero(F.col(t)).alias(t) for t in TYPES])


def _padded(spark, d):
    w = tables.pivot_counts(_named(spark, d), SCALE, "labels", LABELS)
    return tables.padded(w, ["culex", "albopictus", "aegypti", "not-sure"], keep=[SCALE])


# Exports ---------------------------------------------------------------------------

def _extract(spark, d):
    return io.entity_extract(_reports(spark, d), proxy.codes(spark, d), proxy.gadm_legend(spark, d), BUSY).select(
        "version_uuid", "user_id", "upload_date_utc", "report_type", "labels")


def _by_day(spark, d):
    wide = kpis.inflow(_reports(spark, d), proxy.reports_codes(spark, d), SCALE)
    return io.by_day(wide)


def _exports(spark, d):
    return rounded(participation.retention_exports(
        _reports(spark, d), proxy.reports_codes(spark, d), SCALE, ENTITIES, ["", "adult", "bite"]))


def _coverage_exports(spark, d):
    effort, pixels, _ = effort_tables(spark, d)
    return rounded(kpis.coverage_by_entity(effort, pixels, proxy.gadm_legend(spark, d), SCALE, ENTITIES, "yearweek"))


QUERIES = {
    "src_parquet_columns": _scan, "select_columns": _columns, "select_without": _without,
    "filter_geolocated": _geolocated, "filter_entity": _entity, "filter_report_type": _type,
    "filter_named": _named_only, "filter_membership": _membership, "filter_complete": _complete,
    "filter_identified_adults": _identified, "filter_threshold_and_like": _threshold, "filter_during": _during,
    "select_casts": _casts,
    "join_left_scale": _left_scale, "join_legend_left": _legend("left"), "join_legend_inner": _legend("inner"),
    "join_right_keys": _right, "join_inner_users": _inner_users, "join_differently_named": _two_dates,
    "join_chained_left": _chained, "join_full_outer_align": _aligned, "join_frequent_keys": _hot,
    "join_anti_unseen": _unseen, "join_overwrite_where_known": _overwrite,
    "agg_count_two_keys": _count_two, "agg_exact_quartiles": _quartiles, "agg_count_distinct": _distinct,
    "agg_distinct_ratio": _distinct_ratio, "agg_latest_per_key": _latest, "agg_grand_totals": _totals,
    "agg_drop_duplicates": _dedup, "agg_pivot": _pivot, "agg_row_total": _row_total, "agg_period_shares": _shares,
    "agg_value_counts": _user_counts,
    "win_previous_upload": _previous_day, "win_running_total": _running, "win_share_of_total_and_max": _of_total,
    "win_fill_forward": _fill_forward, "win_drop_first": _not_first,
    "sort_nulls_last": _sorted, "sort_top_per_group": _top_label,
    "set_append_tagged": _tagged, "set_union_distinct": _union_distinct,
    "fn_period_start": _buckets, "fn_week_buckets": _week_counts, "fn_minutes_between": _minutes,
    "fn_calendar_before": _calendar, "fn_within_span": _within, "fn_months_since": _since,
    "fn_spine_month": _spine("month"), "fn_spine_day": _spine("day"), "fn_texts": _texts,
    "fn_not_available": _missing_names, "fn_to_ascii": _ascii, "fn_numbers": _numbers,
    "ts_zero_axis": _zero_axis, "ts_null_axis": _null_axis, "ts_carried_axis": _carried_axis,
    "ts_zero_everywhere": _full_axis, "ts_padded_categories": _padded,
    "sink_entity_extract": _extract, "sink_records_by_day": _by_day, "sink_retention_exports": _exports,
    "sink_coverage_exports": _coverage_exports,
}

_RC = "v_reports LEFT JOIN v_named USING (version_uuid)"
_MONTH = "date_trunc('month', upload_date_utc)::TIMESTAMP AS period"
_LOG = "CASE WHEN {v} = 0 THEN 1 WHEN ln({v}) < 0 THEN 1 ELSE ln({v}) END"
_SIG = "(1 / (1 + exp(-({x}))))"


def _user_axis(unit: str, step: str, columns: str, select: str = "count(*) AS ct", wrap: str = "SELECT * FROM base") -> str:
    return with_views(f"""
        SELECT a.user_id, a.period, {columns} FROM (
            SELECT user_id, unnest(generate_series(lo, hi, INTERVAL '{step}'))::TIMESTAMP AS period FROM (
                SELECT user_id, min(period) AS lo, max(period) AS hi FROM counts GROUP BY 1)) a
        LEFT JOIN (SELECT *, TRUE AS hit FROM counts) c USING (user_id, period)""", "v_reports", extra={"base": f"""
            SELECT user_id, date_trunc('{unit}', upload_date_utc)::TIMESTAMP AS period, {select}
            FROM v_reports GROUP BY 1, 2""", "counts": wrap})


def _spine_sql(unit: str, step: str) -> str:
    return with_views(f"""
        SELECT unnest(generate_series(lo, hi, INTERVAL '{step}'))::TIMESTAMP AS period FROM (
            SELECT date_trunc('{unit}', least(min(upload_date_utc), min(validation_date_utc)))::TIMESTAMP AS lo,
                   date_trunc('{unit}', greatest(max(upload_date_utc), max(validation_date_utc)))::TIMESTAMP AS hi
            FROM v_reports)""", "v_reports")


def _fold(c: str) -> str:
    out = f'"{c}"'
    for a, b in (("ü", "u"), ("Ñ", "N"), ("ú", "u"), ("ß", "ss")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


ORACLE = {
    "src_parquet_columns": "SELECT o_orderkey, o_orderdate FROM orders",
    "select_columns": "SELECT c_custkey, c_mktsegment FROM customer",
    "select_without": "SELECT * EXCLUDE (n_regionkey) FROM nation",
    "filter_geolocated": with_views("SELECT version_uuid FROM v_records WHERE lat IS NOT NULL", "v_records"),
    "filter_entity": with_views(f"SELECT version_uuid FROM {_RC} WHERE {SCALE} = '{BUSY}'", "v_reports", "v_named"),
    "filter_report_type": with_views("SELECT version_uuid FROM v_reports WHERE report_type = 'bite'", "v_reports"),
    "filter_named": with_views(f"SELECT version_uuid, {SCALE} FROM {_RC} WHERE {SCALE} <> 'NULL'", "v_reports", "v_named"),
    "filter_membership": with_views("""
        SELECT version_uuid, labels FROM v_reports
        WHERE labels IN ('aegypti', 'albopictus', 'culex', 'japonicus', 'koreicus')""", "v_reports"),
    "filter_complete": with_views(f"""
        SELECT version_uuid, labels, {SCALE} FROM {_RC} WHERE labels IS NOT NULL AND {SCALE} IS NOT NULL""",
        "v_reports", "v_named"),
    "filter_identified_adults": with_views("""
        SELECT version_uuid, labels FROM v_reports
        WHERE report_type = 'adult' AND labels <> 'not-sure' AND labels <> 'unvalidated'""", "v_reports"),
    "filter_threshold_and_like": with_views(f"""
        SELECT name_gadm_level1, {sql_wide('report_type', TYPES)}, count(*) AS total FROM {_RC}
        WHERE name_gadm_level1 <> 'NULL' AND name_gadm_level1 ILIKE '%nation~_1%' ESCAPE '~' GROUP BY 1
        HAVING count(*) >= 500""", "v_reports", "v_named"),
    "filter_during": with_views(f"""
        SELECT {_MONTH}, count(*) AS ct FROM v_reports GROUP BY 1
        HAVING period BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1998-02-01'""", "v_reports"),
    "select_casts": with_views("""
        SELECT "user_UUID", registration_time::TIMESTAMP AS registered, last_score_update::DATE::TIMESTAMP AS updated,
               ("user_UUID" % 2)::BOOL AS odd, round(score_v2::DECIMAL(18, 9), 3)::DECIMAL(18, 3)::VARCHAR AS score_text
        FROM v_raw_users""", "v_raw_users"),
    "join_left_scale": with_views(f"SELECT version_uuid, {SCALE} FROM {_RC}", "v_reports", "v_named"),
    "join_legend_left": with_views(
        "SELECT version_uuid, name_gadm_level1 FROM v_codes LEFT JOIN v_gadm USING (code_gadm)", "v_codes", "v_gadm"),
    "join_legend_inner": with_views(
        "SELECT version_uuid, name_gadm_level1 FROM v_codes JOIN v_gadm USING (code_gadm)", "v_codes", "v_gadm"),
    "join_right_keys": with_views(
        "SELECT version_uuid, user_id FROM v_reports RIGHT JOIN v_codes USING (version_uuid)", "v_reports", "v_codes"),
    "join_inner_users": with_views(
        'SELECT user_id, version_uuid, score_v2 FROM v_reports JOIN v_users ON user_id = "user_UUID"', "v_reports", "v_users"),
    "join_differently_named": with_views("""
        SELECT upload_date, ins, coalesce(outs, 0) AS outs FROM (
            SELECT date_trunc('month', upload_date_utc)::TIMESTAMP AS upload_date, count(*) AS ins FROM v_reports GROUP BY 1)
        LEFT JOIN (SELECT date_trunc('month', validation_date_utc)::TIMESTAMP AS validation_date, count(*) AS outs
                   FROM v_reports GROUP BY 1) ON upload_date = validation_date""", "v_reports"),
    "join_chained_left": with_views(
        "SELECT period, registered, uploaded, observed FROM a LEFT JOIN b USING (period) LEFT JOIN c USING (period)",
        "v_reports", "v_users", extra={
            n: f"SELECT date_trunc('quarter', {col})::TIMESTAMP AS period, count(*) AS {name} FROM {src} GROUP BY 1"
            for n, col, name, src in (("a", "registration_time_utc", "registered", "v_users"),
                                      ("b", "upload_date_utc", "uploaded", "v_reports"),
                                      ("c", "observation_date_utc", "observed", "v_reports"))}),
    "join_full_outer_align": with_views(
        "SELECT period, adult, bite, site FROM a FULL JOIN b USING (period) FULL JOIN c USING (period)", "v_reports", extra={
            n: f"SELECT * FROM (SELECT {_MONTH}, count(*) AS {t} FROM v_reports WHERE report_type = '{t}' GROUP BY 1) WHERE {w}"
            for n, t, w in (("a", "adult", "period >= TIMESTAMP '1996-01-01'"), ("b", "bite", "period <= TIMESTAMP '1999-12-01'"),
                            ("c", "site", "period BETWEEN TIMESTAMP '1995-06-01' AND TIMESTAMP '2000-06-01'"))}),
    "join_frequent_keys": with_views(
        "SELECT version_uuid, c_mktsegment FROM v_reports JOIN customer ON user_id = c_custkey", "v_reports"),
    "join_anti_unseen": with_views("""
        SELECT version_uuid FROM v_reports WHERE version_uuid NOT IN (SELECT version_uuid FROM v_codes)""",
        "v_reports", "v_codes"),
    "join_overwrite_where_known": """
        SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment)
                               ELSE c_mktsegment END AS c_mktsegment FROM customer""",
    "agg_count_two_keys": with_views(f"SELECT {SCALE}, labels, count(*) AS ct FROM {_RC} GROUP BY 1, 2",
                                     "v_reports", "v_named"),
    "agg_exact_quartiles": with_views("""
        SELECT report_type, round(quantile_cont(m, 0.25), 6) AS q25, round(quantile_cont(m, 0.5), 6) AS q50 FROM (
            SELECT report_type, date_diff('minute', upload_date_utc, validation_date_utc) AS m FROM v_reports
            WHERE validation_date_utc IS NOT NULL) GROUP BY 1""", "v_reports"),
    "agg_count_distinct": with_views(
        "SELECT report_type, count(DISTINCT user_id) AS users FROM v_reports GROUP BY 1", "v_reports"),
    "agg_distinct_ratio": with_views("""
        SELECT report_type, round(count(DISTINCT CASE WHEN labels = 'culex' THEN user_id END) * 100.0::DOUBLE
                                  / count(DISTINCT user_id), 6) AS share FROM v_reports GROUP BY 1""", "v_reports"),
    "agg_latest_per_key": with_views("""
        SELECT report_id, max(last_modified) AS latest FROM v_annotations
        WHERE validation_complete AND category_id IS NOT NULL GROUP BY 1""", "v_annotations"),
    "agg_grand_totals": with_views(f"""
        SELECT sum(ct)::BIGINT AS ct, count(*) AS periods FROM (SELECT {_MONTH}, count(*) AS ct FROM v_reports GROUP BY 1)""",
        "v_reports"),
    "agg_drop_duplicates": with_views(
        "SELECT DISTINCT round(masked_lon, 3) AS lon, round(masked_lat, 3) AS lat FROM v_fixes", "v_fixes"),
    "agg_pivot": with_views(f"""
        SELECT date_trunc('year', upload_date_utc)::TIMESTAMP AS period, {sql_wide('labels', LABELS)}
        FROM v_reports GROUP BY 1""", "v_reports"),
    "agg_row_total": with_views(f"SELECT {SCALE}, {sql_wide('report_type', TYPES)}, count(*) AS total FROM {_RC} GROUP BY 1",
                                "v_reports", "v_named"),
    "agg_period_shares": with_views(f"""
        SELECT period, report_type, ct, round(ct / sum(ct) OVER (PARTITION BY period) * 100, 6) AS share FROM (
            SELECT {_MONTH}, report_type, count(*) AS ct FROM v_reports GROUP BY 1, 2)""", "v_reports"),
    "agg_value_counts": with_views("""
        SELECT ct, count(*) AS users FROM (SELECT user_id, count(*) AS ct FROM v_reports GROUP BY 1) GROUP BY 1""", "v_reports"),
    "win_previous_upload": with_views("""
        SELECT user_id, day, previous FROM (
            SELECT user_id, date_trunc('day', upload_date_utc)::TIMESTAMP AS day, upload_date_utc AS u,
                   lag(upload_date_utc) OVER w AS previous,
                   row_number() OVER (PARTITION BY user_id, date_trunc('day', upload_date_utc) ORDER BY upload_date_utc) AS rn
            FROM v_reports WINDOW w AS (PARTITION BY user_id ORDER BY upload_date_utc)) WHERE rn = 1""", "v_reports"),
    "win_running_total": with_views(f"""
        SELECT period, ct, sum(ct) OVER (ORDER BY period)::BIGINT AS so_far FROM (
            SELECT {_MONTH}, count(*) AS ct FROM v_reports GROUP BY 1)""", "v_reports"),
    "win_share_of_total_and_max": with_views("""
        SELECT labels, ct, round(ct / sum(ct) OVER () * 100, 6) AS share, round(ct / max(ct) OVER () * 100, 6) AS of_max
        FROM (SELECT labels, count(*) AS ct FROM v_reports GROUP BY 1)""", "v_reports"),
    "win_fill_forward": with_views(f"""
        SELECT period, last_value(CASE WHEN ct % 2 = 1 THEN ct END IGNORE NULLS) OVER (ORDER BY period) AS last_odd FROM (
            SELECT {_MONTH}, count(*) AS ct FROM v_reports GROUP BY 1)""", "v_reports"),
    "win_drop_first": with_views(f"""
        SELECT period, report_type, ct FROM (
            SELECT *, row_number() OVER (PARTITION BY report_type ORDER BY period) AS rn FROM (
                SELECT {_MONTH}, report_type, count(*) AS ct FROM v_reports GROUP BY 1, 2)) WHERE rn > 1""", "v_reports"),
    "sort_nulls_last": with_views(f"""
        SELECT {SCALE}, report_type, count(*) AS ct FROM {_RC} GROUP BY 1, 2
        ORDER BY ct DESC NULLS LAST, {SCALE} ASC NULLS LAST""", "v_reports", "v_named"),
    "sort_top_per_group": with_views("""
        SELECT user_id, report_type, ct FROM (
            SELECT user_id, report_type, count(*) AS ct,
                   row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, report_type) AS rn
            FROM v_reports GROUP BY 1, 2) WHERE rn = 1""", "v_reports"),
    "set_append_tagged": with_views(" UNION ALL ".join(
        f"SELECT '{e}' AS entity, report_type, count(*) AS ct FROM {_RC} "
        + ("" if e == "Total" else f"WHERE {SCALE} = '{e}' ") + "GROUP BY 2" for e in ENTITIES), "v_reports", "v_named"),
    "set_union_distinct": with_views('SELECT user_id FROM v_reports UNION SELECT "user_UUID" FROM v_users',
                                     "v_reports", "v_users"),
    "fn_period_start": """
        SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS "day", date_trunc('week', ts)::TIMESTAMP AS yearweek,
               date_trunc('month', ts)::TIMESTAMP AS "month", date_trunc('quarter', ts)::TIMESTAMP AS "quarter",
               date_trunc('year', ts)::TIMESTAMP AS "year" FROM events""",
    "fn_week_buckets": """
        SELECT date_trunc('week', ts)::TIMESTAMP AS period, event_type, count(*) AS ct FROM events GROUP BY 1, 2""",
    "fn_minutes_between": with_views(
        "SELECT version_uuid, date_diff('minute', upload_date_utc, validation_date_utc) AS m FROM v_reports", "v_reports"),
    "fn_calendar_before": with_views(
        f"SELECT version_uuid FROM v_reports WHERE upload_date_utc >= TIMESTAMP '{AS_OF}' - INTERVAL '6 months'", "v_reports"),
    "fn_within_span": with_views("""
        SELECT version_uuid, validation_date_utc - upload_date_utc <= INTERVAL '30 days' AS a_month,
               validation_date_utc - upload_date_utc <= INTERVAL '360 days' AS a_year,
               validation_date_utc - upload_date_utc <= INTERVAL '14 days' AS two_weeks FROM v_reports""", "v_reports"),
    "fn_months_since": with_views(f"""
        SELECT period, trunc(date_diff('day', DATE '1997-06-01', period::DATE) / 30.0::DOUBLE)::INTEGER AS months
        FROM (SELECT DISTINCT {_MONTH} FROM v_reports)""", "v_reports"),
    "fn_spine_month": _spine_sql("month", "1 MONTH"),
    "fn_spine_day": _spine_sql("day", "1 DAY"),
    "fn_texts": with_views("""
        SELECT version_uuid, strftime(observation_date, '%Y-%m-%d') AS "day", split_part(expert_validation_result, '#', 2) AS code,
               split_part(photo_url, '/', 4) AS file, concat_ws('_', bite_location, type, bite_time) AS key FROM v_records""",
        "v_records"),
    "fn_not_available": with_views("""
        SELECT "UID", "NAME_3" IS NULL OR contains("NAME_3", 'n.a.') AS missing FROM v_areas""", "v_areas"),
    "fn_to_ascii": with_views(
        f'SELECT "UID", {_fold("NAME_0")} AS "NAME_0", {_fold("NAME_3")} AS "NAME_3" FROM v_areas', "v_areas"),
    "fn_numbers": f"""
        SELECT c_custkey, round(CASE WHEN a = 0 OR b = 0 THEN 0 ELSE 2 * a * b / (a + b) END, 6) AS hmean,
               round(greatest(c_acctbal, 0), 6) AS clipped, round({_LOG.format(v='(abs(c_acctbal) / 100)')}, 6) AS damped,
               CASE WHEN c_custkey % 5 > 2 THEN 2 ELSE c_custkey % 5 END AS capped,
               round(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal / (c_custkey % 3) END, 6) AS ratio,
               round(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal / (c_custkey % 3) * 100 ELSE 0 END, 6) AS share,
               round({_SIG.format(x='-30 * (b - 0.5::DOUBLE)')} * ({_SIG.format(x='30 * (a - 0.5::DOUBLE)')}
                     + 0.5::DOUBLE * (1 - {_SIG.format(x='30 * (a - 0.5::DOUBLE)')})), 6) AS p
        FROM (SELECT *, abs(c_acctbal) / 10000 AS a, (c_custkey % 10) / 10.0::DOUBLE AS b FROM customer)""",
    "ts_zero_axis": _user_axis("quarter", "3 MONTH", ", ".join(f"{zero_if_added(t)} AS {t}" for t in TYPES),
                               sql_wide("report_type", TYPES)),
    "ts_null_axis": _user_axis("year", "12 MONTH", "c.ct"),
    "ts_carried_axis": _user_axis(
        "quarter", "3 MONTH", "last_value(c.so_far IGNORE NULLS) OVER (PARTITION BY a.user_id ORDER BY a.period) AS so_far",
        wrap="SELECT user_id, period, sum(ct) OVER (PARTITION BY user_id ORDER BY period)::BIGINT AS so_far FROM base"),
    "ts_zero_everywhere": _user_axis("year", "12 MONTH", ", ".join(f"coalesce(c.{t}, 0) AS {t}" for t in TYPES),
                                     sql_wide("report_type", TYPES)),
    "ts_padded_categories": with_views(f"""
        SELECT {SCALE}, count(*) FILTER (labels = 'culex') AS culex, count(*) FILTER (labels = 'albopictus') AS albopictus,
               0::BIGINT AS aegypti, count(*) FILTER (labels = 'not-sure') AS "not-sure" FROM {_RC} GROUP BY 1""",
        "v_reports", "v_named"),
    "sink_entity_extract": with_views(f"""
        SELECT version_uuid, user_id, upload_date_utc, report_type, labels FROM v_reports WHERE version_uuid IN (
            SELECT version_uuid FROM v_named WHERE {SCALE} = '{BUSY}')""", "v_reports", "v_named"),
    "sink_records_by_day": with_views("""
        SELECT strftime(period, '%Y-%m-%d') AS period, '{"adult":' || coalesce(adult::VARCHAR, 'null') || ',"bite":'
               || coalesce(bite::VARCHAR, 'null') || ',"site":' || coalesce(site::VARCHAR, 'null') || '}' AS record FROM t""",
        "v_reports", extra={
            "counts": f"SELECT {_MONTH}, {sql_wide('report_type', TYPES)} FROM v_reports GROUP BY 1",
            "t": sql_axis("counts", {t: zero_if_added(t) for t in TYPES}, "month")}),
    "sink_retention_exports": with_views(
        " UNION ALL ".join(
            f"SELECT '{e}' AS entity, '{t or 'all'}' AS report_type, * FROM ("
            + sql_axis(f"r{i}{t}", {"user_retention": f"round({zero_if_added('user_retention')}, 6)"}, "month") + ")"
            for i, e in enumerate(ENTITIES) for t in ("", "adult", "bite")), "v_reports", "v_named",
        extra={f"r{i}{t}": _retention_cte(
            "WHERE TRUE" + ("" if e == "Total" else f" AND {SCALE} = '{e}'") + (f" AND report_type = '{t}'" if t else ""))
            for i, e in enumerate(ENTITIES) for t in ("", "adult", "bite")}),
}
ORACLE["sink_coverage_exports"] = " UNION ALL ".join(
    f"SELECT '{e}' AS entity, * FROM ({_coverage_sql(SCALE, 'code_gadm', 'v_gadm', e, 'week')})" for e in ENTITIES)
