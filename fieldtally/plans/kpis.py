"""Report indicators by period, spatial scale and entity.

Every function takes DataFrames and returns a lazy DataFrame. `reports` has one row per
report; `codes` one row per coded report with the names of its areas.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import DENSITY_CLASSES, REPORT_TYPES
from ..functions.numeric import iqr, or_zero, percent, ratio
from ..functions.periods import minutes_between, period_start
from ..operators.filters import TOTAL, at_least, named, only_type
from ..operators.tables import counts_by, entity_tags, pivot_counts, wide_counts, with_scale, within_entity
from ..operators.timeseries import of_all, regular, running_total

# Legend table and code column of each spatial scale.
SCALE_LEGENDS = {
    "name_gadm_level0": ("gadm", "code_gadm"),
    "name_gadm_level1": ("gadm", "code_gadm"),
    "name_gadm_level2": ("gadm", "code_gadm"),
    "name_gadm_level3": ("gadm", "code_gadm"),
    "name_gadm_level4": ("gadm", "code_gadm"),
    "name_climate_regions": ("climate_regions", "code_climate_regions"),
    "name_biome": ("ecoregions", "code_biome"),
    "name_ecoregions": ("ecoregions", "code_ecoregions"),
}

MINUTES_PER_DAY = 24 * 60


def entity_options(codes: DataFrame, scale: str, reports: DataFrame | None = None,
                   minimum: int | None = None) -> DataFrame:
    """Selectable entities with their position: 'Total' first, then the names in order.

    Without `minimum`, null names are no entity; with it, only entities with that many reports.
    """
    if minimum is None:
        names = codes.select(F.col(scale).alias("entity")).filter(F.col("entity").isNotNull()).distinct()
    else:
        names = at_least(rank(reports, codes, scale), "total", minimum).select(F.col(scale).alias("entity"))
    total = codes.sparkSession.range(1).select(F.lit(TOTAL).alias("entity"), F.lit(0).alias("_rank"))
    return (
        names.withColumn("_rank", F.lit(1)).unionByName(total)
        .orderBy("_rank", F.asc_nulls_last("entity")).select("entity")
    )


def label_shares(reports: DataFrame, codes: DataFrame, scale: str, report_type: str = "adult",
                 entity: str = TOTAL) -> DataFrame:
    """Reports per label and their share; the share counts unlabelled reports, the table does not list them."""
    rows = within_entity(only_type(reports, report_type), codes, scale, entity)
    counts = counts_by(rows, "labels")
    shares = counts.withColumn("perc_ct", percent(F.col("ct"), of_all(F.sum("ct"))))
    return shares.filter(F.col("labels").isNotNull()).orderBy(F.desc("perc_ct"), "labels")


def label_series(reports: DataFrame, codes: DataFrame, scale: str, report_type: str = "adult",
                 entity: str = TOTAL, freq: str = "month", labels: Sequence[str] | None = None,
                 check_entity: bool = True) -> DataFrame:
    """Reports per observation period, one column per label (all found ones, or those given)."""
    if check_entity and entity != TOTAL and codes.filter(F.col(scale) == F.lit(entity)).isEmpty():
        raise ValueError(f"{entity!r} is not an entity of {scale}")
    rows = within_entity(only_type(reports, report_type), codes, scale, entity)
    dated = rows.select(period_start(F.col("observation_date_utc"), freq).alias("period"), "labels")
    return regular(pivot_counts(dated, "period", "labels", labels), freq, fill=0)


def rank(reports: DataFrame, codes: DataFrame, scale: str) -> DataFrame:
    """Reports per entity and type, with the total, largest first."""
    rows = named(with_scale(reports.select("version_uuid", "report_type"), codes, scale), scale)
    wide = rows.groupBy(scale).agg(*wide_counts(F.col("report_type"), REPORT_TYPES), F.count("*").alias("total"))
    return wide.orderBy(F.desc("total"), scale)


def publication_delay(reports: DataFrame, codes: DataFrame, scale: str, entity: str = TOTAL,
                      freq: str = "month") -> DataFrame:
    """Quartiles of the days from upload to validation, by upload period; adults only.

    Delays are whole minutes, so they are counted per distinct value first: the exact
    percentile then sees one weighted row per value instead of one per report.
    """
    rows = within_entity(only_type(reports, "adult"), codes, scale, entity)
    delays = rows.filter(F.col("validation_date_utc").isNotNull()).select(
        period_start(F.col("upload_date_utc"), freq).alias("period"),
        minutes_between(F.col("upload_date_utc"), F.col("validation_date_utc")).alias("minutes"),
    )
    histogram = counts_by(delays.filter("minutes >= 0"), "period", "minutes", name="n")
    quartiles = histogram.groupBy("period").agg(
        F.percentile("minutes", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q")
    )
    days = quartiles.select("period", *[
        (F.col("q")[i] / MINUTES_PER_DAY).alias(name) for i, name in enumerate(("perc25", "median", "perc75"))
    ])
    return regular(days, freq)


def inflow(reports: DataFrame, codes: DataFrame, scale: str, entity: str = TOTAL, freq: str = "month",
           types: Sequence[str] = tuple(REPORT_TYPES)) -> DataFrame:
    """Reports per upload period, one column per type."""
    rows = within_entity(reports, codes, scale, entity)
    dated = rows.select(period_start(F.col("upload_date_utc"), freq).alias("period"), "report_type")
    return regular(pivot_counts(dated, "period", "report_type", types), freq, fill=0)


def backlog(reports: DataFrame, codes: DataFrame, scale: str, entity: str = TOTAL,
            freq: str = "month") -> DataFrame:
    """Adult reports uploaded but not yet validated, accumulated over upload periods.

    Uploads and validations are two events of the same scan, counted in one grouping;
    validations that fall in a period without any upload are left out.
    """
    rows = within_entity(only_type(reports, "adult"), codes, scale, entity)
    uploaded = F.struct(
        period_start(F.col("upload_date_utc"), freq).alias("period"),
        F.lit(1).cast("bigint").alias("ins"), F.lit(0).cast("bigint").alias("outs"),
    )
    checked = F.struct(
        F.when(F.col("validated"), period_start(F.col("validation_date_utc"), freq)).alias("period"),
        F.lit(0).cast("bigint").alias("ins"), F.lit(1).cast("bigint").alias("outs"),
    )
    moves = rows.select(F.explode(F.array(uploaded, checked)).alias("e")).select("e.*")
    net = (
        moves.filter(F.col("period").isNotNull()).groupBy("period")
        .agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs")).filter("ins > 0")
    )
    total = net.select("period", running_total(F.col("ins") - F.col("outs")).alias("ct_acc"))
    return regular(total, freq, carry=["ct_acc"])


def coverage_by_entity(effort: DataFrame, pixels: DataFrame, legend: DataFrame, scale: str,
                       entities: Sequence[str], freq: str = "month") -> DataFrame:
    """Visited cells as percent of the pixels of each density class, by entity and period.

    Cells are reduced to one row per period first, and both sides are counted by code
    before the legend comes in, so the join runs on counts. A legend with several rows
    per code multiplies its counts, as a row-level join would.
    """
    code = SCALE_LEGENDS[scale][1]
    names = legend.select(code, scale)
    visits = effort.filter(F.col("n_participants") >= 1).select(
        "lonlat_id", period_start(F.col("date_utc"), freq).alias("period"), "human_presence_discr", code
    )
    one = visits.groupBy("lonlat_id", "period").agg(
        F.min(F.struct("human_presence_discr", code)).alias("v")
    ).select("period", "v.*")

    def counted(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        by_code = counts_by(rows, *keys, code, name="n").join(names, code, "left")
        return by_code.withColumn("entity", F.explode(entity_tags(scale, entities))).groupBy("entity", *keys).agg(
            F.sum("n").alias(name))

    visited = counted(one, ["period", "human_presence_discr"], "ct")
    present = counted(pixels, ["human_presence_discr"], "ct_tot")
    share = visited.join(present, ["entity", "human_presence_discr"], "left").withColumn(
        "p", percent(F.col("ct"), F.col("ct_tot")))
    wide = share.groupBy("entity", "period").agg(
        *wide_counts(F.col("human_presence_discr"), DENSITY_CLASSES, F.col("p")))
    full = regular(wide, freq, by=["entity"])
    return full.select("entity", "period", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in DENSITY_CLASSES])


def sampling_coverage(effort: DataFrame, pixels: DataFrame, legend: DataFrame, scale: str,
                      entity: str = TOTAL, freq: str = "month") -> DataFrame:
    """`coverage_by_entity` of one entity."""
    return coverage_by_entity(effort, pixels, legend, scale, [entity], freq).drop("entity")


def headline(inflow_table: DataFrame, activity_table: DataFrame) -> DataFrame:
    """Totals of reports by type and of users, with new and active users as percent of the registered ones."""
    users = ["registered", "new", "active"]
    rows = inflow_table.select(*REPORT_TYPES).unionByName(activity_table.select(*users), allowMissingColumns=True)
    totals = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*REPORT_TYPES, *users]])
    return totals.select(
        "*",
        percent(F.col("new"), F.col("registered")).alias("new_of_registered"),
        percent(F.col("active"), F.col("registered")).alias("active_of_registered"),
    )


def ranking_table(rank_table: DataFrame, activity_rank_table: DataFrame, scale: str) -> DataFrame:
    """Reports and users per entity side by side, missing counts as 0."""
    both = rank_table.join(activity_rank_table, scale, "full_outer")
    return both.select(scale, *[or_zero(F.col(c)).cast("bigint").alias(c) for c in both.columns if c != scale])


def monitoring_table(backlog_table: DataFrame, delay_table: DataFrame) -> DataFrame:
    """Backlog and delay per period, with the interquartile range."""
    both = backlog_table.join(delay_table, "period", "full_outer")
    return both.withColumn("iqr", iqr(F.col("perc75"), F.col("perc25"))).select(
        "period", "ct_acc", "perc75", *[F.round(c, 2).alias(c) for c in ("median", "perc25", "iqr")]
    )


def period_shares(counts: DataFrame, category: str, value: str = "ct", period: str = "period") -> DataFrame:
    """Share of each category within its period, percent; 0/0 is 0."""
    total = of_all(F.sum(value), by=[period])
    return counts.withColumn("share", F.coalesce(ratio(F.col(value), total) * 100, F.lit(0.0)))
