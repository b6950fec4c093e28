"""Spatial features, quality, competence and behaviour labels of users."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import (
    ARCHETYPES_2, LOW_ACCURACY_SPECIES, TARGET_SPECIES, archetype, target_species_flag,
)
from ..functions.geodesy import utm_zone, valid_point, with_utm
from ..functions.numeric import capped, clip_at_zero, damped_log, harmonic_mean, percent, ratio
from ..functions.periods import months_since
from ..operators.density import cluster_counts, density_clusters
from ..operators.filters import TOTAL, during, only_entity, only_type
from ..operators.tables import counts_by, join_hot, top_one, wide_counts, with_scale
from ..operators.timeseries import regular
from ..session import cut_lineage
from .participation import labelled_inflow_long

HQ = [a for a in ARCHETYPES_2 if a.startswith("HQ-")]
LQ = [a for a in ARCHETYPES_2 if a.startswith("LQ-")]


def _centres(points: DataFrame, user: str) -> DataFrame:
    """UTM zone of the mean position of each user."""
    return points.groupBy(user).agg(F.avg("lon").alias("m_lon"), F.avg("lat").alias("m_lat")).select(
        user, utm_zone(F.col("m_lon")).alias("zone"), (F.col("m_lat") < 0).alias("south"))


def projected(points: DataFrame, user: str = "user_id") -> DataFrame:
    """Valid points in metres, each user in the UTM zone of their mean position."""
    valid = points.filter(valid_point(F.col("lon"), F.col("lat")))
    return with_utm(join_hot(valid, _centres(points, user), [user]), F.col("zone"), F.col("south")).drop("zone", "south")


def dispersion(x: Column, y: Column) -> Column:
    """Standard distance from the mean centre; equal to the root mean squared displacement."""
    return F.sqrt(F.var_pop(x) + F.var_pop(y))


def bounding_box(points: DataFrame, *keys: str) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.min("lon").alias("min_x"), F.min("lat").alias("min_y"), F.max("lon").alias("max_x"), F.max("lat").alias("max_y"))


def nano_mean(degrees: str) -> Column:
    """Mean of a coordinate of weighted positions from whole billionths of a degree: the same for any order of the rows."""
    whole = F.round(F.col(degrees) * 1e9).cast("decimal(20,0)") * F.col("n")
    return F.sum(whole).cast("double") / (F.sum(F.when(F.col(degrees).isNotNull(), F.col("n"))) * F.lit(1e9))


def _weighted_mean(value: str, weight: Column) -> Column:
    return F.try_divide(F.sum(F.col(value) * weight), F.sum(F.when(F.col(value).isNotNull(), weight)))


def weighted_dispersion(dx: str, dy: str, n: str = "n") -> Column:
    """:func:`dispersion` of weighted positions, given relative to a place near their centre."""
    total = F.sum(n)
    square = F.sum(F.expr(f"{n} * ({dx} * {dx} + {dy} * {dy})")) / total
    return F.sqrt(F.greatest(square - F.pow(F.sum(F.expr(f"{n} * {dx}")) / total, 2) - F.pow(F.sum(F.expr(f"{n} * {dy}")) / total, 2),
                             F.lit(0.0)))


def user_features(reports: DataFrame, report_type: str | None = None, min_samples: int = 5,
                  eps: float = 100.0) -> DataFrame:
    """Spatial features of every user, from all users' reports at once.

    Users with one report have a point count only. Clusters are counted for users with
    at least `min_samples` reports: null below, 0 when all points are noise.
    """
    points = only_type(reports, report_type).select("user_id", "lon", "lat")
    ok = valid_point(F.col("lon"), F.col("lat"))
    # reports at one position are one row with a count from here on
    places = points.groupBy("user_id", "lon", "lat").agg(F.count("*").alias("n"))
    valid = F.when(ok, F.col("n"))
    basic = places.groupBy("user_id").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(valid), F.lit(0)).alias("valid"),
        nano_mean("lon").alias("m_lon"), nano_mean("lat").alias("m_lat"),
        _weighted_mean("lon", F.col("n")).alias("z_lon"), _weighted_mean("lat", F.col("n")).alias("z_lat"),
        F.try_divide(F.sum(F.col("lon") * valid), F.sum(valid)).alias("v_lon"),
        F.try_divide(F.sum(F.col("lat") * valid), F.sum(valid)).alias("v_lat"))
    basic = cut_lineage(basic)
    zone, south = utm_zone(F.col("z_lon")), F.col("z_lat") < 0
    centre = with_utm(basic.select("user_id", "rows", zone.alias("zone"), south.alias("south"), "v_lon", "v_lat"),
                      F.col("zone"), F.col("south"), "v_lon", "v_lat")
    centre = centre.select("user_id", "rows", "zone", "south", F.col("x").alias("cx"), F.col("y").alias("cy"))
    metres = with_utm(join_hot(places.filter(ok), centre, ["user_id"]), F.col("zone"), F.col("south"))
    # read by the spread and by the clusters
    metres = cut_lineage(metres.select("user_id", "rows", "n", "x", "y", (F.col("x") - F.col("cx")).alias("dx"),
                                       (F.col("y") - F.col("cy")).alias("dy")))
    spread = metres.groupBy("user_id").agg(weighted_dispersion("dx", "dy").alias("spread"))
    busy = metres.filter(F.col("rows") >= min_samples).select("user_id", "x", "y", "n")
    clusters = cluster_counts(density_clusters(busy, ["user_id"], eps, min_samples, "n"), ["user_id"])
    several = F.col("rows") > 1
    return basic.join(spread, "user_id", "left").join(clusters, "user_id", "left").select(
        "user_id",
        F.when(several, F.col("valid")).otherwise(F.col("rows")).alias("n_points"),
        F.when(several, F.col("rows") - F.col("valid")).otherwise(F.lit(0)).alias("n_invalid_points"),
        F.when(several, F.array("m_lon", "m_lat")).alias("mean_latlon"),
        F.when(several, F.col("spread")).alias("std_utm"),
        F.when(several, F.col("spread")).alias("msd_utm"),
        "n_random_points", "n_clusters",
    )


def user_quality(reports: DataFrame, codes: DataFrame, scale: str = "name_gadm_level0",
                 report_type: str | None = None) -> DataFrame:
    """Report quality per user and the area most of the user's reports come from.

    The main area has the most reports; ties go to the first name, unknown areas last.
    """
    located = with_scale(only_type(reports, report_type).select("version_uuid", "user_id"), codes, scale)
    home = top_one(counts_by(located, "user_id", scale), ["user_id"], [("ct", True)], [scale])
    adults = reports.filter((F.col("report_type") == "adult") & (F.col("labels") != "unvalidated"))
    scores = adults.groupBy("user_id").agg(
        F.count("*").alias("n_reports"),
        F.sum(target_species_flag(F.col("labels"))).alias("target"), F.sum("confidence").alias("conf"))
    return scores.join(home, "user_id", "left").select(
        "user_id", scale, "n_reports", ratio(F.col("target"), F.col("n_reports")).alias("quality_target"),
        ratio(F.col("conf"), F.col("n_reports")).alias("quality_reports"))


def user_profiles(quality: DataFrame, features: DataFrame, scale: str = "name_gadm_level0",
                  entity: str = TOTAL) -> DataFrame:
    """Quality with the spatial features of the same user."""
    return only_entity(quality.join(features, "user_id", "left"), scale, entity)


# Competence --------------------------------------------------------------------

def judged_answers(survey: DataFrame, reports: DataFrame) -> DataFrame:
    """Survey labels next to the experts' label of validated adult reports of the surveyed species."""
    known = reports.filter((F.col("report_type") == "adult") & F.col("validated")
                           & F.col("labels").isin(TARGET_SPECIES)).select("version_uuid", "user_id", "labels")
    return survey.filter(F.col("cs_labels").isNotNull()).join(known, "version_uuid").select(
        "version_uuid", "user_id", "cs_labels", "labels", (F.col("cs_labels") == F.col("labels")).alias("coincidence"))


def classification_report(judged: DataFrame, truth: str = "labels", guess: str = "cs_labels") -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted means.

    Everything after the confusion counts runs on one row per pair of classes.
    """
    confusion = counts_by(judged, truth, guess, name="n")
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(zero)
    sides = confusion.select(F.explode(F.array(
        F.struct(F.col(truth).alias("class"), F.col("n").alias("true"), zero.alias("guessed"), hit.alias("hits")),
        F.struct(F.col(guess).alias("class"), zero.alias("true"), F.col("n").alias("guessed"), zero.alias("hits")),
    )).alias("s")).select("s.*")
    per = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("true", "guessed", "hits")])
    precision = F.coalesce(ratio(F.col("hits"), F.col("guessed")), F.lit(0.0))
    recall = F.coalesce(ratio(F.col("hits"), F.col("true")), F.lit(0.0))
    per = per.select("class", "hits", precision.alias("precision"), recall.alias("recall"), F.col("true").alias("support"))
    per = per.withColumn("f1", F.coalesce(
        F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    measures = ["precision", "recall", "f1"]
    means = per.agg(
        F.sum("support").alias("support"), ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in measures])
    summary = means.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), *[F.col("accuracy").alias(m) for m in measures], "support"),
        F.struct(F.lit("macro avg").alias("class"), *[F.col(f"macro_{m}").alias(m) for m in measures], "support"),
        F.struct(F.lit("weighted avg").alias("class"), *[F.col(f"weighted_{m}").alias(m) for m in measures], "support"),
    )).alias("s")).select("s.*")
    return per.select("class", *measures, "support").unionByName(summary)


def chance_agreement(judged: DataFrame, truth: str = "labels") -> DataFrame:
    """Observed agreement, agreement by chance and Scott's π against the true labels (one row)."""
    per = judged.groupBy(truth).agg(F.count("*").alias("n"), F.count(F.when(F.col("coincidence"), 1)).alias("hits"))
    sums = per.agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    po, pe = ratio(F.col("hits"), F.col("n")), F.col("squares") / (F.col("n") * F.col("n"))
    return sums.select(po.alias("po"), pe.alias("pe"), F.try_divide(po - pe, 1 - pe).alias("chance_adj_accuracy"))


def user_accuracy(judged: DataFrame) -> DataFrame:
    """Accuracy of each user's survey answers, also adjusted by the chance agreement of all answers."""
    chance = chance_agreement(judged).select("pe").scalar()
    per_user = judged.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count("*").alias("accuracy_support"), F.avg(F.col("coincidence").cast("int")).alias("accuracy"))
    return per_user.withColumn("accuracy_chance_adj", F.try_divide(F.col("accuracy") - chance, 1 - chance))


def low_accuracy_share(survey: DataFrame) -> DataFrame:
    """Percent of survey labels that are missing or of a species users often get wrong."""
    weak = F.col("cs_labels").isin(LOW_ACCURACY_SPECIES) | F.col("cs_labels").isNull()
    return survey.agg((F.count(F.when(weak, 1)) * 100.0 / F.count("*")).alias("perc_low_accuracy"))


# Profiles ----------------------------------------------------------------------

def quality_features(profiles: DataFrame, accuracy: DataFrame, with_accuracy: bool = True) -> DataFrame:
    """Profiles with the share of adult reports, survey accuracy and the overall quality."""
    out = profiles.join(accuracy.select("user_id", "accuracy", "accuracy_chance_adj"), "user_id", "left")
    out = out.withColumn("adults_ratio", ratio(F.col("n_reports"), F.col("n_points"))).withColumn(
        "accuracy_chance_adj_pos", clip_at_zero(F.col("accuracy_chance_adj")))
    base = harmonic_mean(F.col("adults_ratio"), F.col("quality_target"))
    quality = (base + F.col("accuracy_chance_adj_pos")) / 2 if with_accuracy else base
    return out.withColumn("quality", quality)


def with_archetypes(profiles: DataFrame, spread_limit: float = 1000.0, quality_limit: float = 2.0 / 3) -> DataFrame:
    """Behaviour labels at three levels: clusters only, with quality, with quality and spread."""
    levels = {1: (None, None), 2: (None, quality_limit), 3: (spread_limit, quality_limit)}
    return profiles.select("*", *[
        archetype(F.col("n_clusters"), F.col("std_utm"), F.col("quality"), s, q).alias(f"custom_labels_{i}")
        for i, (s, q) in levels.items()])


def distance_features(labelled: DataFrame) -> DataFrame:
    """Inputs of the user distance: damped log of the spread, capped clusters; sporadic users left out."""
    rows = labelled.filter(F.col("custom_labels_3") != "sporadic")
    return rows.select(
        "user_id", F.coalesce(damped_log(F.col("std_utm")), F.lit(0.0)).alias("log_std_utm"),
        capped(F.col("n_clusters"), 2).alias("type_clusters"), "custom_labels_1",
        F.coalesce("quality", F.lit(0.0)).alias("quality"))


def mean_by_motivation(labelled: DataFrame, metric: str = "quality") -> DataFrame:
    """Mean of a metric for sporadic and for motivated users."""
    group = F.when(F.col("custom_labels_1") == "sporadic", "sporadic").otherwise("motivated")
    return labelled.groupBy(group.alias("users")).agg(F.avg(metric).alias("mean"), F.count("*").alias("n"))


def campaign_covariates(reports: DataFrame, users: DataFrame, campaigns: Mapping[str, str],
                        start: str | None = "2021-01-01", transform: str = "percentage",
                        label: str = "custom_labels_2", labels: Sequence[str] = tuple(ARCHETYPES_2),
                        scale: str = "name_gadm_level0") -> DataFrame:
    """Monthly shares of labelled users per country, with the months since its campaign.

    All countries come from one grouped pass. `transform` is 'percentage' (row shares)
    or 'raw' (counts, with sporadic and low-to-all quality ratios).
    """
    if transform not in ("percentage", "raw"):
        raise ValueError(f"unknown transform {transform!r}")
    chosen = users.filter(F.col(scale).isin(list(campaigns)))
    long = labelled_inflow_long(reports, chosen, label, "month", by=[scale])
    wide = long.groupBy(scale, "period").agg(*wide_counts(F.col(label), labels, F.col("ct")))
    full = regular(wide, "month", by=[scale], fill=0)

    def total(names: Sequence[str]) -> Column:
        out = F.lit(0).cast("bigint")
        for n in names:
            out = out + F.coalesce(F.col(n), F.lit(0))
        return out

    everything = total(labels)
    if transform == "percentage":
        def share(names: Sequence[str]) -> Column:
            return F.coalesce(percent(total(names), everything), F.lit(0.0))
        values = [share(HQ).alias("HQ_users"), share(LQ).alias("LQ_users"), share(["sporadic"]).alias("sporadic")]
    else:
        values = [ratio(total(["sporadic"]), everything).alias("sporadic"),
                  ratio(total(LQ), total([*LQ, *HQ])).alias("LQ2HQ_users")]
    since = F.lit(None).cast("timestamp_ntz")
    for country, day in campaigns.items():
        since = F.when(F.col(scale) == country, F.lit(day).cast("timestamp_ntz")).otherwise(since)
    table = full.select(F.col("period").alias("date"), F.col(scale).alias("country"),
                        months_since(F.col("period"), since).alias("time_since_campaign"), *values)
    return during(table, "date", start)
