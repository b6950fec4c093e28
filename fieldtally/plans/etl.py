"""Extraction and cleaning jobs: raw tables in, analysis tables out."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, text
from ..operators.filters import differs, from_known_app, geolocated
from ..operators.fuzzy import best_match
from ..operators.spatial import assign_layers, sample_pixels
from ..operators.tables import append, overwrite_where_known, top_one, unseen
from ..sources.tables import read_parquet, write_parquet

# Last test version of the own app, first day of the campaign, note of test reports.
LAST_TEST_VERSION, CAMPAIGN_START, TEST_NOTE = 3, "2014-06-24", "#345"

REPORT_COLUMNS = [
    "version_uuid", "user_id", "observation_date_utc", "upload_date_utc", "validation_date_utc", "validated",
    "lat", "lon", "labels", "report_type", "confidence", "best_photo_filename",
]


def extract_reports(records: DataFrame, uploads: DataFrame, annotations: DataFrame, app: str) -> DataFrame:
    """Raw reports: map records with their upload and the last completed annotation.

    `app` is the package name of the own app. The conditions on the upload make its
    join an inner one.
    """
    last = annotations.filter(F.col("validation_complete") & F.col("category_id").isNotNull()).groupBy(
        F.col("report_id").alias("version_uuid")).agg(F.max("last_modified").alias("max_last_modified"))
    kept = uploads.filter(
        from_known_app(F.col("package_name"), F.col("package_version"), F.col("creation_time"),
                       F.col("version_number"), app, LAST_TEST_VERSION, CAMPAIGN_START)
        & differs(F.col("note"), F.lit(TEST_NOTE)) & differs(F.col("note"), F.lit(TEST_NOTE + "\n"))
    ).select(F.col("version_UUID").alias("version_uuid"), "user_id", "server_upload_time", "hide")
    return records.join(kept, "version_uuid").join(last, "version_uuid", "left").select(
        "version_uuid", "user_id", "server_upload_time", "observation_date", "max_last_modified", "lat", "lon",
        "ref_system", F.col("type").alias("report_type"), "simplified_expert_validation_result",
        text.path_part(F.col("expert_validation_result"), "#", 2).alias("expert_validation_confidence"),
        "expert_validated", "n_photos", text.path_part(F.col("photo_url"), "/", 4).alias("best_photo_filename"),
        "bite_count", "bite_location", "bite_time", "storm_drain_status", "visible", "hide",
    )


def extract_sampling_effort(fixes: DataFrame) -> DataFrame:
    """Distinct devices per masked position and day; the position is kept as text with three decimals."""
    placed = fixes.select(
        text.fixed_decimals(F.col("masked_lon")).alias("lon"), text.fixed_decimals(F.col("masked_lat")).alias("lat"),
        F.col("server_upload_time").cast("timestamp_ntz").cast("date").cast("timestamp_ntz").alias("date_utc"),
        "user_coverage_uuid")
    daily = placed.groupBy("lon", "lat", "date_utc").agg(
        F.count_distinct("user_coverage_uuid").cast("int").alias("n_participants"))
    return daily.select(text.joined_key(F.col("lon"), F.col("lat")).alias("lonlat_id"), "*")


def decoded_reports(raw: DataFrame) -> DataFrame:
    """Geolocated reports with label, confidence, severity, container type and typed dates."""
    return geolocated(raw).select(
        "*",
        classify.report_label(F.col("simplified_expert_validation_result"), F.col("expert_validated"), F.col("hide"))
        .alias("labels"),
        classify.confidence_score(F.col("expert_validation_confidence")).alias("confidence"),
        classify.bite_severity(F.col("bite_count")).alias("bite_severity"),
        classify.storm_drain_type(F.col("storm_drain_status")).alias("storm_drain_type"),
        F.col("observation_date").cast("timestamp_ntz").alias("observation_date_utc"),
        F.col("server_upload_time").cast("timestamp_ntz").alias("upload_date_utc"),
        F.col("max_last_modified").cast("timestamp_ntz").alias("validation_date_utc"),
        F.col("expert_validated").cast("boolean").alias("validated"),
    ).drop("observation_date", "server_upload_time", "max_last_modified", "expert_validated",
           "simplified_expert_validation_result", "storm_drain_status")


def clean_reports(raw: DataFrame) -> DataFrame:
    """Analysis table of reports: adults with a photo, bites (labelled by place) and sites.

    The three kinds differ in a few columns only, so they are told apart within one
    scan rather than stacked from three. Only adults keep a validation date.
    """
    adult, bite = F.col("report_type") == "adult", F.col("report_type") == "bite"
    kept = decoded_reports(raw).filter(
        (adult & (F.col("n_photos") > 0)) | F.col("report_type").isin("bite", "site"))
    return kept.withColumn("labels", F.when(bite, F.col("bite_location")).otherwise(F.col("labels"))).withColumn(
        "validation_date_utc", F.when(adult, F.col("validation_date_utc"))).select(*REPORT_COLUMNS)


def clean_app_users(raw: DataFrame) -> DataFrame:
    typed = raw.select("*", F.col("registration_time").cast("timestamp_ntz").alias("registration_time_utc"),
                       F.col("last_score_update").cast("timestamp_ntz").alias("last_score_update_utc"))
    return typed.drop("registration_time", "last_score_update").orderBy(F.asc_nulls_last("registration_time_utc"))


def valid_pixels(pixels: DataFrame) -> DataFrame:
    """Pixels with data in every band: presence 0 is data, code 0 is not."""
    return pixels.filter((F.col("human_presence") >= 0) & (F.col("code_gadm") != 0)
                         & (F.col("code_climate_regions") != 0) & (F.col("code_ecoregions") != 0))


def raster_bands(pixels: DataFrame, no_data: int = -1) -> DataFrame:
    """Bands with missing data set to one marker: negative presence, code 0."""
    marked = {c: F.when(F.col(c) == 0, no_data).otherwise(F.col(c))
              for c in ("code_gadm", "code_climate_regions", "code_ecoregions")}
    marked["human_presence"] = F.when(F.col("human_presence") < 0, float(no_data)).otherwise(F.col("human_presence"))
    return pixels.withColumns(marked)


def with_biome(df: DataFrame, ecoregions: DataFrame) -> DataFrame:
    """Biome of each row's ecoregion; the legend has one row per ecoregion."""
    return df.join(ecoregions.select("code_ecoregions", "code_biome"), "code_ecoregions", "left")


def human_presence(pixels: DataFrame, ecoregions: DataFrame) -> DataFrame:
    """Valid pixels with biome and density class."""
    bands = ["human_presence", "code_gadm", "code_climate_regions", "code_ecoregions"]
    return with_biome(valid_pixels(pixels).select(*bands), ecoregions).select(
        *bands, "code_biome", classify.density_class(F.col("human_presence")).alias("human_presence_discr"))


def sampling_effort(effort: DataFrame, pixels: DataFrame, ecoregions: DataFrame,
                    x0: float, y0: float, size: float) -> DataFrame:
    """Sampling effort with the codes and density class of the pixel below; invalid pixels drop out."""
    bands = ["human_presence", "code_gadm", "code_climate_regions", "code_ecoregions"]
    values = with_biome(valid_pixels(pixels).select("ix", "iy", *bands), ecoregions)
    sampled = sample_pixels(effort, values, x0, y0, size, F.col("lon").cast("double"), F.col("lat").cast("double"))
    return sampled.select(*effort.columns, *bands, "code_biome",
                          classify.density_class(F.col("human_presence")).alias("human_presence_discr"))


def survey_scores(responses: DataFrame) -> DataFrame:
    """Weight of each species per report, from the answers about body parts."""
    answers = responses.filter(F.col("question_id") == 7).select(
        "version_uuid", classify.survey_label(F.col("answer_id")).alias("answer"))
    parts = answers.select("version_uuid", text.path_part(F.col("answer"), "_", 2).alias("cs_labels"),
                           text.path_part(F.col("answer"), "_", 1).alias("part"))
    return parts.groupBy("version_uuid", "cs_labels").agg(
        F.sum(classify.part_weight(F.col("part"))).alias("weight"))


def survey_labels(responses: DataFrame) -> DataFrame:
    """Species named by the survey of each report: the heaviest one, or the common ones answered directly.

    Weights are compared at twelve decimals: the order of a sum must not decide a tie.
    """
    scored = survey_scores(responses).withColumn("weight", F.round("weight", 12))
    invasive = top_one(scored, ["version_uuid"], [("weight", True)], ["cs_labels", "weight"])
    direct = F.col("answer_id") == 62
    common = responses.filter(F.col("answer_id").isin(62, 64)).select(
        "version_uuid", F.when(direct, "culex").alias("cs_labels"), F.when(direct, 1.0).alias("weight"))
    return append([invasive, common]).distinct()


def ecoregion_legend(layer: DataFrame) -> DataFrame:
    """One row per ecoregion, by code; the first name in order stays."""
    return layer.select(
        F.col("ECO_ID").cast("int").alias("code_ecoregions"), F.col("ECO_NAME").alias("name_ecoregions"),
        F.col("BIOME").cast("int").alias("code_biome"), F.col("biomes_lab").alias("name_biome"),
    ).groupBy("code_ecoregions").agg(
        F.min(F.struct("name_ecoregions", "code_biome", "name_biome")).alias("v")
    ).select("code_ecoregions", "v.*").orderBy("code_ecoregions")


def area_legend(areas: DataFrame, levels: int = 5, ascii_names: bool = True) -> DataFrame:
    """Path names of administrative areas, most specific level first, one column per level."""
    name = {i: (text.to_ascii(F.col(f"NAME_{i}")) if ascii_names else F.col(f"NAME_{i}")) for i in range(levels)}
    plain = areas.select(F.col("UID").cast("string").alias("code_gadm"), *[name[i].alias(f"n{i}") for i in range(levels)])
    return plain.select("code_gadm", *[
        text.path_name([F.col(f"n{j}") for j in range(i, -1, -1)]).alias(f"name_gadm_level{i}") for i in range(levels)])


def province_gaps(areas: DataFrame, municipalities: DataFrame, country: str = "Spain") -> DataFrame:
    """Provinces of the areas that the municipality table does not know (should be empty)."""
    known = municipalities.select(F.col("provincia").alias("NAME_2")).distinct()
    return areas.filter(F.col("NAME_0") == country).select("NAME_2").distinct().join(known, "NAME_2", "left_anti")


def matched_municipalities(areas: DataFrame, municipalities: DataFrame, country: str = "Spain",
                           cutoff: float = 0.9, score: str = "ratio") -> DataFrame:
    """Municipality table with the best matching area name of the same province.

    A municipality name that occurs in several provinces is looked up in the first one.
    """
    rows = municipalities.select(F.col("municipio_v2").alias("name"), "provincia", "comarca")
    home = rows.groupBy("name").agg(F.min("provincia").alias("block"))
    names = areas.filter(F.col("NAME_0") == country).select(F.col("NAME_2").alias("block"), F.col("NAME_4").alias("name"))
    found = best_match(home.select("block", "name"), names, cutoff, score).select("name", "match", "score")
    return rows.join(found, "name", "left").select(
        F.col("name").alias("municipio_v2"), "provincia", "comarca", F.col("match").alias("municipio_gadm"), "score")


def corrected_areas(areas: DataFrame, municipalities: DataFrame, country: str = "Spain",
                    cutoff: float = 0.9, score: str = "ratio") -> DataFrame:
    """Areas of one country with level-3 names replaced by the county of the municipality table.

    Counties are found by province and best matching municipality name. Areas without
    a county keep the name they have.
    """
    matched = matched_municipalities(areas, municipalities, country, cutoff, score)
    county = matched.filter(F.col("municipio_gadm").isNotNull()).groupBy(
        F.col("provincia").alias("NAME_2"), F.col("municipio_gadm").alias("NAME_4")).agg(F.min("comarca").alias("comarca"))
    updates = areas.filter(F.col("NAME_0") == country).select("UID", "NAME_2", "NAME_4").join(
        county, ["NAME_2", "NAME_4"]).select("UID", F.col("comarca").alias("NAME_3"))
    return overwrite_where_known(areas, updates, "UID", "NAME_3").select(*areas.columns)


def missing_name_share(areas: DataFrame, country: str = "Spain") -> DataFrame:
    """Percent of a country's areas whose level-3 name is missing."""
    rows = areas.filter(F.col("NAME_0") == country)
    return rows.agg((F.count(F.when(text.not_available(F.col("NAME_3")), 1)) * 100.0 / F.count("*")).alias("perc_missing"))


def report_codes(points: DataFrame, gadm: DataFrame, climate_regions: DataFrame, ecoregions: DataFrame,
                 key: str = "version_uuid", size: float | None = None) -> DataFrame:
    """Codes and names of the areas of each point, in three layers, one row per point."""
    layers = {"gadm": gadm, "climate_regions": climate_regions, "ecoregions": ecoregions}
    climate = climate_regions.select(F.col("code").alias("code_climate_regions"), F.col("name").alias("name_climate_regions"))
    eco = ecoregions.select(F.col("code").alias("code_ecoregions"), F.col("name").alias("name_ecoregions"),
                            F.col("level").alias("code_biome"), F.col("level_name").alias("name_biome"))
    out = assign_layers(points, layers, key, size=size)
    out = out.join(climate, "code_climate_regions", "left").join(eco, "code_ecoregions", "left")
    return out.select(key, "code_gadm", "code_climate_regions", "name_climate_regions", "code_ecoregions", "name_ecoregions",
                      "code_biome", "name_biome")


def updated_codes(points: DataFrame, known: DataFrame | None, code: Callable[[DataFrame], DataFrame],
                  key: str = "version_uuid") -> DataFrame:
    """Known codes plus those of the points not coded yet; codes of removed points stay."""
    if known is None:
        return code(points)
    return append([known, code(unseen(points, known, key)).select(*known.columns)])


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def refresh(spark: SparkSession, paths: Mapping[str, str], layers: Mapping[str, DataFrame],
            grid: tuple[float, float, float], refresh_static: bool = False, refresh_codes: bool = True,
            municipalities: DataFrame | None = None) -> None:
    """All cleaning jobs in order, each `read → transform → write`.

    `paths` names the raw inputs (``reports``, ``app_users``, ``sampling_effort``,
    ``reports_response``, ``areas``, ``ecoregions``, ``pixels``) and the outputs
    (``…_transf``, ``gadm_legend``, ``ecoregions_legend``, ``human_presence``,
    ``reports_codes``); `layers` the polygon layers. Static tables are built once.
    """
    def load(name: str) -> DataFrame:
        return read_parquet(spark, paths[name])

    if refresh_static or not (_exists(spark, paths["gadm_legend"]) and _exists(spark, paths["ecoregions_legend"])):
        areas = load("areas")
        if municipalities is not None:
            areas = corrected_areas(areas, municipalities)
        write_parquet(area_legend(areas), paths["gadm_legend"])
        write_parquet(ecoregion_legend(load("ecoregions")), paths["ecoregions_legend"])
        write_parquet(human_presence(load("pixels"), load("ecoregions_legend")), paths["human_presence"])
    write_parquet(clean_reports(load("reports")), paths["reports_transf"])

    points = load("reports_transf").select("version_uuid", "lon", "lat")

    def code(p: DataFrame) -> DataFrame:
        return report_codes(p, layers["gadm"], layers["climate_regions"], layers["ecoregions"])

    if refresh_codes or not _exists(spark, paths["reports_codes"]):
        write_parquet(code(points), paths["reports_codes"])
    else:
        # only the new rows are written: the table is never read and replaced at once
        known = load("reports_codes")
        fresh = code(unseen(points, known, "version_uuid")).select(*known.columns)
        write_parquet(fresh, paths["reports_codes"], mode="append")
    write_parquet(clean_app_users(load("app_users")), paths["app_users_transf"])
    write_parquet(sampling_effort(load("sampling_effort"), load("pixels"), load("ecoregions_legend"), *grid),
                  paths["sampling_effort_transf"])
    write_parquet(survey_labels(load("reports_response")), paths["reports_response_transf"])
