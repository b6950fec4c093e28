"""Staging: named extracts from an operational database, or from its tables in the lake."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..plans import etl
from .tables import read_database, write_parquet

Load = Callable[[str], DataFrame]

def extracts(app: str) -> dict[str, Callable[[Load], DataFrame]]:
    """The extracts as Spark jobs: name -> what it makes of the source tables it loads by role."""
    return {
        "reports": lambda t: etl.extract_reports(t("records"), t("uploads"), t("annotations"), app),
        "app_users": lambda t: t("users").select("user_UUID", "registration_time", "last_score_update", "score_v2"),
        "sampling_effort": lambda t: etl.extract_sampling_effort(t("fixes")),
        "reports_response": lambda t: t("responses").select("version_uuid", "answer_id", "question_id"),
    }


def run_extracts(jobs: Mapping[str, Callable[[Load], DataFrame]], load: Load,
                 save: Callable[[DataFrame, str], None]) -> None:
    """Run every extract over tables found by role; each save is one job."""
    for name, build in jobs.items():
        save(build(load), name)


def stage_queries(spark: SparkSession, options: Mapping[str, str], queries: Mapping[str, str],
                  paths: Mapping[str, str]) -> None:
    """Push each named query whole to a database and keep its rows as parquet.

    `options` are Spark's JDBC options (url, driver, user, fetchsize, …).
    """
    for name, query in queries.items():
        write_parquet(read_database(spark, options, query), paths[name])
