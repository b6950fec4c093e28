"""Registered queries: name -> function of (session, table folder), with SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_FAMILIES = ("kpi_queries", "basic_queries", "etl_queries", "spatial_queries", "behaviour_queries", "climate_queries")

Query = Callable[[SparkSession, str], DataFrame]


def _collect(attribute: str) -> dict:
    out: dict = {}
    for family in _FAMILIES:
        module = importlib.import_module(f"{__name__}.{family}")
        for name, value in getattr(module, attribute).items():
            if name in out:
                raise ValueError(f"query {name} is registered twice")
            out[name] = value
    return out


def queries() -> dict[str, Query]:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLE")
