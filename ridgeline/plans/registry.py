"""All queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ridgeline.plans import files, roads, scoring, shapes, terrain

_MODULES = (scoring, terrain, files, roads, shapes)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: q for m in _MODULES for n, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q for m in _MODULES for n, q in m.SQL.items()}
