"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.plans import registry


def _load() -> None:
    from tideline.plans import queries_data, queries_effects, queries_models, queries_report, queries_study  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql() for name, sql in registry.LATE.items()}
