"""The registry of queries over the driver's tables, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exchange, landing, registry, relational, scalar, spatial  # noqa: F401 - modules register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)


def operators() -> dict[str, str]:
    """Query name: the inventory ids it covers."""
    return dict(registry.IDS)
