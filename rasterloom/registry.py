"""Named queries over the test tables and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "pts1_to_runs"


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under `name`, with its oracle where there is one."""

    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def load() -> None:
    """Import every module that registers queries."""
    from rasterloom.queries import jobs, models, outlines, rasters, scalars, shapes  # noqa: F401
