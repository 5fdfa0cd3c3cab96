"""Registered queries: every operator on the given tables, with the SQL it must agree with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = ["text_queries", "link_queries", "record_queries", "rollup_queries", "scan_queries", "stream_queries"]
_REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` it is checked by rows and by the tests."""
    def register(fn):
        if name in _REGISTERED:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Times are compared as UTC everywhere.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        run.__name__ = name
        _REGISTERED[name] = (run, sql)
        return fn
    return register


def load() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    for module in _MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return _REGISTERED
