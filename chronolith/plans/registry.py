"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "b2_label_time_shares"


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) as a query, with the DuckDB SQL of the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


from chronolith.plans import (  # noqa: E402,F401
    audit,
    availability,
    intervals,
    maps,
    more,
    profiles,
    ranges,
    series,
    windows,
)
