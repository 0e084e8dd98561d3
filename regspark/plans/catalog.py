"""Registry of the queries that run on the given tables, each with its SQL oracle where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def lit(text: str) -> str:
    """SQL string literal of the oracle."""
    return "'" + text.replace("'", "''") + "'"


def load_all() -> None:
    from regspark.plans import (  # noqa: F401
        catalog_ingest,
        catalog_parcels,
        catalog_reports,
        catalog_retrieve,
        catalog_segment,
        catalog_sources,
        catalog_state,
        catalog_text,
    )
