"""Registered queries: Spark plans over the given tables, with their SQL twins."""
from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: str


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register a query under ``name``; ``ids`` are the inventory rows it covers."""
    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(fn, sql, ids)
        return fn
    return wrap


def load() -> dict[str, Query]:
    from . import (q_compose, q_detect, q_flows, q_metrics, q_pareto, q_pii, q_redact,  # noqa: F401
                   q_reshape, q_sources, q_stream, q_utility)
    return REGISTRY
