"""Registered queries and their DuckDB oracles.

Every query takes ``(spark, sf_dir)``, reads the parquet tables (or what Spark
derives from them) in full, and returns a DataFrame whose column names equal
the oracle's. Counts are ``bigint`` on both sides; doubles are rounded in both
engines; lists are flattened to rows or joined to strings so value hashes do
not depend on an engine's array rendering.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def _load_all() -> None:
    # Importing the modules registers their queries.
    from . import (  # noqa: F401
        q_accounting,
        q_classes,
        q_code,
        q_docs,
        q_layout,
        q_logs,
        q_packages,
        q_search,
        q_structural,
    )
