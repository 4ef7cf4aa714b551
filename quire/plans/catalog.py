"""Registry of the queries run on the driver tables, with their SQL oracles.

Each entry is ``fn(spark, sf_dir) -> DataFrame`` plus, where SQL can say
the same thing, an equivalent DuckDB query over the same parquet tables.
Column names and types agree between both sides.  Modules under
``quire.plans`` register themselves on import.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []


def register(name: str, oracle: str | None = None, headline: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that all entries are registered."""
    from quire.plans import (  # noqa: F401
        q_cohort, q_records, q_text, q_scores, q_recommend, q_cluster, q_synth, q_reports,
        q_sources, q_files, q_models,
    )
