"""All queries on the site tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.fixtures import Inputs, twin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of Inputs under its name, with its SQL twin if there is one."""

    def add(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = twin(sql)
        return f

    return add


def load() -> None:
    from tidemark.plans import catchments, exchange, lines, models, panels, parks, quality, scores, spatials, tabular  # noqa: F401


load()
