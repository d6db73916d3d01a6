"""Registry of named queries: Spark implementation + DuckDB oracle SQL.

Each registered callable takes ``(spark, sf_dir)``, builds the operator on the
given tables and returns the presented DataFrame (see ``functions.present``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from partcast.functions.present import present
from partcast.params import EVENTS_PARAMS, Params
from partcast.sources.tables import Tables

# The fixtures' parts are ordered a few times a year, so training asks for fewer observed days.
P = Params(train_points=3, single_days=4)
EP = EVENTS_PARAMS


@dataclass
class Entry:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: object | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql)
        return fn
    return deco


def _load_all() -> None:
    # Importing the catalog modules fills REGISTRY.
    from partcast.plans import (  # noqa: F401
        cat_sources, cat_extract, cat_reshape, cat_calendar, cat_features, cat_leadtime,
        cat_classify, cat_forecast, cat_evaluate, cat_procure, cat_quality, cat_summary, cat_ml,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()

    def make(e: Entry):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(e.build(Tables(spark, sf_dir)))
        run.__name__ = e.name
        return run

    return {k: make(e) for k, e in REGISTRY.items()}


def oracle_sql(tables_dir: str) -> dict[str, str]:
    """Oracle SQL by key; ``tables_dir`` holds tables whose column types it is described with."""
    from partcast.plans.sqlkit import normalise

    _load_all()
    return {k: normalise(e.sql, tables_dir) for k, e in REGISTRY.items() if e.sql}
