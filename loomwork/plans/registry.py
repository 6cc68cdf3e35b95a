"""Queries of the engine's own operators, with the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from loomwork.plans.star import Star, with_star

Query = Callable[[SparkSession, str], DataFrame]
#: Modules of this package that register queries.
AREAS = ("coverage", "access", "progression", "program_map", "searching", "progress", "course_reports", "etl", "documents", "texts", "sheets", "extensions")

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of a Star under its own name, with the SQL for the same rows; None where SQL can't say it."""

    def register(make: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
        _QUERIES[make.__name__] = lambda spark, sf_dir: make(Star(spark, sf_dir))
        if sql:
            _ORACLES[make.__name__] = with_star(sql)
        return make

    return register


def _load() -> None:
    for area in AREAS:
        import_module(f"loomwork.plans.{area}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
