"""Queries over the driver's tables, each beside its SQL: one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plait.plans.query import Query
from plait.sources.catalog import Database

_CASES: dict[str, tuple[Callable, str | None]] = {}


def case(name: str, sql: str | None = None):
    """Registers fn(db) -> Query or DataFrame, with the SQL that gives its rows."""

    def add(fn: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            got = fn(Database(spark, sf_dir))
            return got.df if isinstance(got, Query) else got

        run.__name__ = name
        _CASES[name] = (run, sql)
        return fn

    return add


def _load() -> None:
    from plait.queries import changes, functions, groups, joins, scans, search, sets, windows  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: run for k, (run, _) in _CASES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: sql for k, (_, sql) in _CASES.items() if sql}
