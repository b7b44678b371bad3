"""Queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, directory of the tables) under ``name``, with its SQL where SQL can express it."""

    def add(function: Query) -> Query:
        _QUERIES[name] = function
        if oracle:
            _ORACLES[name] = oracle
        return function

    return add


def _load() -> None:
    from . import claims, evidence, files, graph, ledger, linking, outputs, sessions, streams, texts, units, work  # noqa: F401  they register themselves


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, turns, characters and answers of every session."""
    return queries()["min00_session_rollup"](spark, sf_dir)
