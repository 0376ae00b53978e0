"""Names of the registered queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_CASES: dict[str, Query] = {}
_ANSWERS: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its DuckDB twin where there is one."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle is not None:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def case(answer: str) -> Callable[[Query], Query]:
    """A rule on a few inline rows with the expected answers: for tests only, no registered query."""

    def add(f: Query) -> Query:
        _CASES[f.__name__], _ANSWERS[f.__name__] = f, answer
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    from siftwell.plans import conversations, documents, events, flows, pages, parties, records, rules  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def cases() -> dict[str, tuple[Query, str]]:
    """The inline cases by name, each with the SQL of its expected answers."""
    from siftwell.plans import fixtures  # noqa: F401

    return {name: (f, _ANSWERS[name]) for name, f in _CASES.items()}
