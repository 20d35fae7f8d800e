"""All named queries outside the training-data subpackage, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = tuple(
    f"millrace.{m}" for m in ("operators.stats", "operators.labels", "operators.sched", "operators.dataflow", "operators.pixels", "operators.formats", "operators.search", "sources.queries", "streaming.streams")
)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name; `oracle` is the equivalent DuckDB statement."""

    def add(fn: Query) -> Query:
        if name in _QUERIES and _QUERIES[name] is not fn:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return add


def _load() -> None:
    import importlib

    for module in _MODULES:
        importlib.import_module(module)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
