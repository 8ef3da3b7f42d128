"""Registry of the reliability-analytics queries: name -> (Spark query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its own name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = oracle
        return f

    return add


def load() -> None:
    """Import every module that registers queries."""
    import importlib

    for module in MODULES:
        importlib.import_module(f"raretide.plans.{module}")


MODULES: tuple[str, ...] = ("spectra", "relations", "studies", "symmetry", "kernels", "reports", "searches", "layouts", "runs", "library", "enumerations", "actions", "certificates")
