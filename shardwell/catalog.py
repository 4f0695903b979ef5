"""All registered queries of the reference's own operators, and DuckDB SQL with the same result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "flagship_chunk_summary"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a query; without an oracle it is checked by tests."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return put


for _family in ("chunks", "storage", "filters", "joins", "aggregates", "ranking", "sets", "graph", "scalars", "extraction", "sourcecode", "views", "build", "projects", "more"):
    importlib.import_module(f"shardwell.plans.{_family}")
