"""The engine's queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import _base, aggregation, changes, documents, evidence, graph, lexical, ranking, scalars, streams, surface, vectors

#: Modules register their queries as they are imported.
MODULES = (aggregation, changes, documents, evidence, graph, lexical, ranking, scalars, streams, surface, vectors)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_base.ORACLES)
