"""All queries over the object map, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomap.plans import expressions, extra, further, graphs, maps, more, retrieval, upkeep

MODULES = (expressions, maps, more, extra, retrieval, upkeep, further, graphs)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
