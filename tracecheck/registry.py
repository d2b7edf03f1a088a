"""All queries of the library's own operators, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracecheck.queries import attempts, catalog, curate, gate, properties, text

_PARTS = (properties, gate, attempts, curate, catalog, text)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
