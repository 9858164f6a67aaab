"""Named queries over the driver's tables, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuseval.catalog import arrays, boxes, evaluation, runs, streams, text

Query = Callable[[SparkSession, str], DataFrame]

_PARTS = (evaluation, runs, boxes, text, arrays, streams)


def queries() -> dict[str, Query]:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
