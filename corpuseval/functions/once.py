"""Evaluate a costly expression once.

Spark inlines projected columns into later filters, and filters have no common-subexpression
elimination, so an array or text expression may run once per reference. Two ways around it:
``let`` binds a value inside one expression, ``compute_once`` stores it as a column behind a
generator, which the optimizer does not inline.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select("*", F.explode(F.array(value)).alias(name))
