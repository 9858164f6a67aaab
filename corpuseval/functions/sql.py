"""SQL names for the scalar rules, and a table function that flattens recogniser output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from corpuseval.functions.marktext import BUILT_IN_PHRASES, DEFAULT_TOKENS, DOMAIN_PARTS, MARK_REGIONS, WHITESPACE


def _literal(text: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" if ord(c) < 32 or ord(c) > 126 else c for c in text).replace("'", "\\'") + "'"


def _any_of(expr: str, tokens: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {_literal(t)})" for t in tokens) + ")"


def register_sql(spark: SparkSession, tokens: Sequence[str] = DEFAULT_TOKENS) -> None:
    """Create temporary SQL functions ``squash_text``, ``is_mark_text``, ``mask_iou``, ``flatten_lines``.

    Catalyst inlines their bodies, no Python is involved. The shortest array decides the number of flattened lines.
    """
    squash = f"translate(lower(coalesce(t, '')), {_literal(WHITESPACE)}, '')"
    regions = ", ".join(_literal(r) for r in MARK_REGIONS)
    corner = f"coalesce(region IN ({regions}), false) AND length(f) >= 4"
    # The lambda variable holds the squashed line, which every test of the chain reads.
    marked = f"{_any_of('f', tokens)} OR ({corner} AND {_any_of('f', [*DOMAIN_PARTS, *BUILT_IN_PHRASES])})"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION squash_text(t STRING) RETURNS STRING RETURN {squash}"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION is_mark_text(t STRING, region STRING) RETURNS BOOLEAN "
        f"RETURN exists(array({squash}), f -> {marked})"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION mask_iou(shared BIGINT, a BIGINT, b BIGINT) RETURNS DOUBLE "
        "RETURN CASE WHEN a + b - shared = 0 THEN 1.0D ELSE round(shared / (a + b - shared), 6) END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION flatten_lines(polys ARRAY<ARRAY<STRUCT<x: INT, y: INT>>>, texts ARRAY<STRING>, "
        "scores ARRAY<DOUBLE>) RETURNS TABLE(text STRING, score DOUBLE, polygon ARRAY<STRUCT<x: INT, y: INT>>) RETURN "
        "SELECT inline(slice(arrays_zip(texts, scores, polys), 1, "
        "coalesce(greatest(0, least(size(polys), size(texts), size(scores))), 0)))"
    )
