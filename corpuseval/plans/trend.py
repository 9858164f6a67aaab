"""Trend snapshot of a candidate as one job: comparison, latest reports and sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from corpuseval.metrics import METRICS
from corpuseval.operators import trends
from corpuseval.session import materialize

COMPARISON = ["coverage", "status_pairs", "delta_summary", "overlap_summary"]


def trend_report(
    rollup: DataFrame,
    comparison: dict[str, DataFrame],
    baseline: trends.Pair,
    candidate: trends.Pair,
    aggregates: DataFrame | None = None,
    dataset: str | None = None,
    metrics: Sequence[str] = METRICS,
) -> dict[str, DataFrame]:
    """The parts of ``compare_reports`` that a trend carries, the latest report of either role, a row per section and
    metric, and the headlines. The rollup (a row per report) is stored once, as two parts read it."""
    rollup = materialize(rollup)
    sections = trends.trend_snapshot(rollup, baseline, candidate, aggregates, dataset, metrics)
    return {
        **{f"comparison_{name}": comparison[name] for name in COMPARISON if name in comparison},
        "latest": trends.latest_pair(rollup, baseline, candidate, dataset, metrics),
        "sections": sections,
        "headlines": trends.headlines(sections),
    }
