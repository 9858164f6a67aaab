"""Repeated evaluation of provider pairs, and the evidence they give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from corpuseval.operators.aggregate import report_rollup
from corpuseval.operators.evidence import evidence_gate
from corpuseval.operators.trends import Pair, headlines, trend_snapshot
from corpuseval.plans.evaluate import evaluate
from corpuseval.session import materialize


def repeated_runs(images: DataFrame, pairs: Sequence[Pair], repetitions: int, run_prefix: str) -> DataFrame:
    """Fact rows of every pair evaluated ``repetitions`` times, stored once.

    Stored because latencies are measured: a recomputed row would differ.
    """
    rows = None
    for repetition in range(1, repetitions + 1):
        run_id = f"{run_prefix}-{repetition:06d}"
        for mask, restore in dict.fromkeys(pairs):
            run = evaluate(images, mask, restore, check_rows=False).withColumn("run_id", F.lit(run_id))
            run = run.withColumn(
                "report_path",
                F.concat_ws("/", "run_id", "dataset_id", F.concat_ws("__", "mask_provider", "restore_provider")),
            )
            rows = run if rows is None else rows.unionByName(run)
    return materialize(rows.drop("mask_words", "boxes", "mask_meta", "restore_meta"))


def repeated_evidence(
    images: DataFrame,
    baseline: Pair,
    candidate: Pair,
    optional: Pair | None = None,
    repetitions: int = 3,
    minimum_runs: int | None = None,
    run_prefix: str = "20000101-000000",
) -> dict[str, DataFrame]:
    """Evaluate the pairs repeatedly and judge them; the minimum defaults to the repetitions."""
    pairs = [baseline, candidate, *([optional] if optional else [])]
    results = repeated_runs(images, pairs, repetitions, run_prefix)
    rollup = report_rollup(results)
    sections, issues = evidence_gate(
        rollup, baseline, candidate, optional, repetitions if minimum_runs is None else minimum_runs
    )
    trend = trend_snapshot(rollup, baseline, candidate)
    return {
        "results": results,
        "sections": sections,
        "issues": issues,
        "trend": trend,
        "headlines": headlines(trend),
    }
