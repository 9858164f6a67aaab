"""Metric vocabulary of an evaluation result row."""

from __future__ import annotations

# Metric names, their order and which direction is better.
BASE_METRICS = ["mask_nonzero", "mask_ratio", "changed_nonzero", "mean_abs_diff", "edge_delta"]
LATENCY_METRICS = ["mask_latency_ms", "restore_latency_ms", "ocr_residual_latency_ms"]
RESIDUAL_METRICS = ["ocr_residual_hits", "ocr_residual_score", "ocr_residual_max_score"]
METRICS = [*BASE_METRICS, *LATENCY_METRICS, *RESIDUAL_METRICS]

CONFIDENCE = "mean_confidence"

LOWER_IS_BETTER = {
    "mean_abs_diff",
    "edge_delta",
    "mask_latency_ms",
    "restore_latency_ms",
    "ocr_residual_latency_ms",
    "ocr_residual_hits",
    "ocr_residual_score",
    "ocr_residual_max_score",
}
HIGHER_IS_BETTER = {"mean_confidence"}

HEADLINE_ORDER = [
    "mean_abs_diff",
    "edge_delta",
    "mask_latency_ms",
    "restore_latency_ms",
    "ocr_residual_latency_ms",
    "ocr_residual_score",
    "ocr_residual_hits",
    "mean_confidence",
]

GROUP_KEYS = ["dataset_id", "mask_provider", "restore_provider"]


def preference(metric: str) -> str | None:
    if metric in LOWER_IS_BETTER:
        return "lower"
    if metric in HIGHER_IS_BETTER:
        return "higher"
    return None


def headline_rank(metric: str) -> int | None:
    return HEADLINE_ORDER.index(metric) + 1 if metric in HEADLINE_ORDER else None
