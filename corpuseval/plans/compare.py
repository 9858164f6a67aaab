"""Comparison of two result tables with mask overlap and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from corpuseval.metrics import METRICS
from corpuseval.operators import compare
from corpuseval.operators.masks import attach_masks, mask_overlap
from corpuseval.session import materialize


def compare_reports(
    base: DataFrame,
    cand: DataFrame,
    masks: DataFrame | None = None,
    key: str | Sequence[str] = "item_id",
    metrics: Sequence[str] = METRICS,
    pos: str = "pos",
    store: bool = True,
) -> dict[str, DataFrame]:
    """Item rows, coverage, status pairs, delta and overlap summaries, and a summary row of either side that has rows.

    With ``masks(mask_path, words)`` the rows of both sides are scored by their mask paths. Items
    are paired before masks are attached, so words are only moved for common items. The pairs are
    stored once, and coverage and all summaries of items read them; either side is read for its pairs
    and, in one pass with the other, for its summary.
    """
    carried = ["mask_path"] if masks is not None else []
    tagged = compare.tag_sides(base, cand)
    pairs = compare.pair_rows(
        tagged,
        F.col("_side") == "b",
        F.col("_side") == "c",
        key,
        pos,
        [*compare.PAYLOAD, *metrics, *carried],
    )
    if store:
        pairs = materialize(pairs)
    items = compare.compare_items(pairs, key, metrics, carried)
    if masks is not None:
        for side in ("baseline", "candidate"):
            items = attach_masks(items, masks, f"{side}_mask_path", f"{side}_words")
        items = mask_overlap(items)
        if store:
            items = materialize(items)
    sides = compare.summarize_sides(tagged, metrics=metrics)
    parts = {
        "items": items,
        "coverage": compare.coverage_of_pairs(pairs) if store else compare.coverage(base, cand, key),
        "status_pairs": compare.status_pairs(items),
        "delta_summary": compare.delta_summary(items, metrics),
        "side_summaries": sides.withColumn("side", F.when(F.col("_side") == "b", "baseline").otherwise("candidate")).drop("_side"),
    }
    if masks is not None:
        parts["overlap_summary"] = compare.overlap_summary(items)
    return parts
