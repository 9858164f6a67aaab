"""Side-by-side review tables, report labels and the review queue."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from corpuseval.operators.keyed import lookup_join, names, not_blank, ordered_number, top_per_group

# Columns shown per label, and the states that send an item to the queue.
REVIEW_FIELDS = ["status", "note", "confidence"]
FAILED_STATUSES = [
    "no_mask",
    "mask_provider_unavailable",
    "mask_provider_error",
    "restore_provider_unavailable",
    "restore_provider_error",
]
ACTIONS = ["retry", "reject", "approve"]


def provider_label(mask: Column, restore: Column) -> Column:
    """Restore provider, else mask provider, else ``provider``."""
    return (
        F.when(not_blank(restore), F.trim(restore))
        .when(F.coalesce(mask, F.lit("")) != "", mask)
        .otherwise("provider")
    )


def review_key(item_id: Column, relative_path: Column) -> Column:
    """Item id, else relative path; NULL for a result that has neither."""
    return F.coalesce(
        F.when(not_blank(item_id), F.trim(item_id)), F.when(not_blank(relative_path), F.trim(relative_path))
    )


def dedupe_labels(reports: DataFrame, label: str, order: str | Sequence[str], run: str = "run_id") -> DataFrame:
    """Add ``unique_label``: a repeated label gets ``@run_id``, or ``@ordinal`` where the run id is blank.

    Counting is an aggregate and the ordinal comes from slice numbering, so a label shared by a
    third of all reports is not sorted by one task.
    """
    totals = reports.groupBy(label).agg(F.count(F.lit(1)).alias("_total"))
    numbered = ordered_number(reports, label, order, "_ordinal")
    suffix = F.when(not_blank(F.col(run)), F.trim(run)).otherwise(F.col("_ordinal").cast("string"))
    labelled = lookup_join(numbered, totals, label, "inner").withColumn(
        "unique_label",
        F.when(F.col("_total") == 1, F.col(label)).otherwise(F.concat(F.col(label), F.lit("@"), suffix)),
    )
    return labelled.select(*reports.columns, "unique_label")


def review_wide(
    results: DataFrame,
    labels: Sequence[str],
    key: str | Sequence[str] = "item_id",
    label: str = "label",
    pos: str = "pos",
    fields: Sequence[str] = REVIEW_FIELDS,
    item_fields: Sequence[str] = ("relative_path",),
) -> DataFrame:
    """Items present under every label, with one struct per label (``r0``, ``r1``, ...).

    The N-way join is one aggregate with a last-wins pick per label. Duplicates inside a label
    collapse to the last row. ``review_order`` is the item's position under the first label.
    """
    if len(set(labels)) != len(labels) or len(labels) < 2:
        raise ValueError("a review needs at least two distinct labels")
    keys = names(key)
    kept = results.filter(F.col(label).isin(list(labels)))
    for k in keys:
        kept = kept.filter(not_blank(F.col(k)))
    is_label = [F.col(label) == name for name in labels]
    cells = [
        F.max_by(F.when(t, F.struct(*fields)), F.when(t, F.col(pos))).alias(f"r{i}")
        for i, t in enumerate(is_label)
    ]
    first = is_label[0]
    wide = kept.groupBy(*keys).agg(
        *cells,
        F.min(F.when(first, F.col(pos))).alias("review_order"),
        F.max_by(F.when(first, F.struct(*item_fields)), F.when(first, F.col(pos))).alias("_item"),
    )
    present = reduce(and_, [F.col(f"r{i}").isNotNull() for i in range(len(labels))])
    return wide.filter(present).select(
        *keys, "_item.*", *[f"r{i}" for i in range(len(labels))], "review_order"
    )


def review_table(results: DataFrame, labels: Sequence[str], key: str | Sequence[str] = "item_id", **kwargs) -> DataFrame:
    """``review_wide`` as rows (key, label, fields); raise on an empty result in ``require_common``."""
    wide = review_wide(results, labels, key, **kwargs)
    sides = F.array(
        *[F.struct(F.lit(name).alias("label"), F.col(f"r{i}").alias("cell")) for i, name in enumerate(labels)]
    )
    kept = [c for c in wide.columns if not (c[0] == "r" and c[1:].isdigit()) and c != "review_order"]
    return wide.select(*kept, F.inline(sides)).select(*kept, "label", "cell.*")


def require_common(review: DataFrame) -> DataFrame:
    if review.isEmpty():
        raise ValueError("a review needs at least one item present under every label")
    return review


def review_queue(
    results: DataFrame,
    failed_statuses: Sequence[str] = FAILED_STATUSES,
    min_confidence: float = 0.5,
    per_dataset: int | None = None,
    order: Sequence[str] = ("confidence", "item_id"),
) -> DataFrame:
    """Failed or low-confidence rows with a reason and a proposed action.

    Provider failures are retried, empty results rejected, low-confidence ones put up for
    approval. ``per_dataset`` keeps the first n per dataset; without it all rows are kept.
    """
    failed = F.col("status").isin(list(failed_statuses))
    low = F.col("confidence") < min_confidence
    queued = results.filter(failed | low).withColumn(
        "reason", F.when(failed, "failed").otherwise("low_confidence")
    ).withColumn(
        "action",
        F.when(F.col("status") == "no_mask", "reject").when(failed, "retry").otherwise("approve"),
    )
    if per_dataset is None:
        return queued
    ranked = [F.col(c).asc_nulls_first() for c in order]
    return top_per_group(queued, "dataset_id", ranked, per_dataset)


def apply_decisions(queue: DataFrame, decisions: DataFrame, key: str | Sequence[str] = "item_id", pos: str = "pos") -> DataFrame:
    """Latest reviewer decision per item on the queue (``review_state``, else ``pending``)."""
    keys = names(key)
    latest = decisions.groupBy(*keys).agg(F.max_by("decision", pos).alias("review_state"))
    return lookup_join(queue, latest, keys, "left").withColumn(
        "review_state", F.coalesce("review_state", F.lit("pending"))
    )
