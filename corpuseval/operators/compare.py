"""Paired comparison of a baseline and a candidate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpuseval.functions.runs import delta
from corpuseval.metrics import METRICS
from corpuseval.operators.keyed import hot_keys, key_membership, names, not_blank

PAYLOAD = ["relative_path", "status", "confidence"]


def pair_rows(
    results: DataFrame,
    baseline: Column,
    candidate: Column,
    key: str | Sequence[str] = "item_id",
    pos: str = "pos",
    payload: Sequence[str] = (*PAYLOAD, *METRICS),
) -> DataFrame:
    """Last-wins row of both sides per key as structs ``b`` and ``c`` (NULL when absent).

    De-duplication and the join are one aggregate: one shuffle, no join. Rows are dealt by key first, because the aggregate sorts
    its wide rows, and a map task would sort and spill a whole split to save hardly a row; only rows of hot keys are aggregated
    before the shuffle, so such a key leaves a map task as one row per side. ``payload`` names the columns that are moved.
    ``baseline`` and ``candidate`` may overlap, so a run can be compared with itself.
    """
    keys = names(key)
    kept = results.filter(baseline | candidate)
    for k in keys:
        kept = kept.filter(not_blank(F.col(k)))

    def side(test: str) -> Column:
        return F.max_by(F.when(F.col(test), F.struct(*payload)), F.when(F.col(test), F.col(pos)))

    def paired(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(side("_b").alias("b"), side("_c").alias("c"))

    tests = [F.coalesce(baseline, F.lit(False)).alias("_b"), F.coalesce(candidate, F.lit(False)).alias("_c")]
    rows = kept.select(*dict.fromkeys([*keys, pos, *payload]), *tests)
    hot = hot_keys(kept, keys)
    if not hot:
        return paired(rows.repartition(*keys))
    is_hot = F.xxhash64(*keys).isin(hot)
    return paired(rows.filter(~is_hot).repartition(*keys)).unionByName(paired(rows.filter(is_hot)))


def tag_sides(base: DataFrame, cand: DataFrame) -> DataFrame:
    """Two result tables as one, for ``pair_rows`` with ``_side`` predicates."""
    return base.withColumn("_side", F.lit("b")).unionByName(cand.withColumn("_side", F.lit("c")))


def compare_items(
    pairs: DataFrame,
    key: str | Sequence[str] = "item_id",
    metrics: Sequence[str] = METRICS,
    carried: Sequence[str] = (),
    payload: Sequence[str] = PAYLOAD,
) -> DataFrame:
    """Wide comparison rows of the common items; ``carried`` payload columns are kept per side.

    ``payload`` and ``metrics`` say which columns of the pairs are wanted, or there at all.
    """
    compared = {
        "relative_path": [F.col("b.relative_path").alias("relative_path")],
        "status": [F.col("b.status").alias("baseline_status"), F.col("c.status").alias("candidate_status")],
        "confidence": [
            F.round("b.confidence", 6).alias("baseline_confidence"),
            F.round("c.confidence", 6).alias("candidate_confidence"),
        ],
    }
    columns = [F.col(k) for k in names(key)]
    for name in payload:
        columns += compared[name]
    for m in metrics:
        b, c = F.col(f"b.{m}"), F.col(f"c.{m}")
        columns += [
            b.alias(f"baseline_{m}"),
            c.alias(f"candidate_{m}"),
            delta(b, c).alias(f"delta_{m}"),
        ]
    columns += [
        F.col(f"{side[0]}.{name}").alias(f"{side}_{name}") for name in carried for side in ("baseline", "candidate")
    ]
    return pairs.filter("b is not null and c is not null").select(*columns)


def compare_runs(
    base: DataFrame,
    cand: DataFrame,
    key: str | Sequence[str] = "item_id",
    metrics: Sequence[str] = METRICS,
    pos: str = "pos",
) -> DataFrame:
    pairs = pair_rows(
        tag_sides(base, cand), F.col("_side") == "b", F.col("_side") == "c", key, pos, [*PAYLOAD, *metrics]
    )
    return compare_items(pairs, key, metrics)


def coverage(base: DataFrame, cand: DataFrame, key: str | Sequence[str] = "item_id") -> DataFrame:
    """Common, baseline-only and candidate-only key counts; moves keys only."""
    keys = names(key)
    sides = [df.select(*keys) for df in (base, cand)]
    for k in keys:
        sides = [df.filter(not_blank(F.col(k))) for df in sides]
    return key_membership(*sides, keys).agg(
        F.count_if(F.col("in_left") & F.col("in_right")).alias("common_item_count"),
        F.count_if(F.col("in_left") & ~F.col("in_right")).alias("baseline_only_count"),
        F.count_if(~F.col("in_left") & F.col("in_right")).alias("candidate_only_count"),
    )


def coverage_of_pairs(pairs: DataFrame) -> DataFrame:
    """``coverage`` from the rows of ``pair_rows``."""
    left, right = F.col("b").isNotNull(), F.col("c").isNotNull()
    return pairs.agg(
        F.count_if(left & right).alias("common_item_count"),
        F.count_if(left & ~right).alias("baseline_only_count"),
        F.count_if(~left & right).alias("candidate_only_count"),
    )


def delta_summary(rows: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean, min and max delta per metric. Wide aggregates first; only the single result row is unpivoted."""
    wide = rows.agg(
        *[F.round(F.avg(f"delta_{m}"), 6).alias(f"mean_{m}") for m in metrics],
        *[F.round(F.min(f"delta_{m}"), 6).alias(f"min_{m}") for m in metrics],
        *[F.round(F.max(f"delta_{m}"), 6).alias(f"max_{m}") for m in metrics],
    )
    cells = ", ".join(f"'{m}', mean_{m}, min_{m}, max_{m}" for m in metrics)
    return wide.selectExpr(
        f"stack({len(metrics)}, {cells}) as (metric_key, mean_delta, min_delta, max_delta)"
    )


def status_pairs(rows: DataFrame) -> DataFrame:
    return rows.groupBy(
        F.concat_ws("__", "baseline_status", "candidate_status").alias("status_pair")
    ).agg(F.count(F.lit(1)).alias("n"))


def overlap_summary(rows: DataFrame, iou: str = "mask_iou", precision: str = "mask_precision", recall: str = "mask_recall") -> DataFrame:
    return rows.agg(
        F.count(iou).alias("paired_count"),
        F.round(F.avg(iou), 6).alias("mean_iou"),
        F.round(F.avg(precision), 6).alias("mean_precision"),
        F.round(F.avg(recall), 6).alias("mean_recall"),
    )


def summarize_sides(
    results: DataFrame,
    side: str | Sequence[str] = "_side",
    metrics: Sequence[str] = METRICS,
    confidence: str = "confidence",
    status: str = "status",
) -> DataFrame:
    """Item count, status counts, metric means and mean confidence of every side, over all its rows.

    Rows are reduced by (side, status) in one pass over both sides; a missing status counts as the empty string.
    """
    keys = names(side)
    measured = {**{m: F.col(m) for m in metrics}, "mean_confidence": F.round(confidence, 6)}
    counted = results.groupBy(*keys, F.coalesce(F.col(status).cast("string"), F.lit("")).alias("_status")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_sum_{m}") for m, c in measured.items()],
        *[F.count(c).alias(f"_n_{m}") for m, c in measured.items()],
    )
    return counted.groupBy(*keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("item_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("_status", "_n")))).alias("status_counts"),
        *[F.round(F.sum(f"_sum_{m}") / F.sum(f"_n_{m}"), 6).alias(m) for m in measured],
    )


def summarize_side(results: DataFrame, metrics: Sequence[str] = METRICS, confidence: str = "confidence") -> DataFrame:
    """``summarize_sides`` of one side, always one row."""
    return summarize_sides(results, (), metrics, confidence)
