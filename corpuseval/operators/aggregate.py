"""Aggregation over evaluation results.

``report_rollup`` is the only pass over the fact table: one row per report with sums and counts.
Group aggregates, latest reports, trends and evidence are derived from it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpuseval.metrics import CONFIDENCE, GROUP_KEYS, METRICS
from corpuseval.operators.keyed import names


def filter_runs(
    df: DataFrame,
    dataset: str | None = "all",
    mask: str | None = None,
    restore: str | None = None,
    run_after: str | None = None,
    run_before: str | None = None,
) -> DataFrame:
    """Dataset, provider and inclusive run-range filters; plain predicates that reach the scan."""
    if dataset not in (None, "all"):
        df = df.filter(F.col("dataset_id") == dataset)
    if mask:
        df = df.filter(F.col("mask_provider") == mask)
    if restore:
        df = df.filter(F.col("restore_provider") == restore)
    if run_after:
        df = df.filter((F.col("run_id") != "") & (F.col("run_id") >= run_after))
    if run_before:
        df = df.filter((F.col("run_id") != "") & (F.col("run_id") <= run_before))
    return df


def with_empty_reports(
    results: DataFrame, headers: DataFrame, keys: Sequence[str] = GROUP_KEYS, measured: Sequence[str] = ()
) -> DataFrame:
    """Result rows of weight 1 and, of every report header, a row of weight 0 without measures.

    A report without results so takes part in whatever counts reports, and changes no mean and no item count. Nothing is joined:
    results without a header stay, and NULL keys are keys like others.
    """
    report = [*keys, "run_id", "report_path"]
    types = {f.name: f.dataType for f in results.schema.fields}
    rows = results.select(*report, *measured, F.lit(1).alias("item_weight"))
    empty = headers.select(*report, *[F.lit(None).cast(types[m]).alias(m) for m in measured], F.lit(0).alias("item_weight"))
    return rows.unionByName(empty)


def report_rollup(
    results: DataFrame,
    keys: Sequence[str] = GROUP_KEYS,
    metrics: Sequence[str] = METRICS,
    confidence: str = "confidence",
    headers: DataFrame | None = None,
) -> DataFrame:
    """One row per report: item count, metric sums and non-null counts, run id and path.

    With ``headers`` (rows per report), reports without results have a row as well, with 0 items. Everything derived from the
    rollup then counts them: group means, latest reports, trends and the evidence gate.
    """
    measured = [*metrics, confidence]
    counted = F.count(F.lit(1))
    if headers is not None:
        results, counted = with_empty_reports(results, headers, keys, measured), F.sum("item_weight")
    return results.groupBy(*keys, "run_id", "report_path").agg(
        counted.alias("item_count"),
        *[F.sum(m).alias(f"sum_{m}") for m in measured],
        *[F.count(m).alias(f"n_{m}") for m in measured],
    )


def pooled_mean(metric: str) -> Column:
    """Item-weighted mean over the pooled reports, NULLs skipped, 6 decimals."""
    return F.round(F.try_divide(F.sum(f"sum_{metric}"), F.sum(f"n_{metric}")), 6)


def report_mean(metric: str) -> Column:
    return F.round(F.try_divide(F.col(f"sum_{metric}"), F.col(f"n_{metric}")), 6)


def aggregate_rollup(
    rollup: DataFrame,
    keys: Sequence[str] = GROUP_KEYS,
    metrics: Sequence[str] = METRICS,
    confidence: str = "confidence",
) -> DataFrame:
    return rollup.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("run_count"),
        F.sum("item_count").alias("item_count"),
        *[pooled_mean(m).alias(m) for m in metrics],
        pooled_mean(confidence).alias(CONFIDENCE),
    )


def aggregate_runs(
    results: DataFrame,
    keys: Sequence[str] = GROUP_KEYS,
    metrics: Sequence[str] = METRICS,
    confidence: str = "confidence",
    headers: DataFrame | None = None,
) -> DataFrame:
    """Run count, item count and pooled means per group.

    ``headers`` (one row per report) keeps reports without results: they count as runs with no
    items and NULL means. The runs of a group are rows of ``group_runs``, not an array cell.
    """
    return aggregate_rollup(report_rollup(results, keys, metrics, confidence, headers), keys, metrics, confidence)


def group_runs(results: DataFrame, keys: Sequence[str] = GROUP_KEYS, headers: DataFrame | None = None) -> DataFrame:
    """The runs of every group, one row per report in path order columns; with ``headers`` also reports without results."""
    if headers is None:
        return results.groupBy(*keys, "run_id", "report_path").agg(F.count(F.lit(1)).alias("item_count"))
    rows = with_empty_reports(results, headers, keys)
    return rows.groupBy(*keys, "run_id", "report_path").agg(F.sum("item_weight").alias("item_count"))


def category_counts(items: DataFrame, category: str = "category") -> DataFrame:
    return items.groupBy(category).agg(F.count(F.lit(1)).alias("n"))


def dataset_counts(items: DataFrame, dataset: str = "dataset_id") -> DataFrame:
    return items.groupBy(dataset).agg(F.count(F.lit(1)).alias("item_count"))


def status_counts(results: DataFrame, dataset: str = "dataset_id", status: str = "status") -> DataFrame:
    """Counts per (dataset, status) and per status overall (dataset ``all``).

    The second level is rolled up from the first, so facts are expanded only after counting.
    """
    counted = results.groupBy(dataset, status).agg(F.count(F.lit(1)).alias("n"))
    both = counted.groupingSets([[dataset, status], [status]], F.col(dataset), F.col(status)).agg(
        F.sum("n").alias("n"), F.grouping(dataset).alias("_all")
    )
    return both.select(
        F.when(F.col("_all") == 1, "all").otherwise(F.col(dataset)).alias(dataset), status, "n"
    )


def counts_to_map(counted: DataFrame, keys: str | Sequence[str], name: str, value: str = "n", alias: str = "counts") -> DataFrame:
    """Counted rows to one sorted map per key; a map has one entry per distinct name."""
    entries = F.array_sort(F.collect_list(F.struct(name, value)))
    return counted.groupBy(*names(keys)).agg(F.map_from_entries(entries).alias(alias))


def merge_status_maps(headers: DataFrame, keys: Sequence[str], counts: str = "status_counts") -> DataFrame:
    """Sum the status maps of report headers; long form (keys, status, n)."""
    return (
        headers.select(*keys, F.explode(counts).alias("status", "_n"))
        .groupBy(*keys, "status")
        .agg(F.sum("_n").alias("n"))
    )


def report_summary(
    results: DataFrame,
    keys: Sequence[str] = ("report_path",),
    metrics: str = "metrics",
) -> DataFrame:
    """Means over whichever numeric metric keys occur, one row per (report, metric)."""
    long = results.select(
        *keys, F.explode(F.map_filter(metrics, lambda _, v: v.isNotNull())).alias("metric_key", "_value")
    )
    return long.groupBy(*keys, "metric_key").agg(
        F.count(F.lit(1)).alias("sample_count"), F.round(F.avg("_value"), 6).alias("mean_value")
    )


def report_status_counts(
    results: DataFrame, headers: DataFrame, keys: Sequence[str] = ("report_path",)
) -> DataFrame:
    """Status counts of a report: the header's map where it has one, else recounted rows."""
    from_header = merge_status_maps(headers, list(keys))
    recounted = results.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n"))
    without = recounted.join(from_header.select(*keys).distinct(), list(keys), "left_anti")
    return from_header.unionByName(without)


def report_overview(
    results: DataFrame,
    headers: DataFrame | None = None,
    keys: Sequence[str] = ("report_path",),
    confidence: str = "confidence",
    status: str = "status",
) -> DataFrame:
    """Item count, mean confidence and status counts of every report.

    ``headers`` (``keys`` and a map ``status_counts``) adds reports without results, and its counts go before recounted
    ones unless they are empty. A missing status is ``unknown``. Results are reduced by (report, status) and by report, in one
    pass, before they meet the headers, so a report with many rows is spread over map tasks. Confidences are added up per
    report in the order of its rows: a sum of sums per status may differ in the last bit, which turns a rounding at a tie.
    """
    counts = "array<struct<status:string,n:bigint>>"
    facts = results.select(*keys, F.coalesce(status, F.lit("unknown")).alias("_status"), F.col(confidence).alias("_confidence"))
    levels = facts.groupingSets([[*keys, "_status"], [*keys]], *keys, "_status").agg(
        F.grouping("_status").alias("_total"), F.count(F.lit(1)).alias("_n"),
        F.sum("_confidence").alias("_sum"), F.count("_confidence").alias("_known"),
    )
    total = F.col("_total") == 1
    rows = levels.select(
        *keys, "_status", F.when(total, F.col("_n")).otherwise(0).alias("_n"), F.when(total, F.col("_sum")).alias("_sum"),
        F.when(total, F.col("_known")).otherwise(0).alias("_known"), F.lit(None).cast(counts).alias("_header"),
        F.when(~total, F.col("_n")).alias("_of_status"),
    )
    if headers is not None:
        entries = F.array_sort(F.map_entries("status_counts").cast(counts))
        none = F.lit(None)
        rows = rows.unionByName(
            headers.select(
                *keys, none.cast("string").alias("_status"), F.lit(0).cast("bigint").alias("_n"), none.cast("double").alias("_sum"),
                F.lit(0).cast("bigint").alias("_known"), F.when(F.size("status_counts") > 0, entries).alias("_header"),
                none.cast("bigint").alias("_of_status"),
            )
        )
    counted = F.struct(F.col("_status").alias("status"), F.col("_of_status").alias("n"))
    own = F.collect_list(F.when(F.col("_of_status").isNotNull(), counted))
    return rows.groupBy(*keys).agg(
        F.sum("_n").alias("item_count"),
        F.round(F.sum("_sum") / F.sum("_known"), 6).alias("mean_confidence"),
        F.map_from_entries(F.coalesce(F.max("_header"), F.array_sort(own))).alias("status_counts"),
    )
