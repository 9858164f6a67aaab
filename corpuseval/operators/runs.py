"""Run bookkeeping: statuses, progress, pending items, resume, lookup, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpuseval.functions.classify import COVER
from corpuseval.operators.keyed import lookup_join, names

# Item statuses and run states.
SCANNED, SKIPPED_COVER, NO_MASK = "scanned", "skipped_cover", "no_mask"
RESTORED, MASKED_ONLY = "restored", "masked_only"
MASK_UNAVAILABLE, MASK_ERROR = "mask_provider_unavailable", "mask_provider_error"
RESTORE_UNAVAILABLE, RESTORE_ERROR = "restore_provider_unavailable", "restore_provider_error"
RUNNING, COMPLETED, INTERRUPTED = "running", "completed", "interrupted"


def batch_status(scan_only: Column, category: Column, mask_nonzero: Column, provider_status: Column) -> Column:
    return (
        F.when(scan_only, SCANNED)
        .when(category == COVER, SKIPPED_COVER)
        .when(F.coalesce(mask_nonzero, F.lit(0)) == 0, NO_MASK)
        .when(F.coalesce(provider_status, F.lit("")) != "", provider_status)
        .otherwise(RESTORED)
    )


def eval_status(
    mask_failure: Column,
    mask_nonzero: Column,
    restore_failure: Column,
    restore_provider: Column,
    provider_status: Column,
) -> Column:
    """Status of an evaluated item. Failures are NULL, ``unavailable`` or ``error``."""
    return (
        F.when(mask_failure.isNotNull(), F.concat(F.lit("mask_provider_"), mask_failure))
        .when(F.coalesce(mask_nonzero, F.lit(0)) == 0, NO_MASK)
        .when(restore_failure.isNotNull(), F.concat(F.lit("restore_provider_"), restore_failure))
        .when(F.coalesce(provider_status, F.lit("")) != "", provider_status)
        .when(restore_provider == "noop", MASKED_ONLY)
        .otherwise(RESTORED)
    )


def result_key(relative_path: Column, source_path: Column) -> Column:
    """Key of a finished result: relative path, else source path, else NULL."""
    return F.coalesce(
        F.when(relative_path != "", relative_path), F.when(source_path != "", source_path)
    )


def completed_keys(results: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return results.select(*names(key)).dropna().distinct()


def pending_items(manifest: DataFrame, results: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Manifest rows without a result; result keys are reduced to distinct before they move."""
    return lookup_join(manifest, completed_keys(results, key), key, "left_anti")


def run_progress(totals: DataFrame, results: DataFrame, run: str = "run_id", total: str = "image_count") -> DataFrame:
    """Completed and pending counts per run; runs without results have none completed."""
    done = results.groupBy(run).agg(F.count(F.lit(1)).alias("completed_item_count"))
    joined = totals.select(run, total).join(done, run, "left")
    completed = F.coalesce("completed_item_count", F.lit(0))
    return joined.select(
        run,
        total,
        completed.alias("completed_item_count"),
        F.greatest(F.lit(0).cast("long"), F.col(total) - completed).alias("pending_item_count"),
    )


def run_summary(totals: DataFrame, results: DataFrame, run: str = "run_id", total: str = "image_count") -> DataFrame:
    """Progress, state and status counts per run, one row per (run, status)."""
    counted = results.groupBy(run, "status").agg(F.count(F.lit(1)).alias("n"))
    done = counted.groupBy(run).agg(F.sum("n").alias("completed_item_count"))
    completed = F.coalesce("completed_item_count", F.lit(0))
    state = F.when(completed >= F.col(total), COMPLETED).otherwise(INTERRUPTED)
    progress = totals.join(done, run, "left").select(
        run,
        total,
        completed.alias("completed_item_count"),
        F.greatest(F.lit(0).cast("long"), F.col(total) - completed).alias("pending_item_count"),
        state.alias("run_status"),
    )
    return progress.join(counted, run, "left")


def resume_counts(
    manifest: DataFrame, before: DataFrame, after: DataFrame, key: str | Sequence[str]
) -> DataFrame:
    """Effect of a resume: items pending before, resumed by it, and still pending.

    One aggregate over tagged keys replaces two anti joins.
    """
    keys = names(key)

    def tagged(df: DataFrame, flag: str) -> DataFrame:
        flags = ["_m", "_b", "_a"]
        return df.select(*keys, *[F.lit(f == flag).alias(f) for f in flags])

    rows = tagged(manifest, "_m").unionByName(tagged(before, "_b")).unionByName(tagged(after, "_a"))
    per_key = rows.groupBy(*keys).agg(*[F.max(f).alias(f) for f in ("_m", "_b", "_a")]).filter("_m")
    pending = F.count_if(~F.col("_b"))
    return per_key.agg(
        F.count(F.lit(1)).alias("image_count"),
        F.count_if(F.col("_b")).alias("completed_before"),
        pending.alias("pending_before"),
        F.count_if(~F.col("_b") & F.col("_a")).alias("resumed_item_count"),
        F.count_if(~F.col("_b") & ~F.col("_a")).alias("pending_after"),
        F.when(pending > 0, 1).otherwise(0).alias("resume_count"),
    )


def run_lookup(runs: DataFrame, run_id: str | None = None, latest: bool = False) -> DataFrame:
    """A named run, or the greatest run id. At most one selector."""
    if run_id is not None and latest:
        raise ValueError("choose either a run id or the latest run")
    if run_id is not None:
        return runs.filter(F.col("run_id") == run_id)
    payload = [c for c in runs.columns if c != "run_id"]
    return runs.agg(
        F.max("run_id").alias("run_id"), F.max_by(F.struct(*payload), "run_id").alias("_row")
    ).select("run_id", "_row.*")


def reconcile_results(summary_rows: DataFrame, jsonl_rows: DataFrame, run_key: str = "run_id") -> DataFrame:
    """Per run, the appended results when there are at least as many as in the summary, else the summary's."""
    tagged = summary_rows.withColumn("_from_jsonl", F.lit(False)).unionByName(
        jsonl_rows.withColumn("_from_jsonl", F.lit(True))
    )
    choice = tagged.groupBy(run_key).agg(
        (F.count_if("_from_jsonl") >= F.count_if(~F.col("_from_jsonl"))).alias("_use_jsonl")
    )
    return (
        lookup_join(tagged, choice, run_key, "inner")
        .filter("_from_jsonl = _use_jsonl")
        .drop("_from_jsonl", "_use_jsonl")
    )
