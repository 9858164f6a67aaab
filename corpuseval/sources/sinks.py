"""Snapshots and flat CSV reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuseval.metrics import BASE_METRICS, CONFIDENCE, GROUP_KEYS, LATENCY_METRICS, METRICS

# CSV column order of each report kind.
RUN_COLUMNS = [
    "item_id", "dataset_id", "relative_path", "status", "mask_provider", "restore_provider",
    "mask_nonzero", "mask_ratio", "changed_nonzero", "mean_abs_diff", "edge_delta",
    "mask_latency_ms", "restore_latency_ms", "restore_session_mode", "ocr_residual_latency_ms",
    "ocr_residual_hits", "ocr_residual_score", "ocr_residual_max_score", "mask_session_mode",
    "ocr_residual_session_mode", "mask_path", "overlay_path", "restored_path", "note",
]
RUN_COUNTS = ["mask_nonzero", "changed_nonzero", "ocr_residual_hits"]
BATCH_COLUMNS = [
    "source_path", "relative_path", "category", "status", "note", "mask_provider",
    "restore_provider", "mask_nonzero", "confidence", "mask_latency_ms", "restore_latency_ms",
    "restore_session_mode", "mask_path", "overlay_path", "restored_path",
]
AGGREGATE_COLUMNS = [
    "dataset_id", "mask_provider", "restore_provider", "run_count", "item_count", CONFIDENCE,
    "status_counts", *METRICS, "mean_mask_latency_ms", "mean_restore_latency_ms", "mean_ocr_residual_latency_ms",
]
COMPARE_COLUMNS = [
    "item_id", "relative_path", "baseline_status", "candidate_status", "baseline_confidence",
    "candidate_confidence",
    *[f"{side}_{m}" for m in METRICS for side in ("baseline", "candidate", "delta")],
    "mask_iou", "mask_precision", "mask_recall",
]
DATASET_COLUMNS = [
    "item_id", "dataset_id", "source_path", "input_path", "relative_path", "source_category",
    "benchmark_category", "width", "height", "prompt", "prompt_path", "seed_mask_path",
    "seed_overlay_path",
]
NOTES_COLUMNS = [
    "item_id", "relative_path", "source_category", "prompt", "seed_mask_nonzero",
    "seed_confidence", "manual_score", "comment",
]


def flat_cell(df: DataFrame, name: str) -> Column:
    """A column as CSV text: nested values as JSON, absent columns and NULLs empty."""
    if name not in df.columns:
        return F.lit("").alias(name)
    kind = df.schema[name].dataType.simpleString()
    value = F.to_json(name) if kind.startswith(("map<", "array<", "struct<")) else F.col(name).cast("string")
    return F.coalesce(value, F.lit("")).alias(name)


def flat_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[flat_cell(df, c) for c in columns])


def _number(df: DataFrame, name: str, decimals: int, missing: str) -> Column:
    """A number as text with fixed decimals, which any engine writes alike; ``missing`` where it is absent or NULL."""
    if name not in df.columns:
        return F.lit(missing).alias(name)
    value = F.format_string(f"%.{decimals}f", F.round(F.col(name).cast("double"), decimals)) if decimals else F.round(name).cast("bigint").cast("string")
    return F.coalesce(F.when(F.col(name).isNotNull(), value), F.lit(missing)).alias(name)


def flat_run(results: DataFrame) -> DataFrame:
    """Evaluation results as the flat run report, all columns as text: counts whole, other numbers with 6 decimals.

    Mask and change metrics that are missing read as zero, missing latencies and residual scores as empty.
    """

    def cell(name: str) -> Column:
        if name not in METRICS:
            return flat_cell(results, name)
        decimals = 0 if name in RUN_COUNTS else 6
        zero = "0" if decimals == 0 else "0.000000"
        return _number(results, name, decimals, zero if name in BASE_METRICS else "")

    return results.select(*[cell(name) for name in RUN_COLUMNS])


def flat_dataset(items: DataFrame) -> DataFrame:
    """Prepared items as the flat dataset manifest; items without a seed have empty seed paths."""
    return flat_report(items, DATASET_COLUMNS)


def flat_notes(items: DataFrame) -> DataFrame:
    """Prepared items as a table for manual scores: without a seed mask zero, with two empty columns to fill in."""
    numbers = {"seed_mask_nonzero": _number(items, "seed_mask_nonzero", 0, "0"), "seed_confidence": _number(items, "seed_confidence", 6, "0.000000")}
    return items.select(*[numbers[c] if c in numbers else flat_cell(items.drop("manual_score", "comment"), c) for c in NOTES_COLUMNS])


def write_dataset_reports(items: DataFrame, root: str) -> None:
    """The dataset manifest and the notes as CSV folders ``manifest`` and ``notes`` below ``root``."""
    write_csv(flat_dataset(items), f"{root}/manifest")
    write_csv(flat_notes(items), f"{root}/notes")


def flat_batch(results: DataFrame) -> DataFrame:
    """Batch results (nested) as the flat batch report: confidence with 4, latencies with 3 decimals."""

    def fixed(value: Column, decimals: int) -> Column:
        return F.format_string(f"%.{decimals}f", value)

    rows = results.select(
        "item.source_path",
        "item.relative_path",
        "item.category",
        "status",
        "note",
        "mask_provider",
        "restore_provider",
        F.coalesce("detection.mask_nonzero", F.lit(0)).alias("mask_nonzero"),
        fixed(F.coalesce("detection.confidence", F.lit(0.0)), 4).alias("confidence"),
        F.when(F.col("mask_latency_ms").isNotNull(), fixed(F.col("mask_latency_ms"), 3)).alias("mask_latency_ms"),
        F.when(F.col("restore_latency_ms").isNotNull(), fixed(F.col("restore_latency_ms"), 3)).alias("restore_latency_ms"),
        F.element_at("restore_meta", F.lit("session_mode")).alias("restore_session_mode"),
        "mask_path",
        "overlay_path",
        "restored_path",
    )
    return flat_report(rows, BATCH_COLUMNS)


def flat_aggregate(groups: DataFrame, status_maps: DataFrame, keys: Sequence[str] = GROUP_KEYS) -> DataFrame:
    """Group aggregates with their status map as flat rows; the runs of a group are a table of their own."""
    named = groups.join(status_maps, list(keys), "left").select(
        "*", *[F.col(m).alias(f"mean_{m}") for m in LATENCY_METRICS]
    )
    return flat_report(named, AGGREGATE_COLUMNS)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """CSV folder with a header, one file per task; UTF-8 without a byte order mark."""
    flat = df if columns is None else flat_report(df, columns)
    flat.write.mode("errorifexists").options(header="true", emptyValue="", escape=chr(34)).csv(path)


def write_results(results: DataFrame, path: str, keys: Sequence[str] = GROUP_KEYS, mode: str = "append") -> None:
    """Fact rows as parquet partitioned by the group keys, so provider filters prune folders.

    ``rebalance`` lets AQE split a hot partition over several tasks and merge small ones, instead
    of one writer per key or one file per key and task.
    """
    results.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).parquet(path)


def write_snapshot(df: DataFrame, root: str, snapshot_id: str) -> None:
    """Append ``df`` as one partition of a snapshot table. A repeated id is replaced as a whole."""
    (
        df.withColumn("snapshot_id", F.lit(snapshot_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_id")
        .parquet(root)
    )


def read_snapshot(spark: SparkSession, root: str, snapshot_id: str | None = None) -> DataFrame:
    """A snapshot by id, or the greatest id. Ids are partitions, so only one folder is read."""
    table = spark.read.option("partitionOverwriteMode", "dynamic").parquet(root)
    table = table.withColumn("snapshot_id", F.col("snapshot_id").cast("string"))
    if snapshot_id is None:
        snapshot_id = table.agg(F.max("snapshot_id")).first()[0]
    return table.filter(F.col("snapshot_id") == snapshot_id)
