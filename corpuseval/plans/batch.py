"""Plans and resumable batches. A plan is a stored snapshot; a run appends to a result table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuseval.operators.aggregate import category_counts
from corpuseval.operators.keyed import key_filter, last_wins
from corpuseval.operators.runs import pending_items
from corpuseval.operators.validate import check_version, count_mismatch
from corpuseval.plans.evaluate import evaluate
from corpuseval.session import materialize
from corpuseval.sources.sinks import read_snapshot, write_snapshot

PLAN_VERSION = 1


def plan(items: DataFrame, plan_id: str, settings: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """``(header, plan_items)``: settings, item count and category counts of a plan, and its frozen items.

    The header is folded from the category counts, so the items are read once.
    """
    entries = F.array_sort(F.collect_list(F.struct("category", "n")))
    header = category_counts(items).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("item_count"), F.map_from_entries(entries).alias("category_counts")
    )
    named = header.select(
        F.lit(plan_id).alias("plan_id"),
        F.lit(PLAN_VERSION).alias("plan_version"),
        *[F.lit(v).alias(k) for k, v in settings.items()],
        "item_count",
        "category_counts",
    )
    return named, items.withColumn("plan_id", F.lit(plan_id))


def write_plan(items: DataFrame, root: str, plan_id: str, settings: Mapping[str, str]) -> None:
    """Freeze the items first and count what was stored, so header and items always agree."""
    spark = items.sparkSession
    write_snapshot(items.withColumn("plan_id", F.lit(plan_id)), f"{root}/items", plan_id)
    frozen = read_snapshot(spark, f"{root}/items", plan_id).drop("snapshot_id", "plan_id")
    write_snapshot(plan(frozen, plan_id, settings)[0], f"{root}/headers", plan_id)


def read_plan(spark: SparkSession, root: str, plan_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(header, items)`` of a plan, the latest without an id."""
    header = check_version(read_snapshot(spark, f"{root}/headers", plan_id), "plan_version", PLAN_VERSION)
    found = header.select("plan_id").first()
    if found is None:
        raise ValueError(f"no plan {plan_id!r} below {root}")
    return header, read_snapshot(spark, f"{root}/items", found.plan_id)


def apply_plan(header: DataFrame, plan_items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(items, warnings)``: stored items as they are, and a row if their number is not the declared one."""
    return plan_items, count_mismatch(header, plan_items, "plan_id")


def run_batch(
    images: DataFrame,
    mask_provider: str,
    transform_provider: str,
    run_id: str,
    scan_only: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``(results, failures)`` of a run. Failures have a provider's status and note; not being results, they stay pending.

    The rows are stored once, so that no provider runs twice for the two tables.
    """
    if scan_only:
        scanned = images.select(
            "item_id",
            "relative_path",
            F.lit("scanned").alias("status"),
            F.lit("scan_only").alias("note"),
            F.lit(run_id).alias("run_id"),
        )
        return scanned, scanned.limit(0)
    results = evaluate(images, mask_provider, transform_provider, skip_cover=True, check_rows=False)
    stored = materialize(results.withColumn("run_id", F.lit(run_id)))
    failed = F.col("status").contains("_provider_")
    return stored.filter(~failed), stored.filter(failed)


def resume_batch(
    manifest: DataFrame,
    results: DataFrame,
    images: DataFrame,
    mask_provider: str,
    transform_provider: str,
    run_id: str,
    key: str = "relative_path",
) -> tuple[DataFrame, DataFrame]:
    """``(results, failures)`` of the items still pending; empty when there are none.

    Keys are matched on the narrow manifest. Images are only filtered, by ``key_filter``: with images of ``read_images`` and
    ``relative_path`` as the key, finished files are not opened, and no pixels are shuffled. The few other images that pass
    the filter are taken out of the narrow results. An append of the returned rows twice is undone by ``merged_results``.
    """
    pending = materialize(pending_items(manifest.select(key), results, key))
    wanted = key_filter(pending, key)
    chosen = images.filter(F.lit(False) if wanted is None else wanted)
    done, failed = run_batch(chosen, mask_provider, transform_provider, run_id)
    return done.join(pending, key, "left_semi"), failed.join(pending, key, "left_semi")


def merged_results(results: DataFrame, key: str = "relative_path", pos: str = "appended_at") -> DataFrame:
    """The result table with one row per item, the last appended."""
    return last_wins(results, key, pos)
