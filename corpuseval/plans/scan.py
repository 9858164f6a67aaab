"""Scan summary and dataset preparation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuseval.functions.classify import REGULAR_DATASET, dataset_of, id_prefix
from corpuseval.operators.aggregate import category_counts
from corpuseval.operators.images import classify_images
from corpuseval.operators.keyed import first_n, ordered_number, top_per_group
from corpuseval.operators.validate import require_rows
from corpuseval.sources.corpus import list_corpus, read_images, select_images


def scan_corpus(
    spark: SparkSession,
    root: str,
    recursive: bool = True,
    excluded: Sequence[str] = (),
    limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(items, rejects)``: list, limit, then decode and classify what is left.

    All rules are filters on the path, applied to the file listing before a file is opened. A limit is the greatest path it
    admits, found from file metadata, so the same holds for it whatever its size; pixels never meet a join.
    """
    good, bad = read_images(spark, root, recursive)
    images, rejects = (select_images(df, recursive, excluded) for df in (good, bad))
    if limit is not None:
        listed = list_corpus(spark, root, recursive, excluded, limit)
        last = listed.agg(F.max("relative_path").alias("last")).first()["last"]
        inside = F.lit(False) if last is None else F.col("relative_path") <= F.lit(last)
        images, rejects = images.filter(inside), rejects.filter(inside)
    return classify_images(images), rejects


def select_items(items: DataFrame, dataset: str = "all", limit: int | None = None, order: str = "item_id") -> DataFrame:
    """Items of one or all datasets, the first ``limit`` of each; an empty selection is an error."""
    chosen = items if dataset == "all" else items.filter(F.col("dataset_id") == dataset)
    if limit is not None:
        chosen = top_per_group(chosen, "dataset_id", order, limit)
    return require_rows(chosen, f"dataset {dataset!r}")


def scan_summary(items: DataFrame) -> DataFrame:
    """Item count and category counts: one row per category with the overall total.

    The total is summed over the few category rows, so the items are read once.
    """
    counted = category_counts(items)
    total = counted.groupingSets([["category"], []], F.col("category")).agg(
        F.sum("n").alias("n"), F.grouping("category").alias("_total")
    )
    return total.select(
        F.when(F.col("_total") == 1, "all").otherwise(F.col("category")).alias("category"), "n"
    )


def route_items(items: DataFrame) -> DataFrame:
    return items.withColumn("dataset_id", dataset_of(F.col("category")))


def sequence_ids(
    items: DataFrame, partition: str = "dataset_id", order: str = "relative_path", key: str | None = None
) -> DataFrame:
    """Add ``item_id`` such as ``regular-0001`` in path order per dataset; with a unique ``key`` only keys are numbered."""
    numbered = ordered_number(items, partition, order, "_seq", key)
    digits = F.col("_seq").cast("string")
    padded = F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0"))
    return numbered.withColumn(
        "item_id", F.concat(id_prefix(F.col(partition)), F.lit("-"), padded)
    ).drop("_seq")


def prepare_dataset(
    items: DataFrame,
    seeds: DataFrame | None = None,
    prompts: Mapping[str, str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Route scan items to their dataset with ids, prompt text and seed notes.

    ``prompts`` maps a category to the text given to a transform provider (default empty).
    ``seeds`` (relative_path, seed_mask_nonzero, seed_confidence) holds seed masks of regular
    items; cover items and items without a seed get 0 and 0.0. Files are not copied.

    Seeds meet their items before these are numbered: items and seeds that both lie dealt by path then join in place.
    """
    if limit is not None:
        items = first_n(items, "relative_path", limit)
    if seeds is not None:
        items = items.join(
            seeds.select("relative_path", "seed_mask_nonzero", "seed_confidence"), "relative_path", "left"
        )
    routed = sequence_ids(route_items(items))
    prompt = F.lit("")
    for category, text in (prompts or {}).items():
        prompt = F.when(F.col("category") == category, text).otherwise(prompt)
    prepared = routed.withColumn("prompt", prompt)
    if seeds is not None:
        regular = F.col("dataset_id") == REGULAR_DATASET
        nonzero = F.when(regular, F.coalesce("seed_mask_nonzero", F.lit(0))).otherwise(0).cast("long")
        confidence = F.when(regular, F.coalesce("seed_confidence", F.lit(0.0))).otherwise(0.0)
    else:
        nonzero, confidence = F.lit(0).cast("long"), F.lit(0.0)
    return prepared.select(
        "item_id",
        "dataset_id",
        "source_path",
        "relative_path",
        "width",
        "height",
        F.col("category").alias("source_category"),
        F.col("dataset_id").alias("benchmark_category"),
        "prompt",
        nonzero.alias("seed_mask_nonzero"),
        F.round(confidence, 4).alias("seed_confidence"),
    )
