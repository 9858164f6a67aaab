"""Pairwise scores of masks and arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from corpuseval.functions.arrays import and_count, overlap_scores, popcount
from corpuseval.operators.keyed import lookup_join, names

SHAPE = ("height", "width")


def mask_overlap(pairs: DataFrame, baseline: str = "baseline_words", candidate: str = "candidate_words", drop: bool = True) -> DataFrame:
    """Add ``mask_iou``, ``mask_precision``, ``mask_recall`` from packed masks.

    NULL when a mask is missing or the shapes differ; ``mask_shape_differs`` marks the latter. Shapes are the columns
    ``<mask>_height`` and ``<mask>_width`` of ``attach_masks``; without them only the number of words can be compared.
    """
    b, c = F.col(baseline), F.col(candidate)
    shapes = [s for s in SHAPE if {f"{baseline}_{s}", f"{candidate}_{s}"} <= set(pairs.columns)]
    differs = F.size(b) != F.size(c)
    for s in shapes:
        differs = differs | ~F.col(f"{baseline}_{s}").eqNullSafe(F.col(f"{candidate}_{s}"))
    counted = (
        pairs.withColumn("mask_shape_differs", F.when(b.isNotNull() & c.isNotNull(), differs))
        .withColumn("_comparable", F.coalesce(~F.col("mask_shape_differs"), F.lit(False)))
        .withColumn("_shared", F.when(F.col("_comparable"), and_count(b, c)))
        .withColumn("_b", F.when(F.col("_comparable"), popcount(b)))
        .withColumn("_c", F.when(F.col("_comparable"), popcount(c)))
    )
    scores = overlap_scores(F.col("_shared"), F.col("_b"), F.col("_c"))
    used = {baseline, candidate, *[f"{m}_{s}" for m in (baseline, candidate) for s in shapes]}
    gone = {"_comparable", "_shared", "_b", "_c"} | (used if drop else set())
    return counted.select(
        *[x for x in counted.columns if x not in gone],
        *[F.when(F.col("_comparable"), s).alias(f"mask_{n}") for n, s in scores.items()],
    )


def attach_masks(rows: DataFrame, masks: DataFrame, path_col: str, alias: str) -> DataFrame:
    """Packed words of ``masks(mask_path, words, height, width)`` by path, and ``<alias>_height`` and ``<alias>_width``.

    NULL when the path or file is missing. One mask may serve many rows (a shared seed), so hot paths are salted.
    """
    shape = [F.col(s).alias(f"{alias}_{s}") for s in SHAPE if s in masks.columns]
    mask = F.first(F.struct(F.col("words").alias(alias), *shape)).alias("_mask")
    unique = masks.groupBy(F.col("mask_path").alias(path_col)).agg(mask).select(path_col, "_mask.*")
    return lookup_join(rows, unique, path_col, "left")


def consecutive_pairs(df: DataFrame, key: str, payload: str | Sequence[str], step: int = 1) -> DataFrame:
    """Row ``key`` next to row ``key + step``: payload columns as ``a_*`` and ``b_*``.

    An equi-join on a unique key; pack arrays before pairing so that words are shuffled.
    """
    cells = names(payload)
    left = df.select(key, *[F.col(c).alias(f"a_{c}") for c in cells])
    right = df.select((F.col(key) - step).alias(key), *[F.col(c).alias(f"b_{c}") for c in cells])
    return left.join(right, key)
