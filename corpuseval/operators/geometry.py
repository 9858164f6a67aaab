"""Box operators that relate items, regions and boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpuseval.functions.arrays import mask_extent
from corpuseval.functions.boxes import ROI_SPECS, compact_box, is_valid, relative_box
from corpuseval.operators.keyed import lookup_join, names
from corpuseval.schemas import ROI_SPEC


def roi_specs(spark: SparkSession) -> DataFrame:
    """Default search boxes as a table, one row per (category, region)."""
    rows = [(category, region, *search, *fallback, *compact) for category, region, search, fallback, compact in ROI_SPECS]
    return spark.createDataFrame(rows, ROI_SPEC)


def roi_boxes(items: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """Search, fallback and compact pixel boxes per item and region of its category.

    The default specs are four constant rows, broadcast as such. A caller's table is joined
    without a hint, so Spark broadcasts it only below its own byte limit.
    """
    spark = items.sparkSession
    dim = F.broadcast(roi_specs(spark)) if specs is None else specs
    w, h = F.col("width"), F.col("height")

    def pixels(prefix: str):
        return relative_box(w, h, tuple(F.col(f"_spec.{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))

    packed = dim.select(
        "category", "region", F.struct(*[c for c in dim.columns if c not in ("category", "region")]).alias("_spec")
    )
    joined = items.join(packed, "category")
    return joined.select(
        *items.columns,
        "region",
        pixels("").alias("search_box"),
        pixels("f").alias("fallback_box"),
        pixels("c").alias("compact_box"),
    )


def compact_boxes(boxes: DataFrame, key: str | Sequence[str], specs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(boxes, compacted)``: replace default fallback boxes and list the regions replaced per key."""
    spark = boxes.sparkSession
    dim = F.broadcast(roi_specs(spark)) if specs is None else specs
    w, h = F.col("width"), F.col("height")
    packed = dim.select(
        "category", "region", F.struct(*[c for c in dim.columns if c not in ("category", "region")]).alias("_spec")
    )
    joined = boxes.join(packed, ["category", "region"], "left")

    def pixels(prefix: str):
        made = relative_box(w, h, tuple(F.col(f"_spec.{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))
        return F.when(F.col("_spec").isNotNull(), made)

    new_box, replaced = compact_box(F.col("box"), pixels("f"), pixels("c"))
    done = joined.withColumn("_new", new_box).withColumn("compacted", replaced)
    result = done.select(
        *[F.col("_new").alias("box") if c == "box" else F.col(c) for c in boxes.columns], "compacted"
    )
    regions = result.filter("compacted").select(*names(key), "region").distinct()
    return result, regions


def bbox_union(
    boxes: DataFrame,
    key: str | Sequence[str],
    width: str = "width",
    height: str = "height",
    padding: int = 0,
) -> DataFrame:
    """Padded and clamped bounding box of the valid boxes per key.

    Reads columns ``box``; min and max combine before the shuffle.
    """
    pad = F.lit(max(0, padding))
    valid = boxes.filter(is_valid(F.col("box")))
    spans = valid.groupBy(*names(key)).agg(
        F.min("box.x1").alias("_x1"),
        F.min("box.y1").alias("_y1"),
        F.max("box.x2").alias("_x2"),
        F.max("box.y2").alias("_y2"),
        F.max(width).alias("_w"),
        F.max(height).alias("_h"),
        F.count(F.lit(1)).alias("box_count"),
    )
    zero = F.lit(0)
    return spans.select(
        *names(key),
        F.greatest(zero, F.col("_x1") - pad).alias("x1"),
        F.greatest(zero, F.col("_y1") - pad).alias("y1"),
        F.least(F.col("_w"), F.col("_x2") + pad).alias("x2"),
        F.least(F.col("_h"), F.col("_y2") + pad).alias("y2"),
        "box_count",
    )


def source_box(
    items: DataFrame,
    boxes: DataFrame,
    masks: DataFrame,
    key: str | Sequence[str],
    words: str = "words",
    width: str = "width",
    height: str = "height",
    padding: int = 0,
) -> DataFrame:
    """Box of every item: around its valid boxes, else around the set pixels of its mask, else NULL.

    ``box_status`` is ``boxes``, ``mask``, ``empty_mask`` or ``no_mask``. Boxes and masks are reduced to one box per item before
    they meet; a mask's extent is found where the mask is read, so packed pixels are not shuffled. ``items`` has the frame size.
    """
    keys, pad = names(key), F.lit(max(0, padding))
    spans = bbox_union(boxes, keys, width, height, padding).select(*keys, F.struct("x1", "y1", "x2", "y2").alias("_boxed"))
    extents = masks.select(
        *keys, F.col(words).isNotNull().alias("_masked"), mask_extent(F.col(words), F.col(width), F.col(height)).alias("_extent")
    )
    # several masks of an item: the box around all of them
    merged = extents.groupBy(*keys).agg(
        F.max("_masked").alias("_masked"), F.min("_extent.x1").alias("_x1"), F.min("_extent.y1").alias("_y1"),
        F.max("_extent.x2").alias("_x2"), F.max("_extent.y2").alias("_y2"),
    )
    joined = items.select(*keys, F.col(width).alias("_w"), F.col(height).alias("_h")).join(spans, keys, "left").join(merged, keys, "left")
    zero, boxed = F.lit(0), F.col("_boxed").isNotNull()
    from_mask = {
        "x1": F.greatest(zero, F.col("_x1") - pad),
        "y1": F.greatest(zero, F.col("_y1") - pad),
        "x2": F.least(F.col("_w"), F.col("_x2") + pad),
        "y2": F.least(F.col("_h"), F.col("_y2") + pad),
    }
    status = (
        F.when(boxed, "boxes").when(F.col("_x1").isNotNull(), "mask").when(F.coalesce("_masked", F.lit(False)), "empty_mask").otherwise("no_mask")
    )
    seen = F.col("_x1").isNotNull()
    return joined.select(
        *keys, *[F.when(boxed, F.col(f"_boxed.{c}")).when(seen, made).alias(c) for c, made in from_mask.items()], status.alias("box_status")
    )


def box_regions(boxes: DataFrame, key: str | Sequence[str], pos: str) -> DataFrame:
    """Distinct nonblank regions of the valid boxes per key, in order of first occurrence.

    Positions are reduced per (key, region) first; the array holds one entry per region name.
    """
    keys = names(key)
    first = (
        boxes.filter(is_valid(F.col("box")) & (F.trim(F.coalesce("region", F.lit(""))) != ""))
        .groupBy(*keys, F.trim("region").alias("region"))
        .agg(F.min(pos).alias("_first"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("_first", "region")))
    return first.groupBy(*keys).agg(ordered["region"].alias("regions"))


def covered_pixels(boxes: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Pixels covered by the union of the boxes per key, exactly as a painted mask would count.

    The distinct top and bottom edges of a key cut its frame into bands in which the covered
    columns do not change. A box becomes one row per band it crosses instead of one per pixel
    row; equal spans collapse in the map tasks, and a window merges the spans of one band. A
    band's group is bounded by the frame width, the edge list by the frame height.
    """
    keys = names(key)
    valid = boxes.filter(is_valid(F.col("box"))).select(
        *keys, *[F.col(f"box.{c}").alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")]
    )
    edges = (
        valid.select(*keys, F.explode(F.array("_y1", "_y2")).alias("_y"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set("_y")).alias("_edges"))
    )
    first = F.array_position("_edges", F.col("_y1")).cast("int")
    past = F.array_position("_edges", F.col("_y2")).cast("int")
    tops = F.slice("_edges", first, past - first)
    bottoms = F.slice("_edges", first + 1, past - first)
    spans = (
        lookup_join(valid, edges, keys, "inner")
        .select(*keys, "_x1", "_x2", F.explode(F.arrays_zip(tops.alias("top"), bottoms.alias("bottom"))).alias("_band"))
        .groupBy(*keys, "_band", "_x1")
        .agg(F.max("_x2").alias("_x2"))
    )
    before = (
        Window.partitionBy(*keys, "_band").orderBy("_x1").rowsBetween(Window.unboundedPreceding, -1)
    )
    reached = F.coalesce(F.max("_x2").over(before), F.col("_x1"))
    added = F.greatest(F.lit(0), F.col("_x2") - F.greatest(F.col("_x1"), F.col("_reached")))
    return (
        spans.withColumn("_reached", reached)
        .groupBy(*keys)
        .agg(F.sum(added.cast("long") * (F.col("_band.bottom") - F.col("_band.top"))).alias("mask_nonzero"))
    )
