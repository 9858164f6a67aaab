"""Pixel scans of image-source rows. Pixels stay in their row; nothing is grouped or shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpuseval.functions import pixels
from corpuseval.functions.arrays import EDGE_FULL_SCALE
from corpuseval.functions.classify import (
    BRIGHT_ABOVE,
    COVER_PATCH_TOP,
    COVER_PATCH_WIDTH,
    DARK_BELOW,
    cover_look,
    file_stem,
    layout_category,
    name_hint,
)
from corpuseval.operators.geometry import roi_specs
from corpuseval.session import ship_package

PIXEL_COLUMNS = ["height", "width", "nChannels", "data"]


def patch_stats(images: DataFrame) -> DataFrame:
    """Edge density, dark and bright share of the lower-left patch; pixel bytes are dropped."""
    ship_package(images.sparkSession)
    kept = [c for c in images.columns if c not in ("data", "nChannels")]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema.fields if f.name in kept]
        + ["edge_density double", "dark_fraction double", "bright_fraction double"]
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            stats = []
            for h, w, c, data in zip(*(batch[x] for x in PIXEL_COLUMNS)):
                if data is None:
                    stats.append((np.nan, np.nan, np.nan))
                    continue
                image = pixels.decode(data, h, w, c)
                corner = image[int(h * COVER_PATCH_TOP) :, : int(w * COVER_PATCH_WIDTH)]
                if corner.size == 0:
                    stats.append((0.0, 0.0, 0.0))
                    continue
                g = pixels.gray(corner)
                stats.append(
                    (
                        float(pixels.edges(corner).mean()) * EDGE_FULL_SCALE,
                        float((g < DARK_BELOW).mean()),
                        float((g > BRIGHT_ABOVE).mean()),
                    )
                )
            out = batch[kept].copy()
            out[["edge_density", "dark_fraction", "bright_fraction"]] = np.array(stats).reshape(-1, 3)
            yield out

    return images.mapInPandas(scan, schema)


def classify_images(images: DataFrame) -> DataFrame:
    """Scan items (path, size, category) of decoded images, in one pass.

    Pixels are handed to Python only for tall images without a name hint, the only ones whose
    category depends on them.
    """
    width, height = F.col("width"), F.col("height")
    stem = file_stem(F.col("relative_path"))
    undecided = (width < height) & ~name_hint(stem)
    stats = patch_stats(
        images.select(
            "source_path",
            "relative_path",
            "width",
            "height",
            "nChannels",
            F.when(undecided, F.col("data")).alias("data"),
        )
    )
    cover = undecided & cover_look(
        F.col("edge_density"), F.col("dark_fraction"), F.col("bright_fraction"), width, height
    )
    return stats.select(
        "source_path", "relative_path", "width", "height", layout_category(width, height, stem, cover).alias("category")
    )


def corner_profile(images: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """Bright low-saturation pixels per item and search region: count, bounding box, fallback flag.

    The specs of a category travel as one array, joined on the category (four constant rows by
    default, a caller's table without a hint), so pixels are neither exploded per region nor
    joined by path, and an image is decoded once.
    """
    spark = images.sparkSession
    ship_package(spark)
    fields = ["region", "x1", "y1", "x2", "y2", "fx1", "fy1", "fx2", "fy2"]
    by_category = (
        (roi_specs(spark) if specs is None else specs)
        .groupBy("category")
        .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("regions"))
    )
    if specs is None:
        by_category = F.broadcast(by_category)
    schema = (
        "relative_path string, category string, region string, bright_pixels long, "
        "x1 int, y1 int, x2 int, y2 int, is_fallback boolean"
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in schema.split(", ")]
        for batch in batches:
            rows = []
            for path, category, height, width, channels, data, found in zip(
                *(batch[c] for c in ["relative_path", "category", *PIXEL_COLUMNS, "regions"])
            ):
                bright = pixels.bright_low_saturation(pixels.decode(data, height, width, channels))
                frame = np.array([width, height, width, height])
                for r in found:
                    x1, y1, x2, y2 = (frame * [r["x1"], r["y1"], r["x2"], r["y2"]]).astype(int)
                    ys, xs = np.nonzero(bright[y1:y2, x1:x2])
                    if len(xs):
                        bounds = (x1 + xs.min(), y1 + ys.min(), x1 + xs.max() + 1, y1 + ys.max() + 1)
                    else:
                        bounds = (frame * [r["fx1"], r["fy1"], r["fx2"], r["fy2"]]).astype(int)
                    rows.append((path, category, r["region"], len(xs), *map(int, bounds), len(xs) == 0))
            yield pd.DataFrame(rows, columns=names)

    wanted = images.select("relative_path", "category", *PIXEL_COLUMNS).join(by_category, "category")
    return wanted.mapInPandas(scan, schema)
