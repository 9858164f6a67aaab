"""Box geometry on integer pixel boxes ``struct<x1,y1,x2,y2>``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpuseval.functions.marktext import BOTTOM_LEFT, BOTTOM_RIGHT

# Relative search boxes, their fallback boxes and the compact fallback boxes
# per (category, region), and the padding around a found box.
ROI_SPECS = [
    # category, region, search box, fallback box, compact fallback box
    ("portrait_regular", "bottom_left", (0.00, 0.94, 0.70, 1.00), (0.00, 0.952, 0.68, 1.00), (0.00, 0.965, 0.595, 0.999)),
    ("portrait_regular", "bottom_right", (0.77, 0.90, 1.00, 1.00), (0.77, 0.92, 1.00, 1.00), (0.617, 0.944, 0.991, 0.99)),
    ("landscape_regular", "bottom_left", (0.00, 0.905, 0.58, 1.00), (0.00, 0.915, 0.52, 1.00), (0.00, 0.932, 0.56, 0.995)),
    ("landscape_regular", "bottom_right", (0.76, 0.88, 1.00, 1.00), (0.76, 0.89, 1.00, 1.00), (0.617, 0.883, 0.991, 0.973)),
]
TEXT_PAD = {"bottom_left": (16, 8), "bottom_right": (12, 8)}
TEXT_PAD_OTHER = (10, 6)
ROI_PAD = {"bottom_left": (12, 6)}
ROI_PAD_OTHER = (8, 6)
FULL_CONFIDENCE_SHARE = 0.08
EDGE_TOLERANCE_MIN, EDGE_TOLERANCE_SHARE = 8, 0.08
EDGES = ["left", "right", "top", "bottom"]


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(
        x1.cast("int").alias("x1"),
        y1.cast("int").alias("y1"),
        x2.cast("int").alias("x2"),
        y2.cast("int").alias("y2"),
    )


def relative_box(width: Column, height: Column, ratios: tuple[Column, Column, Column, Column]) -> Column:
    """Ratios to pixels, truncating like an integer cast."""
    return box(width * ratios[0], height * ratios[1], width * ratios[2], height * ratios[3])


def _pad_by_region(region: Column, table: dict[str, tuple[int, int]], other: tuple[int, int], axis: int) -> Column:
    return (
        F.when(region == BOTTOM_LEFT, table.get("bottom_left", other)[axis])
        .when(region == BOTTOM_RIGHT, table.get("bottom_right", other)[axis])
        .otherwise(other[axis])
    )


def pad_box(b: Column, width: Column, height: Column, region: Column, kind: str = "text") -> Column:
    """Grow a box by its region's padding and clamp it to the frame."""
    table, other = (TEXT_PAD, TEXT_PAD_OTHER) if kind == "text" else (ROI_PAD, ROI_PAD_OTHER)
    px, py = (_pad_by_region(region, table, other, axis) for axis in (0, 1))
    zero = F.lit(0)
    return box(
        F.greatest(zero, b["x1"] - px),
        F.greatest(zero, b["y1"] - py),
        F.least(width, b["x2"] + px),
        F.least(height, b["y2"] + py),
    )


def clamp_box(b: Column, width: Column, height: Column) -> Column:
    zero = F.lit(0)
    return box(
        F.greatest(zero, b["x1"]),
        F.greatest(zero, b["y1"]),
        F.least(width, b["x2"]),
        F.least(height, b["y2"]),
    )


def is_valid(b: Column) -> Column:
    return F.coalesce((b["x2"] > b["x1"]) & (b["y2"] > b["y1"]), F.lit(False))


def compact_box(b: Column, fallback: Column, compact: Column) -> tuple[Column, Column]:
    """``(box, replaced)``: a box equal to the default fallback gives way to the compact one."""
    same = F.coalesce(b == fallback, F.lit(False)) & compact.isNotNull()
    return F.when(same, compact).otherwise(b), same


def rescale(value: Column, scale: Column, offset: Column | int = 0) -> Column:
    """Map a coordinate of a scaled crop back to the frame (half-even rounding)."""
    shift = offset if isinstance(offset, Column) else F.lit(offset)
    return F.bround(value * scale).cast("int") + shift


def _area(width: Column, height: Column) -> Column:
    """Pixels of a frame; the product of two ints can pass the int range."""
    return width.cast("bigint") * height


def mask_ratio(nonzero: Column, width: Column, height: Column) -> Column:
    return F.round(nonzero / F.greatest(F.lit(1), _area(width, height)), 6)


def mask_confidence(nonzero: Column, width: Column, height: Column) -> Column:
    frame = F.greatest(F.lit(1.0), _area(width, height) * F.lit(FULL_CONFIDENCE_SHARE))
    return F.least(F.lit(1.0), nonzero / frame)


def edge_impact(
    b: Column,
    width: Column,
    height: Column,
    tolerance: Column | int | None = None,
    min_width: int = 1,
    min_height: int = 1,
) -> Column:
    """Which frame edge a mark touches and how much of the frame lies on its outer side.

    Per edge: the kept rectangle if everything from the edge to the box's inner side were set
    aside. Edges within ``tolerance`` compete, otherwise only the nearest; the smallest share
    wins and ties go left, right, top, bottom. NULL when no edge leaves the minimum size.
    ``least`` over structs skips NULL candidates and needs no lambda, so the whole choice is
    generated code.
    """
    if tolerance is None:
        tolerance = F.greatest(
            F.lit(EDGE_TOLERANCE_MIN),
            F.bround(F.least(width, height) * F.lit(EDGE_TOLERANCE_SHARE)).cast("int"),
        )
    elif not isinstance(tolerance, Column):
        tolerance = F.lit(tolerance)
    zero = F.lit(0)
    distance = {
        "left": b["x1"],
        "right": F.greatest(zero, width - b["x2"]),
        "top": b["y1"],
        "bottom": F.greatest(zero, height - b["y2"]),
    }
    kept = {
        "left": box(b["x2"], zero, width, height),
        "right": box(zero, zero, b["x1"], height),
        "top": box(zero, b["y2"], width, height),
        "bottom": box(zero, zero, width, b["y1"]),
    }
    nearest = F.least(
        *[F.struct(distance[e].alias("d"), F.lit(i).alias("ord")) for i, e in enumerate(EDGES)]
    )
    candidates = []
    for i, edge in enumerate(EDGES):
        k = kept[edge]
        kept_width, kept_height = k["x2"] - k["x1"], k["y2"] - k["y1"]
        competes = (distance[edge] <= tolerance) | (
            (nearest["d"] > tolerance) & (nearest["ord"] == i)
        )
        fits = (kept_width >= max(1, min_width)) & (kept_height >= max(1, min_height))
        removed = width.cast("long") * height - kept_width.cast("long") * kept_height
        candidates.append(
            F.when(
                competes & fits,
                F.struct(
                    removed.alias("removed"),
                    F.lit(i).alias("ord"),
                    F.lit(edge).alias("edge"),
                    kept_width.alias("kept_width"),
                    kept_height.alias("kept_height"),
                    F.round(removed / F.greatest(F.lit(1), _area(width, height)), 6).alias("removed_ratio"),
                ),
            )
        )
    return F.least(*candidates)
