"""Item classification: name parts, layout category, dataset routing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Categories, dataset names, id prefixes, file suffixes, name-hint pattern and
# the thresholds of the cover look.
LANDSCAPE = "landscape_regular"
PORTRAIT = "portrait_regular"
COVER = "cover_heavy"
REGULAR_DATASET = "regular_corner_text"
COVER_DATASET = "cover_heavy"
ID_PREFIX = {REGULAR_DATASET: "regular", COVER_DATASET: "cover"}
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".webp", ".bmp"]
NAME_HINT = r"(?iu)(?:^|[-_])(0|cover|封面)$"
COVER_PATCH_TOP, COVER_PATCH_WIDTH = 0.72, 0.18
COVER_EDGE, COVER_DARK, COVER_BRIGHT = 24.0, 0.45, 0.12
DARK_BELOW, BRIGHT_ABOVE = 80, 190


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")


def name_hint(stem: Column) -> Column:
    return stem.rlike(NAME_HINT)


def cover_look(edge_density: Column, dark: Column, bright: Column, width: Column, height: Column) -> Column:
    """True when the lower-left patch of a tall image looks like a dense cover overlay."""
    return (
        (width < height)
        & (edge_density > COVER_EDGE)
        & (dark > COVER_DARK)
        & (bright > COVER_BRIGHT)
    )


def layout_category(width: Column, height: Column, stem: Column, cover: Column | None = None) -> Column:
    """Wide images are landscape; otherwise a cover by name or look, else portrait."""
    is_cover = name_hint(stem)
    if cover is not None:
        is_cover = is_cover | F.coalesce(cover, F.lit(False))
    return F.when(width > height, LANDSCAPE).when(is_cover, COVER).otherwise(PORTRAIT)


def dataset_of(category: Column) -> Column:
    return F.when(category == COVER, COVER_DATASET).otherwise(REGULAR_DATASET)


def id_prefix(dataset: Column) -> Column:
    return F.when(dataset == REGULAR_DATASET, ID_PREFIX[REGULAR_DATASET]).otherwise(
        ID_PREFIX[COVER_DATASET]
    )
