"""Ownership-mark text rules on recognised text lines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from corpuseval.functions.classify import COVER, LANDSCAPE
from corpuseval.functions.once import let

# Default tokens, domain parts, built-in phrases, region names and the
# relative positions that bound each region.
DEFAULT_TOKENS = [
    "copyright",
    "allrights",
    "reserved",
    "watermark",
    ".com",
    ".net",
    ".org",
    ".cn",
]
DOMAIN_PARTS = ["com", "net", "org", "cn", "eu"]
BUILT_IN_PHRASES = ["copyright", "issuedby"]
BOTTOM_LEFT, BOTTOM_RIGHT, COVER_TEXT = "bottom_left", "bottom_right", "cover_text"
MARK_REGIONS = [BOTTOM_LEFT, BOTTOM_RIGHT, COVER_TEXT]
LANDSCAPE_LEFT, LANDSCAPE_RIGHT = (0.82, 0.62), (0.80, 0.74)
PORTRAIT_LEFT, PORTRAIT_RIGHT = (0.88, 0.72), (0.84, 0.74)
DEFAULT_SCORE = 0.45
RETRY_SCORE_LOW, RETRY_SCORE_HIGH = 0.25, 0.35

# Characters a Unicode-aware whitespace split removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def squash(text: Column) -> Column:
    """Lower-case and drop all whitespace. ``translate`` stays in generated code."""
    return F.translate(F.lower(text), WHITESPACE, "")


def normalize_name(name: Column) -> Column:
    """Lower-case, trim and collapse inner whitespace to one blank."""
    blanks = F.translate(F.lower(name), WHITESPACE, " " * len(WHITESPACE))
    return F.trim(F.regexp_replace(blanks, " +", " "))


def contains_any(text: Column, tokens: Sequence[str]) -> Column:
    if not tokens:
        return F.lit(False)
    return reduce(or_, [text.contains(token) for token in tokens])


def is_mark_text(text: Column, region: Column, tokens: Sequence[str] = DEFAULT_TOKENS) -> Column:
    """Configured token anywhere, or a domain-like part in a corner line of four or more characters."""
    in_corner = F.coalesce(region.isin(MARK_REGIONS), F.lit(False))
    words = [*DOMAIN_PARTS, *BUILT_IN_PHRASES]
    return let(
        squash(F.coalesce(text, F.lit(""))),
        lambda flat: contains_any(flat, tokens)
        | (in_corner & (F.length(flat) >= 4) & contains_any(flat, words)),
    )


def may_hold_mark(text: Column, tokens: Sequence[str], any_corner: bool) -> Column:
    """Whether a whole text can hold a mark line at all: it must contain one of the words."""
    words = [*tokens, *DOMAIN_PARTS, *BUILT_IN_PHRASES] if any_corner else list(tokens)
    return let(squash(F.coalesce(text, F.lit(""))), lambda flat: contains_any(flat, words))


def text_region(center_x: Column, center_y: Column, width: Column, height: Column, category: Column) -> Column:
    """Region of a line's centre; the left rule is tried before the right one, else NULL."""

    def corner(left: tuple[float, float], right: tuple[float, float]) -> Column:
        return F.when(
            (center_y >= height * left[0]) & (center_x <= width * left[1]), BOTTOM_LEFT
        ).when((center_y >= height * right[0]) & (center_x >= width * right[1]), BOTTOM_RIGHT)

    return (
        F.when(category == COVER, COVER_TEXT)
        .when(category == LANDSCAPE, corner(LANDSCAPE_LEFT, LANDSCAPE_RIGHT))
        .otherwise(corner(PORTRAIT_LEFT, PORTRAIT_RIGHT))
    )


def polygon_center(polygon: Column) -> tuple[Column, Column]:
    def mean(axis: str) -> Column:
        total = F.aggregate(polygon[axis], F.lit(0.0), lambda acc, v: acc + v)
        return total / F.greatest(F.size(polygon), F.lit(1))

    return mean("x"), mean("y")


def polygon_bounds(polygon: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = polygon["x"], polygon["y"]
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def retry_score(threshold: float) -> float:
    """Score limit of the second attempt of a cascade."""
    return max(RETRY_SCORE_LOW, min(threshold, RETRY_SCORE_HIGH))
