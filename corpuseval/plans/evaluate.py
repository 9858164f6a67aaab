"""Run user providers over image rows and score them.

A provider is built once per task and called per image. What it raises becomes a status and a
note on that row, so one bad image does not fail a task. Only scalar metrics, boxes and a packed
mask leave the Python worker; pixels never go back to the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from time import perf_counter
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpuseval.functions import pixels
from corpuseval.functions.boxes import FULL_CONFIDENCE_SHARE, ROI_SPECS
from corpuseval.functions.classify import COVER
from corpuseval.metrics import METRICS
from corpuseval.operators.masks import attach_masks
from corpuseval.operators.validate import require_rows
from corpuseval.session import ship_package
from corpuseval.schemas import BOX, DOUBLE, LONG, STRING, STRING_MAP, struct


class ProviderUnavailable(Exception):
    """The provider cannot run here (missing model, missing input)."""


@dataclass
class MaskOutput:
    mask: np.ndarray
    confidence: float = 0.0
    boxes: list[dict[str, Any]] = field(default_factory=list)
    meta: dict[str, str] = field(default_factory=dict)


@dataclass
class TransformOutput:
    restored: np.ndarray
    status: str = ""
    note: str = ""
    meta: dict[str, str] = field(default_factory=dict)


class MaskProvider(Protocol):
    def detect(self, item: dict[str, Any], image: np.ndarray) -> MaskOutput: ...


class TransformProvider(Protocol):
    def restore(self, item: dict[str, Any], image: np.ndarray, mask: np.ndarray) -> TransformOutput: ...


class SeedMask:
    """The prepared mask in column ``seed_mask`` (packed words); empty when missing.

    A mask of another shape than the frame is an error. Its shape is in ``seed_mask_height`` and ``seed_mask_width``;
    without them the words must at least be as many as the frame needs, and hold nothing beyond it.
    """

    def detect(self, item: dict[str, Any], image: np.ndarray) -> MaskOutput:
        height, width = image.shape[:2]
        words = item.get("seed_mask")
        if words is None:
            return MaskOutput(np.zeros((height, width), np.uint8), meta={"note": "missing seed mask"})
        bits = np.unpackbits(np.asarray(words, dtype="<i8").view(np.uint8), bitorder="little")
        shape = (item.get("seed_mask_height", height), item.get("seed_mask_width", width))
        if shape != (height, width) or len(words) != -(-height * width // 64) or bits[height * width :].any():
            raise ValueError(f"seed mask of another shape than the frame of {height} x {width}")
        mask = bits[: height * width].reshape(height, width)
        return MaskOutput(mask, 1.0 if mask.any() else 0.0)


class CornerMask:
    """Bright low-saturation pixels in the search boxes of the item's category."""

    def detect(self, item: dict[str, Any], image: np.ndarray) -> MaskOutput:
        height, width = image.shape[:2]
        frame = np.array([width, height, width, height])
        mask = np.zeros((height, width), np.uint8)
        boxes = []
        bright = pixels.bright_low_saturation(image)
        for category, region, search, fallback, _ in ROI_SPECS:
            if category != item.get("source_category"):
                continue
            x1, y1, x2, y2 = (frame * search).astype(int)
            ys, xs = np.nonzero(bright[y1:y2, x1:x2])
            if len(xs):
                x1, y1, x2, y2 = x1 + xs.min(), y1 + ys.min(), x1 + xs.max() + 1, y1 + ys.max() + 1
            else:
                x1, y1, x2, y2 = (frame * fallback).astype(int)
            mask[y1:y2, x1:x2] = 255
            boxes.append({"region": region, "x1": int(x1), "y1": int(y1), "x2": int(x2), "y2": int(y2)})
        full = max(1.0, width * height * FULL_CONFIDENCE_SHARE)
        return MaskOutput(mask, min(1.0, np.count_nonzero(mask) / full), boxes)


class Identity:
    """Returns the image unchanged, to score masks alone."""

    def restore(self, item: dict[str, Any], image: np.ndarray, mask: np.ndarray) -> TransformOutput:
        return TransformOutput(image.copy(), status="masked_only")


MASK_PROVIDERS: dict[str, Callable[[], MaskProvider]] = {
    "seed_manifest": SeedMask,
    "rule_based_roi": CornerMask,
}
TRANSFORM_PROVIDERS: dict[str, Callable[[], TransformProvider]] = {"noop": Identity}


def resolve(registry: dict[str, Callable[[], Any]], name: str) -> Callable[[], Any]:
    if name not in registry:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(registry))}")
    return registry[name]


RESULT = struct(
    item_id=STRING,
    dataset_id=STRING,
    relative_path=STRING,
    source_category=STRING,
    status=STRING,
    note=STRING,
    mask_provider=STRING,
    restore_provider=STRING,
    confidence=DOUBLE,
    **{m: DOUBLE for m in METRICS},
    boxes=T.ArrayType(BOX),
    mask_words=T.ArrayType(LONG),
    mask_meta=STRING_MAP,
    restore_meta=STRING_MAP,
    residual_meta=STRING_MAP,
)
PIXELS = ["height", "width", "nChannels", "data"]
CARRIED = ["item_id", "dataset_id", "relative_path", "source_category"]


def _mask_metrics(mask: np.ndarray) -> dict[str, float | None]:
    nonzero = int(np.count_nonzero(mask))
    return {
        "mask_nonzero": float(nonzero),
        "mask_ratio": round(nonzero / max(1, mask.size), 6),
        "changed_nonzero": 0.0,
        "mean_abs_diff": 0.0,
        "edge_delta": 0.0,
    }


def _mask_cells(found: MaskOutput) -> dict[str, Any]:
    if np.ndim(found.mask) != 2:
        raise ValueError("a mask has height and width")
    return {
        **_mask_metrics(found.mask),
        "confidence": round(float(found.confidence), 4),
        "boxes": found.boxes,
        "mask_words": pixels.pack(found.mask),
        "mask_meta": found.meta,
    }


def _call(function, *args):
    """``(output, failure, note, milliseconds)``; failure is None, ``unavailable`` or ``error``."""
    start = perf_counter()
    try:
        return function(*args), None, "", (perf_counter() - start) * 1000.0
    except ProviderUnavailable as exc:
        return None, "unavailable", str(exc), None
    except Exception as exc:  # a bad item is data, not a failed task
        return None, "error", str(exc), None


def _evaluate_item(item, image, masker, transformer, scorer, skip_cover):
    """``image`` is called for the pixels; what it or a provider's output raises is a status as well."""
    row: dict[str, Any] = {"status": "", "note": "", "confidence": None}
    if skip_cover and item.get("source_category") == COVER:
        return {**row, "status": "skipped_cover", "note": "cover item"}
    image, failure, note, _ = _call(image)
    if failure:
        return {**row, "status": "decode_provider_error", "note": note}
    found, failure, note, mask_ms = _call(masker.detect, item, image)
    if not failure:
        cells, failure, note, _ = _call(_mask_cells, found)
    if failure:
        empty = np.zeros(image.shape[:2], np.uint8)
        return {**row, **_mask_metrics(empty), "status": f"mask_provider_{failure}", "note": note, "mask_words": pixels.pack(empty)}
    row.update(cells, mask_latency_ms=round(mask_ms, 3))
    if row["mask_nonzero"] == 0:
        return {**row, "status": "no_mask", "note": "the mask is empty"}
    made, failure, note, restore_ms = _call(transformer.restore, item, image, found.mask)
    if not failure:
        changes, failure, note, _ = _call(lambda: pixels.change_metrics(image, made.restored))
    if failure:
        return {**row, "status": f"restore_provider_{failure}", "note": note}
    row.update(changes)
    row.update(
        restore_latency_ms=round(restore_ms, 3),
        restore_meta=made.meta,
        status=made.status or "restored",
        note=made.note,
    )
    if scorer is not None:
        scores, failure, note, score_ms = _call(lambda: [float(x) for x in scorer(item, made.restored)])
        row["residual_meta"] = {"status": failure or "ok", "note": note}
        if not failure:
            row.update(
                ocr_residual_hits=float(len(scores)),
                ocr_residual_score=round(float(sum(scores)), 6),
                ocr_residual_max_score=round(float(max(scores)), 6) if scores else 0.0,
                ocr_residual_latency_ms=round(score_ms, 3),
            )
    return row


def _decoded(record: dict[str, Any]) -> np.ndarray:
    return pixels.decode(record["data"], *(int(record[c]) for c in ("height", "width", "nChannels")))


def evaluate(
    items: DataFrame,
    mask_provider: str,
    transform_provider: str,
    scorer: Callable[[dict[str, Any], np.ndarray], list[float]] | None = None,
    skip_cover: bool = False,
    check_rows: bool = True,
) -> DataFrame:
    """One scored row per item.

    ``items`` has the image-source columns, ``item_id``, ``dataset_id``, ``relative_path``,
    ``source_category`` and whatever else a provider reads. ``scorer`` returns the scores of marks
    still visible; ``residual_meta`` has its status (ok, unavailable, error) and note, and is NULL where it did not run. Narrow: one pass, no shuffle, pixels stay in their task.
    """
    masker_of = resolve(MASK_PROVIDERS, mask_provider)
    transformer_of = resolve(TRANSFORM_PROVIDERS, transform_provider)
    ship_package(items.sparkSession)
    if check_rows:
        require_rows(items.select("item_id"), "evaluation input")
    columns = [f.name for f in RESULT.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masker, transformer = masker_of(), transformer_of()
        for batch in batches:
            details = [c for c in batch.columns if c != "data"]
            rows = []
            for record in batch.to_dict("records"):
                image = partial(_decoded, record)
                item = {c: record[c] for c in details}
                row = dict.fromkeys(columns)
                row.update({c: record[c] for c in CARRIED})
                row.update(mask_provider=mask_provider, restore_provider=transform_provider)
                row.update(_evaluate_item(item, image, masker, transformer, scorer, skip_cover))
                rows.append(row)
            yield pd.DataFrame(rows, columns=columns)

    return items.mapInPandas(run, RESULT)


def with_seed_masks(items: DataFrame, masks: DataFrame, path_col: str = "seed_mask_path") -> DataFrame:
    """Seed masks as packed words in ``seed_mask``. Join item rows before reading their pixels."""
    return attach_masks(items, masks, path_col, "seed_mask")


def gray_images(df: DataFrame, values: Column, height: int, width: int) -> DataFrame:
    """Rows with image-source columns from an array of 0..255 samples, built inside the JVM."""
    digits = F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), "")
    return df.select(
        "*",
        F.lit(height).alias("height"),
        F.lit(width).alias("width"),
        F.lit(1).alias("nChannels"),
        F.unhex(digits).alias("data"),
    )
