"""Numpy helpers used inside Arrow batches of image rows."""

from __future__ import annotations

import numpy as np

from corpuseval.functions.arrays import EDGE_FULL_SCALE, EDGE_LEVEL


def decode(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Spark image-source bytes (BGR rows) as ``uint8[h, w, c]``."""
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of a BGR image (ITU-R BT.601 weights)."""
    if image.ndim == 2:
        return image
    if image.shape[2] == 1:
        return image[:, :, 0]
    weights = np.array([0.114, 0.587, 0.299])
    return np.rint(image[:, :, :3] @ weights).astype(np.uint8)


def edges(image: np.ndarray, level: float = EDGE_LEVEL) -> np.ndarray:
    g = gray(image).astype(np.int16)
    gradient = np.zeros(g.shape, dtype=np.int32)
    gradient[:, :-1] += np.abs(np.diff(g, axis=1))
    gradient[:-1, :] += np.abs(np.diff(g, axis=0))
    return gradient > level


def pack(mask: np.ndarray) -> np.ndarray:
    """Nonzero samples as little-endian 64-bit words, the layout of ``arrays.pack_mask``."""
    raw = np.packbits(np.asarray(mask).ravel() > 0, bitorder="little")
    return np.pad(raw, (0, -len(raw) % 8)).view("<i8")


def change_metrics(before: np.ndarray, after: np.ndarray) -> dict[str, float | None]:
    if before.shape[:2] != after.shape[:2]:
        return {"changed_nonzero": None, "mean_abs_diff": None, "edge_delta": None}
    difference = np.abs(before.astype(np.int16) - after.astype(np.int16))
    per_pixel = difference if difference.ndim == 2 else difference.max(axis=2)
    return {
        "changed_nonzero": float(np.count_nonzero(per_pixel)),
        "mean_abs_diff": round(float(difference.mean()), 6),
        "edge_delta": round(float((edges(before) ^ edges(after)).mean()) * EDGE_FULL_SCALE, 6),
    }


def bright_low_saturation(image: np.ndarray, saturation_below: int = 70, value_above: int = 150) -> np.ndarray:
    """Near-white pixels: HSV saturation below and value above a limit (8-bit scale)."""
    bgr = image[:, :, :3].astype(np.float32) if image.ndim == 3 and image.shape[2] >= 3 else None
    if bgr is None:
        return gray(image) > value_above
    value = bgr.max(axis=2)
    spread = value - bgr.min(axis=2)
    saturation = np.where(value > 0, np.rint(255.0 * spread / np.maximum(value, 1)), 0)
    return (saturation < saturation_below) & (value > value_above)
