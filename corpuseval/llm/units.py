"""Splitting Arrow text columns into white-space separated units, by numpy on the UTF-8 bytes.

White space is the six ASCII characters ``\\x20\\x09-\\x0D``. Helpers for the operators' Arrow tasks; a chunk is a
bounded slice of a task's rows, so memory does not depend on the size of a partition.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK_BYTES = 4 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values and their n + 1 offsets; a null is an empty text."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after whose end the worker hands freed memory back. Workers are reused, and an idle one would else keep the
    most that any task has taken, beside all later stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def release_memory() -> None:
    """Return freed Arrow and C memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: int, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``size`` bytes of text (one row at least) and 20,000 rows."""
    for batch in batches:
        _, bounds = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows, at + 20_000)
            yield batch.slice(at, end - at)
            at = end


def split_units(
    data: np.ndarray, bounds: np.ndarray, keep_space: bool = False
) -> tuple[pa.StringArray, np.ndarray]:
    """(units, first unit of each text with the end).

    With ``keep_space`` a unit that follows a space (0x20) in its text starts with that space.
    """
    units, of_text, _, _ = split_parts(data, bounds, keep_space)
    return units, of_text


def split_parts(
    data: np.ndarray, bounds: np.ndarray, keep_space: bool
) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``split_units``, with the bytes that units hold, and where a word begins inside a text without its space."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return pa.array([], pa.string()), np.zeros(len(bounds), dtype=np.int64), none.astype(bool), none
    word = ~SPACES[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
    begin[firsts] = word[firsts]
    starts = np.flatnonzero(begin)
    of_text = np.searchsorted(starts, bounds)
    lead = np.zeros(len(starts), dtype=np.int64)
    bare = starts
    if keep_space and len(starts):
        inner = np.ones(len(starts), dtype=bool)
        inner[np.searchsorted(starts, firsts[word[firsts]])] = False
        bare = starts[inner & (data[starts - 1] != 32)]
        lead = (inner & (data[starts - 1] == 32)).astype(np.int64)
        word[(starts - lead)[lead > 0]] = True
    kept = data[word]
    ends = np.concatenate([np.cumsum(word, dtype=np.int32)[np.maximum(starts - lead, 0)] - 1, [len(kept)]])
    if not len(starts):
        return pa.array([], pa.string()), of_text, word, bare
    units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(kept.tobytes()))
    return units, of_text, word, bare


def split_gaps(data: np.ndarray, bounds: np.ndarray, held: np.ndarray, bare: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The white space outside units, as byte-level pre-tokens, and the text of each.

    A run before a word without its own space gives its last character alone; what is left of a run, and a run at the
    end of a text, is one pre-token.
    """
    gap = ~held
    begin = gap.copy()
    begin[1:] &= held[:-1]
    firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
    begin[firsts] = gap[firsts]
    begin[bare - 1] = True
    at = np.flatnonzero(begin)
    ends = np.concatenate([np.cumsum(gap, dtype=np.int32)[at] - 1, [int(gap.sum())]]).astype(np.int32)
    kept = data[gap].tobytes()
    runs = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(kept)) if len(at) else pa.array([], pa.string())
    return runs, np.searchsorted(bounds, at, side="right") - 1


def grouped(codes: np.ndarray, texts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(present codes' list offsets, texts ordered by code), for building one list of texts for each code."""
    order = np.argsort(codes, kind="stable")
    counts = np.bincount(codes, minlength=size)
    return np.concatenate([[0], np.cumsum(counts)]), texts[order]


def coded(units: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    """Units as codes into their distinct values."""
    found = units.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def spread(of_text: np.ndarray) -> np.ndarray:
    """The text's position for each unit."""
    return np.repeat(np.arange(len(of_text) - 1), np.diff(of_text))


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of consecutive runs: starts[i], starts[i] + 1, ... for lengths[i] items each."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else starts, lengths)
    return np.arange(total, dtype=np.int64) + shift


def most_frequent(counted: DataFrame, count_col: str, n: int) -> DataFrame:
    """The rows of the greatest counts, at most ``n`` of them: all whose count reaches a threshold, so equal counts stay
    together. The threshold comes from a table with a row for each band of counts (64 to an octave), so neither the driver
    nor a task grows with the partitions, as it would in a sort with a limit. ``counted`` is read twice: store it before.
    """
    bands = counted.groupBy(F.floor(F.log2(count_col) * 64).alias("band"))
    table = bands.agg(F.min(count_col).alias("least"), F.count("*").alias("rows")).orderBy(F.desc("band")).collect()
    seen, least = 0, None
    for band in table:
        seen += band["rows"]
        if seen > n:
            break
        least = band["least"]
    return counted.where(F.lit(False) if least is None else F.col(count_col) >= least)
